"""DuckDB SQL for the queries that SQL expresses; it shares nothing with the operators."""

from __future__ import annotations

_ORACLES = {
    "op4_exact_dedup": """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
""",
    "op12_prefix_trie": """
WITH own AS (
  SELECT conv_id, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
         length(coalesce(text, '')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::UBIGINT,
             list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
           lambda crc, byte: list_reduce(
             list_prepend(xor(crc, byte), list_transform(range(8), lambda i: 0::UBIGINT)),
             lambda x, y: xor(x // 2, (x % 2) * 3988292384::UBIGINT)))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.k, o.chars
  FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.k, o.chars FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
turns AS (
  SELECT conv_id, chars, row_number() OVER w AS depth, string_agg(k, '') OVER w AS prefix
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
members AS (
  SELECT conv_id, chars, depth, prefix FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS last FROM members GROUP BY conv_id),
nodes AS (
  SELECT prefix, depth, left(prefix, 32 * (depth - 1)) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
         max(chars) AS chars, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last = depth) AS ends
  FROM members JOIN lengths USING (conv_id) GROUP BY prefix, depth),
children AS (SELECT above AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
valued AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children, (n IS NULL)::BIGINT AS leaf, (n_convs - 1) * chars AS saved
  FROM nodes LEFT JOIN children USING (prefix)),
spread AS (SELECT left(prefix, 32 * unnest(range(depth + 1))) AS prefix, leaf, saved FROM valued),
sums AS (SELECT prefix, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM spread GROUP BY prefix)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens,
       sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN sums s USING (prefix) LEFT JOIN nodes p ON v.depth > 0 AND p.prefix = v.above
""",
    "op13_lexical_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM docs),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
weighted AS (
  SELECT item_id, term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM wanted JOIN dfs USING (term), totals),
scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM weighted JOIN tfs USING (term) JOIN docs USING (doc_id), totals
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
