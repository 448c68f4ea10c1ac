"""The registered queries once more in plain SQL, written without the operators they check."""

from __future__ import annotations

from parley.constants import NOTHING_FOUND
from parley.plans.catalog import AS_OF, DIMS, LOADED_AT, OWNER, QUERY_VECTOR, ROLE_SQL

_D = "CAST(doc_id AS VARCHAR)"
_US = "epoch_us(ts)"

VIEWS = {
    "v_logs": "SELECT event_id AS id, user_id, event_type AS topic, value AS interaction_duration,"
    " ts AS created_at FROM events",
    "v_roles": f"SELECT * FROM (VALUES {ROLE_SQL}) AS t(id, role_name, permissions)",
    "v_users": "SELECT c_custkey AS id, concat(lower(replace(c_name,'#','.')),'@example.com') AS email,"
    " CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 2"
    " ELSE 3 END AS role_id FROM customer",
    "v_perms": "SELECT u.id AS user_id, u.role_id, r.role_name, r.permissions"
    " FROM v_users u JOIN v_roles r ON u.role_id = r.id",
    "v_profiles": "SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 5000 THEN 'premium'"
    " ELSE 'standard' END AS usage_tier FROM customer WHERE c_acctbal >= 0",
    "v_docs": "SELECT d.doc_id AS id, d.doc_id % 15 AS user_id, concat('f', CAST(d.doc_id AS VARCHAR),"
    " CASE WHEN d.doc_id % 7 = 0 THEN '.PDF' WHEN d.doc_id % 5 = 0 THEN '.txt' ELSE '.pdf' END)"
    " AS file_name, e.ts AS created_at FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id",
    "v_vectors": "SELECT v.vec_id AS id, CAST(v.embedding AS DOUBLE[]) AS embedding, d.doc_id % 15 AS owner"
    " FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id",
    "v_status_log": "SELECT event_id AS seq, user_id AS doc_id, CASE event_type WHEN 'signup' THEN 'PENDING'"
    " WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END AS status, ts"
    " FROM events",
    "v_calls": "SELECT event_id AS call_id, user_id, CASE event_type WHEN 'click' THEN 'rag_knowledge_search'"
    " WHEN 'view' THEN 'query_user_analytics' ELSE concat('tool_', event_type) END AS tool,"
    """ CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE '' END AS query,"""
    " event_id % 3 < 2 AS has_query FROM events",
    "v_raw": f"""SELECT doc_id AS offset_id, CASE WHEN doc_id % 11 = 0 THEN '{{bad'
 WHEN doc_id % 7 = 0 THEN concat('{{"doc_id":"', md5({_D}), '","file_path":"/u/a.pdf","file_name":"a.pdf"}}')
 WHEN doc_id % 5 = 0 THEN concat('{{"doc_id":"not-a-uuid","user_id":"', md5('u'),
  '","file_path":"/u/a.pdf","file_name":"a.pdf"}}')
 WHEN doc_id % 13 = 0 THEN concat('{{"doc_id":"', md5({_D}), '","user_id":"', md5('u'),
  '","file_path":"","file_name":"a.pdf"}}')
 ELSE concat('{{"doc_id":"', md5({_D}), '","user_id":"', md5('u'), '","file_path":"/u/', {_D},
  '.pdf","file_name":"a.pdf"}}') END AS value FROM documents""",
    "v_parsed": "SELECT offset_id, json_valid(value) AS good,"
    + ", ".join(
        f" CASE WHEN json_valid(value) THEN json_extract_string(value, '$.{c}') END AS {c}"
        for c in ("doc_id", "user_id", "file_path", "file_name")
    )
    + " FROM v_raw",
    "v_checked": "SELECT *, CASE WHEN NOT good THEN 'BAD_JSON' WHEN coalesce(doc_id,'') = '' OR"
    " coalesce(user_id,'') = '' OR coalesce(file_path,'') = '' THEN 'MISSING_FIELD'"
    " WHEN NOT regexp_full_match(doc_id, '[0-9a-f]{32}') THEN 'BAD_UUID' ELSE 'OK' END AS reason,"
    " concat_ws('-', substr(doc_id,1,8), substr(doc_id,9,4), substr(doc_id,13,4), substr(doc_id,17,4),"
    " substr(doc_id,21,12)) AS dashed FROM v_parsed",
    "v_signal": "SELECT vec_id AS signal_id, unnest(range(1, len(embedding)+1)) AS n,"
    " CAST(unnest(embedding) AS DOUBLE) AS sample FROM embeddings",
    "v_md": "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:"
    " CASE WHEN (i-1) % 3 = 0 THEN concat(repeat('#', CAST(1 + ((i-1) // 3) % 5 AS INT)), ' ', l)"
    " ELSE l END), chr(10)) AS text FROM documents",
    "v_topics": "SELECT user_id, topic, count(*) AS n, max(created_at) AS last_at FROM v_logs GROUP BY ALL",
    "v_top": "SELECT user_id, CAST(to_json(list(topic ORDER BY n DESC, topic)) AS VARCHAR) AS top_topics FROM"
    " (SELECT * FROM v_topics QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, topic) <= 2)"
    " GROUP BY user_id",
    "v_analytics": "SELECT t.user_id, CAST(sum(n) AS BIGINT) AS total_interactions,"
    " any_value(p.top_topics) AS top_topics, max(last_at) AS last_updated_at"
    " FROM v_topics t JOIN v_top p ON p.user_id = t.user_id GROUP BY t.user_id",
    "v_text": "SELECT user_id, concat('User Analytics Insights:', chr(10), '- Total Interactions: ',"
    " CAST(total_interactions AS VARCHAR), chr(10), '- Top Topics: ', top_topics, chr(10),"
    " '- Last Updated: ', CASE WHEN epoch_us(last_updated_at) % 1000000 = 0"
    " THEN strftime(last_updated_at, '%Y-%m-%d %H:%M:%S')"
    " ELSE strftime(last_updated_at, '%Y-%m-%d %H:%M:%S.%f') END) AS summary FROM v_analytics",
    # Header chunks by lines and running windows: a different method from nested cutting.
    "v_lines": "SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10)))+1)) AS no,"
    " unnest(string_split(text, chr(10))) AS line FROM v_md",
    "v_fenced": r"SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t, sum(CASE WHEN"
    r" regexp_matches(trim(line, ' ' || chr(9) || chr(13)), '^(```|~~~)') THEN 1 ELSE 0 END) OVER"
    r" (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fences"
    r" FROM v_lines",
    "v_levels": r"SELECT *, CASE WHEN coalesce(fences, 0) % 2 = 0 AND regexp_matches(t, '^#{1,4}( |$)')"
    r" THEN length(regexp_extract(t, '^#+')) END AS level FROM v_fenced",
    "v_sections": "SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY no) AS section FROM v_levels",
    "v_crumbs": "SELECT doc_id, section, any_value(text) AS text,"
    " string_agg(line, chr(10) ORDER BY no) AS body, max(level) AS level,"
    " max(CASE WHEN level IS NOT NULL THEN trim(regexp_replace(t, '^#+', ''),"
    " ' ' || chr(9) || chr(13) || chr(10)) END) AS title FROM v_sections GROUP BY doc_id, section",
    "v_marks": "SELECT *, "
    + ", ".join(
        f"max(CASE WHEN level = {k} THEN section END) OVER w AS at{k},"
        f" max(CASE WHEN level < {k} THEN section END) OVER w AS up{k}"
        for k in range(1, 5)
    )
    + " FROM v_crumbs WINDOW w AS (PARTITION BY doc_id ORDER BY section)",
    "v_named": "SELECT m.doc_id, m.section, m.text, trim(m.body, ' ' || chr(9) || chr(13) || chr(10)) AS body, "
    + ", ".join(f"CASE WHEN at{k} > coalesce(up{k}, -1) THEN h{k}.title END AS header_{k}" for k in range(1, 5))
    + " FROM v_marks m "
    + " ".join(
        f"LEFT JOIN v_crumbs h{k} ON h{k}.doc_id = m.doc_id AND h{k}.section = m.at{k}" for k in range(1, 5)
    ),
    "v_split": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS INTEGER)"
    " AS chunk_idx, header_1, header_2, header_3, header_4, body AS chunk_text FROM v_named WHERE body <> ''"
    " UNION ALL SELECT doc_id, 0, NULL, NULL, NULL, NULL, any_value(text) FROM v_named GROUP BY doc_id"
    " HAVING max(CASE WHEN body <> '' THEN 1 ELSE 0 END) = 0",
    # kNN of every vector among the vectors of its owner.
    "v_hits": "SELECT * FROM (SELECT q.id AS query_id, c.id, q.owner,"
    " list_dot_product(q.embedding, c.embedding) / sqrt(list_dot_product(q.embedding, q.embedding))"
    " / sqrt(list_dot_product(c.embedding, c.embedding)) AS similarity"
    " FROM v_vectors q JOIN v_vectors c ON q.owner = c.owner)"
    " QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) <= 5",
    "v_ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id)"
    " AS INTEGER) AS rank FROM v_hits",
}

_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\r\n\f]+'), lambda w: w <> '')"


def _embedding(source: str, keys: str, text: str) -> str:
    """SQL of a table (keys, embedding) of hashed, normalised word counts over ``source``."""
    words = _WORDS.format(text)
    return (
        f"SELECT {keys}, list_transform(range(0, {DIMS}), lambda i: CAST(coalesce(map_extract(m, i)[1]"
        f" / len, 0) AS FLOAT)) AS embedding FROM (SELECT {keys}, map_from_entries(list((b, n))) AS m,"
        f" sqrt(CAST(sum(n * n) AS DOUBLE)) AS len FROM (SELECT {keys},"
        f" CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % {DIMS} AS b, CAST(count(*) AS DOUBLE) AS n"
        f" FROM (SELECT {keys}, unnest({words}) AS w FROM {source}) GROUP BY ALL) GROUP BY {keys})"
    )


def _numbers(vector: str) -> str:
    return (
        f"array_to_string(list_transform({vector}, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 10000 + 0.5)"
        " AS BIGINT) AS VARCHAR)), ',')"
    )


def _quantised(x: str) -> str:
    return f"least(floor(greatest(-1.0, least(1.0, {x})) * 32768), 32767)"


# Every document as a chunk with a hashed embedding; one without words has none and is in no search.
VIEWS["v_chunks"] = (
    "SELECT d.doc_id AS id, d.doc_id, d.text AS chunk_text, d.doc_id % 15 AS owner,"
    f" CAST(e.embedding AS DOUBLE[]) AS embedding FROM documents d LEFT JOIN ({_embedding('documents', 'doc_id', 'text')}) e"
    " ON e.doc_id = d.doc_id"
)
VIEWS["v_embedded"] = "SELECT * FROM v_chunks WHERE embedding IS NOT NULL"
VIEWS["v_chunk_hits"] = (
    "SELECT * FROM (SELECT q.id AS query_id, c.id, c.chunk_text,"
    " list_dot_product(q.embedding, c.embedding) / sqrt(list_dot_product(q.embedding, q.embedding))"
    " / sqrt(list_dot_product(c.embedding, c.embedding)) AS similarity"
    " FROM v_embedded q JOIN v_embedded c ON q.owner = c.owner)"
    " QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) <= 5"
)
VIEWS["v_chunk_ranked"] = (
    "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id)"
    " AS INTEGER) AS rank FROM v_chunk_hits"
)

# What the fixture's pages contain of elements and entities.
_DROPPED = ("script", "style", "nav", "footer")
_BLOCKS = ("title", "h[1-6]", "p", "div", "article", "section", "ul", "ol", "table", "tr", "body", "head", "html")
_NAMED = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("copy", "©"), ("middot", "·"),
          ("hellip", "…"), ("ndash", "–"), ("mdash", "—"), ("euro", "€"))


def _html() -> str:
    nl = "chr(10)"
    c = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
    for tag in _DROPPED:
        c = rf"regexp_replace({c}, '<{tag}\b[^>]*>.*?</{tag}[ \t\r\n]*>', ' ', 'gis')"
    c = rf"regexp_replace({c}, '[ \t\r\n\f]+', ' ', 'g')"
    c = rf"regexp_replace({c}, '<(?:title|h1)\b[^>]*>', {nl} || {nl} || '# ', 'gi')"
    for level in range(2, 7):
        c = rf"regexp_replace({c}, '<h{level}\b[^>]*>', {nl} || {nl} || '{'#' * level} ', 'gi')"
    c = rf"regexp_replace({c}, '<li\b[^>]*>', {nl} || '- ', 'gi')"
    c = rf"regexp_replace({c}, '<br\b[^>]*>', {nl}, 'gi')"
    c = rf"regexp_replace({c}, '</?(?:{'|'.join(_BLOCKS)})\b[^>]*>', {nl} || {nl}, 'gi')"
    c = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for name, char in _NAMED:
        quoted = char.replace("'", "''")
        c = f"replace({c}, '&{name};', '{quoted}')"
    c = f"replace({c}, '&amp;', '&')"
    c = rf"regexp_replace({c}, ' *\n *', {nl}, 'g')"
    c = rf"regexp_replace({c}, '\n{{3,}}', {nl} || {nl}, 'g')"
    return f"trim({c}, ' ' || chr(9) || chr(13) || chr(10))"


_ALLOWED = "can_write_knowledge"
_HAS = "coalesce(CAST(json_extract(p.permissions, '$.{0}') AS BOOLEAN), false)"
_DENIED = "concat('Authorization Failure: User lacks required permission ''', '{0}', '''.')"
_ANALYTICS_TOOL = f"""SELECT c.call_id, c.user_id,
 CASE WHEN NOT {_HAS.format('can_query_analytics')} THEN 'DENIED' WHEN a.user_id IS NULL THEN 'NOT_FOUND'
 ELSE 'OK' END AS status,
 CASE WHEN NOT {_HAS.format('can_query_analytics')} THEN {_DENIED.format('can_query_analytics')}
 WHEN a.user_id IS NULL THEN concat('No user analytics data found for user ID: ', CAST(c.user_id AS VARCHAR), '.')
 ELSE a.summary END AS result
 FROM v_calls c LEFT JOIN v_perms p ON p.user_id = c.user_id LEFT JOIN v_text a ON a.user_id = c.user_id"""
_TERMS = f"v_terms AS ({_embedding('(SELECT DISTINCT query FROM v_calls)', 'query', 'query')})"
_FOUND = f"""v_found AS (SELECT * FROM (SELECT s.user_id, s.query, k.id, k.chunk_text,
 list_dot_product(CAST(t.embedding AS DOUBLE[]), k.embedding)
 / sqrt(list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])))
 / sqrt(list_dot_product(k.embedding, k.embedding)) AS similarity
 FROM (SELECT DISTINCT user_id, query FROM v_calls) s JOIN v_terms t ON t.query = s.query
 JOIN v_embedded k ON k.owner = s.user_id)
 QUALIFY row_number() OVER (PARTITION BY user_id, query ORDER BY round(similarity, 9) DESC, id) <= 5)"""
_REPORTS = """v_reports AS (SELECT user_id, query, string_agg(concat('Result ', CAST(rank AS VARCHAR),
 ' (Similarity: ', printf('%.4f', similarity), '):', chr(10), chunk_text), chr(10) || chr(10) ORDER BY rank) AS report
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, query ORDER BY round(similarity, 9) DESC, id) AS rank
 FROM v_found) GROUP BY user_id, query)"""
_SEARCH_TOOL = f"""SELECT c.call_id, c.user_id,
 CASE WHEN NOT {_HAS.format(_ALLOWED)} THEN 'DENIED' ELSE 'OK' END AS status,
 CASE WHEN NOT {_HAS.format(_ALLOWED)} THEN {_DENIED.format(_ALLOWED)}
 ELSE coalesce(r.report, '{NOTHING_FOUND}') END AS result
 FROM v_calls c LEFT JOIN v_perms p ON p.user_id = c.user_id
 LEFT JOIN v_reports r ON r.user_id = c.user_id AND r.query = c.query"""
_MODE = "CASE tool WHEN 'rag_knowledge_search' THEN 'INTERRUPT' ELSE 'WHEN_IDLE' END"
_Q = "[" + ", ".join(repr(x) for x in QUERY_VECTOR) + "]"

# Each entry: SQL, optionally preceded by further CTEs, over the views above.
_SQL: dict[str, str] = {
    "interaction_counts": "SELECT user_id, count(*) AS total_interactions,"
    f""" '["general", "ai_architecture"]' AS top_topics, TIMESTAMP '{LOADED_AT}' AS last_updated_at"""
    " FROM v_logs GROUP BY user_id",
    "engagement": "SELECT user_id, round(avg(interaction_duration), 6) AS avg_duration,"
    " count(id) AS total_interactions FROM v_logs GROUP BY user_id",
    "top_topics": "SELECT * FROM v_top",
    "user_analytics": "SELECT * FROM v_analytics",
    "maintained_analytics": "SELECT * FROM v_analytics",
    "interaction_gaps": "SELECT id, user_id, created_at, round(CASE WHEN nxt IS NOT NULL THEN"
    " least((epoch_us(nxt) - epoch_us(created_at)) / 1e6, 3600.0) END, 6) AS duration_s FROM (SELECT *,"
    " lead(created_at) OVER (PARTITION BY user_id ORDER BY created_at, id) AS nxt FROM v_logs)",
    "response_latency": f"SELECT user_id, event_id AS response_seq, ts AS response_ts,"
    f" round(({_US} - asked) / 1e6, 6) AS latency_s FROM (SELECT *, min(CASE WHEN event_type = 'click'"
    f" THEN {_US} END) OVER (PARTITION BY user_id, grp) AS asked FROM (SELECT *, coalesce(sum(CASE WHEN"
    " event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN"
    " UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM events WHERE event_type IN ('click', 'view')))"
    " WHERE event_type = 'view' AND asked IS NOT NULL",
    "key_bounds": "SELECT min(id) AS lower_bound, max(id) AS upper_bound FROM v_logs",
    "stride_report": "SELECT CAST((id >= s + w)::INT + (id >= s + 2 * w)::INT + (id >= s + 3 * w)::INT AS INTEGER)"
    " AS stride, count(*) AS rows FROM v_logs, (SELECT lo + (hi - lo - 4 * w + 1) // 2 AS s, w FROM"
    " (SELECT min(id) AS lo, max(id) AS hi, (max(id) - min(id)) // 4 AS w FROM v_logs)) GROUP BY 1",
    "recent_events": "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "recent_per_user": "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)"
    " AS INTEGER) AS rank FROM events QUALIFY rank <= 3",
    "analytics_lookup": "SELECT * FROM v_analytics WHERE user_id = 7",
    "analytics_text": "SELECT * FROM v_text",
    "role_seeds": "SELECT role_name, count(*) AS users FROM v_perms GROUP BY role_name",
    "user_permissions": "SELECT * FROM v_perms",
    "permission_matrix": "SELECT role_name, permission, CAST(json_extract(permissions, concat('$.', permission))"
    " AS BOOLEAN) AS allowed, users FROM (SELECT role_name, permissions, unnest(json_keys(permissions)) AS"
    " permission, users FROM (SELECT role_name, permissions, count(*) AS users FROM v_perms GROUP BY ALL))",
    "permission_gate": f"SELECT c.call_id, c.user_id, c.tool, {_HAS.format(_ALLOWED)} AS allowed FROM v_calls c"
    " LEFT JOIN v_perms p ON p.user_id = c.user_id",
    "profile_enrich": "SELECT u.*, coalesce(p.usage_tier, 'standard') AS usage_tier FROM v_users u"
    " LEFT JOIN v_profiles p ON p.user_id = u.id",
    "cache_overlay": "SELECT b.user_id, CASE WHEN live THEN c.props ELSE b.permissions END AS permissions,"
    " coalesce(live, false) AS from_cache FROM v_perms b LEFT JOIN (SELECT user_id, props,"
    f" TIMESTAMP '{AS_OF}' < ts + INTERVAL 5 DAY AS live FROM events WHERE event_type = 'signup'"
    f" AND ts <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) c"
    " ON c.user_id = b.user_id",
    "cache_as_of": "e AS (SELECT user_id, ts AS loaded, max(props) AS held FROM events WHERE event_type = 'signup'"
    " GROUP BY ALL), m AS (SELECT c.event_id AS call_id, c.user_id, c.ts, e.held,"
    " coalesce(c.ts < e.loaded + INTERVAL 2 DAY, false) AS from_cache FROM events c ASOF LEFT JOIN e"
    " ON c.user_id = e.user_id AND c.ts >= e.loaded) SELECT m.call_id, m.user_id, m.ts,"
    " CASE WHEN from_cache THEN m.held ELSE p.permissions END AS permissions, from_cache"
    " FROM m LEFT JOIN v_perms p ON p.user_id = m.user_id",
    "owned_chunks": "SELECT id, doc_id, owner, chunk_text FROM v_chunks"
    " WHERE owner IN (SELECT id FROM v_users WHERE role_id = 2)",
    "token_claims": "SELECT id, md5(CAST(id AS VARCHAR)) AS user_id, CASE WHEN role_id <> 3 THEN role_id END"
    " AS role_id, CASE WHEN role_id = 3 THEN 'MISSING' ELSE 'OK' END AS status FROM v_users",
    "unique_violations": "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL"
    " HAVING count(*) > 1",
    "not_null_report": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM v_parsed"
        for c in ("doc_id", "user_id", "file_path", "file_name")
    ),
    "length_violations": "SELECT page_id, 'url' AS \"column\", CAST(length(url) AS INTEGER) AS length, 40 AS allowed"
    " FROM pages WHERE length(url) > 40 UNION ALL SELECT page_id, 'html', CAST(length(html) AS INTEGER), 5000"
    " FROM pages WHERE length(html) > 5000",
    "fk_orphans": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders o WHERE NOT EXISTS"
    " (SELECT 1 FROM v_profiles p WHERE p.user_id = o.o_custkey)",
    "cascade_delete": "SELECT count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys, 'customer' AS \"table\""
    " FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT count(*), CAST(sum(o_orderkey) AS BIGINT), 'orders'"
    " FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL"
    " SELECT count(*), CAST(sum(l_orderkey) AS BIGINT), 'lineitem' FROM lineitem WHERE l_orderkey NOT IN"
    " (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0)",
    "delete_closure": "down(top, k) AS (SELECT c_custkey, c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT top,"
    " c_custkey FROM down JOIN customer ON c_custkey % 5 <> 1 AND c_custkey // 8 = k), blocked AS (SELECT DISTINCT top FROM"
    " down JOIN orders ON o_custkey = k JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 49),"
    " gone AS (SELECT DISTINCT k FROM down WHERE top NOT IN (SELECT top FROM blocked)), gone_orders AS (SELECT o_orderkey"
    " FROM orders WHERE o_custkey IN (SELECT k FROM gone)) SELECT 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS key, 0"
    " AS line, CASE WHEN c_custkey IN (SELECT top FROM blocked) THEN 'blocked' ELSE 'deleted' END AS outcome FROM customer"
    " WHERE c_acctbal < 0 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 0, 'left' FROM customer WHERE c_custkey"
    " NOT IN (SELECT k FROM gone) UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 0, 'left' FROM orders WHERE"
    " o_orderkey NOT IN (SELECT o_orderkey FROM gone_orders) UNION ALL SELECT 'lineitem', CAST(l_orderkey AS VARCHAR),"
    " CAST(l_linenumber AS INTEGER), 'left' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone_orders)",
    "restrict_delete": "SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"
    " AS blocked FROM customer WHERE c_acctbal < 0",
    "insert_ignore": "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN 'NEW'"
    " ELSE o_orderpriority END AS o_orderpriority FROM orders",
    "upsert": "SELECT coalesce(o_orderkey, k) AS o_orderkey, coalesce(v, o_totalprice) AS o_totalprice FROM orders"
    " FULL JOIN (SELECT l_orderkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R'"
    " GROUP BY 1) ON k = o_orderkey",
    "parse_events": "SELECT offset_id, doc_id, user_id, file_path, file_name, NOT good AS corrupt FROM v_parsed",
    "event_validation": "SELECT offset_id, CASE WHEN reason = 'OK' THEN dashed ELSE doc_id END AS doc_id, reason"
    " FROM v_checked",
    "encode_events": "SELECT offset_id, CAST(json_object('doc_id', dashed, 'user_id', user_id, 'file_path',"
    " file_path, 'file_name', file_name) AS VARCHAR) AS value FROM v_checked WHERE reason = 'OK'",
    "uuid_canonical": f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(md5({_D})) WHEN 1 THEN"
    f" concat('{{', md5({_D}), '}}') WHEN 2 THEN concat('urn:uuid:', md5({_D})) WHEN 3 THEN"
    f" concat(substr(md5({_D}),1,16), '-', substr(md5({_D}),17)) ELSE substr(md5({_D}),1,31) END AS raw,"
    f" CASE WHEN doc_id % 5 < 4 THEN regexp_replace(md5({_D}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$',"
    r" '\1-\2-\3-\4-\5') END AS canonical FROM documents",
    "apply_defaults": "SELECT offset_id, coalesce(user_id, '00000000-0000-0000-0000-000000000000') AS user_id,"
    " file_name, 'PENDING' AS status FROM v_parsed",
    "first_non_empty": "SELECT call_id, query FROM v_calls",
    "pdf_filter": "SELECT id, file_name, concat(CAST(id AS VARCHAR), '_', file_name) AS stored_name FROM v_docs"
    " WHERE ends_with(file_name, '.pdf')",
    "iso_timestamps": "SELECT id, CASE WHEN epoch_us(created_at) % 1000000 = 0"
    " THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S') ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') END"
    " AS created FROM v_docs",
    "dedupe_events": "SELECT event_id, user_id, ts, 1 AS delivery FROM events",
    "latest_status": "SELECT doc_id, arg_max(status, (ts, seq)) AS status, max(ts) AS since FROM v_status_log"
    " GROUP BY doc_id",
    "status_transitions": "SELECT seq, doc_id, previous, status, ts FROM (SELECT *, lag(status) OVER"
    " (PARTITION BY doc_id ORDER BY ts, seq) AS previous FROM v_status_log) WHERE"
    " (coalesce(previous, ''), status) NOT IN (('', 'PENDING'), ('PENDING', 'PROCESSING'),"
    " ('PENDING', 'FAILED'), ('PROCESSING', 'COMPLETE'), ('PROCESSING', 'FAILED'),"
    " ('COMPLETE', 'PENDING'), ('FAILED', 'PENDING'))",
    "stuck_documents": "SELECT * FROM (SELECT doc_id, arg_max(status, (ts, seq)) AS status, max(ts) AS since"
    f" FROM v_status_log GROUP BY doc_id) WHERE status IN ('PENDING', 'PROCESSING')"
    f" AND since + INTERVAL 6 HOUR < TIMESTAMP '{AS_OF}'",
    "list_documents": "SELECT id, file_name, coalesce(s.status, 'PENDING') AS status, created_at FROM v_docs"
    " LEFT JOIN (SELECT doc_id, arg_max(status, (ts, seq)) AS status FROM v_status_log GROUP BY doc_id) s"
    " ON s.doc_id = id",
    "ttl_windows": f"""w AS (
 SELECT user_id, min(ts) AS a FROM events GROUP BY user_id
 UNION ALL
 SELECT w.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = w.user_id
  AND e.ts >= w.a + INTERVAL 86400 SECOND) AS a FROM w WHERE w.a IS NOT NULL),
 k AS (SELECT user_id, a, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS b FROM w WHERE a IS NOT NULL)
 SELECT k.user_id, k.a AS window_start, CAST(1 AS BIGINT) AS misses, count(*) - 1 AS hits
 FROM k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.a AND (k.b IS NULL OR e.ts < k.b)
 GROUP BY k.user_id, k.a""",
    "rate_limit": f"SELECT id, user_id, ts, nth, nth <= lim AS admitted FROM (SELECT event_id AS id, e.user_id, ts,"
    f" row_number() OVER (PARTITION BY e.user_id, {_US} // 86400000000 ORDER BY ts, event_id) AS nth,"
    " CASE WHEN p.usage_tier = 'premium' THEN 4 ELSE 2 END AS lim FROM events e"
    " LEFT JOIN v_profiles p ON p.user_id = e.user_id)",
    "token_bucket": f"""r AS (SELECT event_id AS id, user_id, ts, {_US} AS us, row_number() OVER
 (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 f AS (SELECT id, user_id, ts, us, n, true AS admitted, CAST(86400000000 AS BIGINT) AS credit_us FROM r WHERE n = 1
 UNION ALL
 SELECT r.id, r.user_id, r.ts, r.us, r.n,
  least(129600000000, f.credit_us + r.us - f.us) >= 43200000000,
  least(129600000000, f.credit_us + r.us - f.us) - CASE WHEN
  least(129600000000, f.credit_us + r.us - f.us) >= 43200000000 THEN 43200000000 ELSE 0 END
 FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
 SELECT id, user_id, ts, admitted, credit_us FROM f""",
    "requests_per_minute": "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events"
    " GROUP BY ALL",
    "html_to_markdown": f"SELECT page_id, {_html()} AS markdown FROM pages",
    "split_markdown": "SELECT * FROM v_split",
    "token_windows": "SELECT doc_id, CAST(j AS INTEGER) AS chunk_idx, array_to_string(ws[j*64+1:(j+1)*64], ' ')"
    " AS chunk_text FROM (SELECT doc_id, ws, unnest(range(0, (len(ws) + 63) // 64)) AS j FROM"
    f" (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents))",
    "chunk_tokens": f"""l AS (SELECT doc_id, i, lines[i] AS line, CAST(len({_WORDS.format('lines[i]')}) AS BIGINT) AS t
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM
   (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
 p AS (SELECT doc_id, i, t AS n, CAST(0 AS BIGINT) AS c FROM l WHERE i = 1
 UNION ALL
 SELECT l.doc_id, l.i, CASE WHEN p.n + l.t > 64 THEN l.t ELSE p.n + l.t END,
  CASE WHEN p.n + l.t > 64 THEN p.c + 1 ELSE p.c END FROM p JOIN l ON l.doc_id = p.doc_id AND l.i = p.i + 1),
 g AS (SELECT p.doc_id, p.c, CAST(sum(l.t) AS INTEGER) AS n_tokens, string_agg(l.line, chr(10) ORDER BY l.i) AS x
  FROM p JOIN l ON l.doc_id = p.doc_id AND l.i = p.i GROUP BY p.doc_id, p.c)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS INTEGER) AS chunk_idx, n_tokens,
 x AS chunk_text FROM g WHERE n_tokens > 0""",
    "rolling_history": "SELECT conv_id, turn, array_to_string(list(concat(role, ': ', text)) OVER (PARTITION BY"
    " conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), chr(10)) AS history FROM conversations",
    "cosine_pairs": "SELECT id, round(s, 6) AS similarity, round(1 - s, 6) AS distance FROM (SELECT a.vec_id AS id,"
    " list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s"
    " FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)",
    "vector_dim_check": f"SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims, len(embedding) = {DIMS} AS ok"
    " FROM embeddings",
    "vector_text_roundtrip": "SELECT vec_id AS id, round(list_sum(CAST(CAST(CAST(embedding AS VARCHAR) AS FLOAT[])"
    " AS DOUBLE[])), 6) AS total, CAST(CAST(embedding AS VARCHAR) AS FLOAT[]) = embedding AS same FROM embeddings",
    "hash_embed": f"SELECT doc_id, {_numbers('embedding')} AS embedding FROM"
    f" ({_embedding('documents', 'doc_id', 'text')})",
    "knn_exact": "SELECT id, doc_id, chunk_text, round(s, 6) AS similarity, CAST(row_number() OVER"
    " (ORDER BY s DESC, id) AS INTEGER) AS rank FROM (SELECT id, doc_id, chunk_text, list_cosine_similarity("
    f"embedding, CAST({_Q} AS DOUBLE[])) AS s FROM v_embedded WHERE owner = {OWNER}) ORDER BY s DESC, id LIMIT 5",
    "knn_join": "SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM v_ranked",
    "knn_pruned": "SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM v_chunk_ranked",
    "search_report": "r AS (SELECT query_id, string_agg(concat('Result ', CAST(rank AS VARCHAR), ' (Similarity: ',"
    " printf('%.4f', similarity), '):', chr(10), chunk_text), chr(10) || chr(10) ORDER BY rank) AS report"
    " FROM v_chunk_ranked GROUP BY query_id)"
    f" SELECT c.id AS query_id, c.owner, coalesce(r.report, '{NOTHING_FOUND}') AS report"
    " FROM v_chunks c LEFT JOIN r ON r.query_id = c.id",
    "ingest_batch": f"e AS ({_embedding('v_split', 'doc_id, chunk_idx', 'chunk_text')})"
    " SELECT sha256(concat(CAST(s.doc_id AS VARCHAR), ':', CAST(s.chunk_idx AS VARCHAR))) AS id, s.doc_id,"
    f" s.chunk_idx, s.chunk_text, {_numbers('e.embedding')} AS embedding FROM v_split s JOIN e"
    " ON e.doc_id = s.doc_id AND e.chunk_idx = s.chunk_idx",
    "decimate": "SELECT signal_id, n, sample, n * 16000 // 48000 AS k FROM v_signal"
    " WHERE n * 16000 // 48000 > (n - 1) * 16000 // 48000",
    "block_mean": """b AS (SELECT signal_id, max(n) AS len, unnest(range(0, CAST(floor(max(n) / 2.75625 + 0.5) AS BIGINT)))
 AS block FROM v_signal GROUP BY signal_id)
 SELECT b.signal_id, b.block, round(avg(s.sample), 6) AS mean FROM b JOIN v_signal s ON s.signal_id = b.signal_id
 AND s.n - 1 >= floor(b.block * 2.75625 + 0.5) AND s.n - 1 < floor((b.block + 1) * 2.75625 + 0.5)
 GROUP BY b.signal_id, b.block""",
    "quantise": f"SELECT signal_id, n, CAST({_quantised('sample * 4')} AS INTEGER) AS value,"
    " CAST(trunc(greatest(-1.0, least(1.0, sample * 4)) * CASE WHEN sample < 0 THEN 32768 ELSE 32767 END) AS INTEGER)"
    " AS value_split FROM v_signal",
    "frames": "SELECT signal_id, (n - 1) // 20 AS frame, string_agg(CAST(CAST("
    f"{_quantised('sample')} AS INTEGER) AS VARCHAR), ',' ORDER BY n) AS samples FROM v_signal"
    " GROUP BY 1, 2 HAVING count(*) = 20",
    "pcm_roundtrip": f"""q AS (SELECT signal_id, n, CAST({_quantised('sample')} AS INTEGER) AS v FROM v_signal)
 SELECT signal_id, (n - 1) // 20 AS frame,
 to_base64(unhex(string_agg(printf('%02x%02x', v & 255, (v >> 8) & 255), '' ORDER BY n))) AS data,
 round(sum(v / 32768.0), 6) AS total FROM q GROUP BY 1, 2 HAVING count(*) = 20""",
    "tool_priority": f"SELECT call_id, tool, {_MODE} AS mode FROM v_calls",
    "tool_analytics": _ANALYTICS_TOOL + " WHERE true",
    "tool_search": f"{_TERMS}, {_FOUND}, {_REPORTS} {_SEARCH_TOOL}",
    "tool_dispatch": f"""{_TERMS}, {_FOUND}, {_REPORTS}, t AS (
 SELECT call_id, status, result FROM ({_ANALYTICS_TOOL} WHERE c.tool = 'query_user_analytics')
 UNION ALL SELECT call_id, status, result FROM ({_SEARCH_TOOL} WHERE c.tool = 'rag_knowledge_search')
 UNION ALL SELECT call_id, 'UNSUPPORTED', concat('Error: Tool ''', tool, ''' is not supported.') FROM v_calls
 WHERE tool NOT IN ('query_user_analytics', 'rag_knowledge_search'))
 SELECT c.call_id, c.tool, {_MODE} AS mode, CASE WHEN c.tool = 'rag_knowledge_search' AND NOT has_query
 THEN 'query' ELSE '' END AS missing, t.status, t.result FROM v_calls c JOIN t ON t.call_id = c.call_id""",
}


def _needed(sql: str) -> list[str]:
    """The views a statement uses, directly or through others, in order of definition."""
    wanted: set[str] = set()

    def visit(body: str) -> None:
        for name, view in VIEWS.items():
            if name not in wanted and name in body:
                wanted.add(name)
                visit(view)

    visit(sql)
    return [name for name in VIEWS if name in wanted]


_SQL |= {f"{name}_cut": _SQL[name] for name in (
    "interaction_gaps", "response_latency", "status_transitions", "token_bucket", "rolling_history"
)}
_SQL |= {
    "message_topics": "SELECT m.conv_id * 100000 + m.turn AS id, b.topic FROM conversations m LEFT JOIN (SELECT conv_id,"
    " turn, arg_min(topic, (-n, topic)) AS topic FROM (SELECT conv_id, turn, topic, count(*) AS n FROM (SELECT conv_id,"
    " turn, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM conversations) JOIN (VALUES"
    " ('the', 'english'), ('and', 'english'), ('der', 'german'), ('und', 'german'), ('les', 'french'),"
    " ('que', 'romance')) k(word, topic) USING (word) GROUP BY ALL) GROUP BY ALL) b"
    " ON b.conv_id = m.conv_id AND b.turn = m.turn",
    "engagement_gaps": "SELECT user_id, round(avg(CASE WHEN nxt IS NOT NULL THEN least((epoch_us(nxt) -"
    " epoch_us(created_at)) / 1e6, 3600.0) END), 6) AS avg_duration, count(id) AS total_interactions FROM (SELECT *,"
    " lead(created_at) OVER (PARTITION BY user_id ORDER BY created_at, id) AS nxt FROM v_logs) GROUP BY user_id",
    "cascade_survivors": "SELECT 'customer' AS \"table\", CAST(c_custkey AS BIGINT) AS key, 0 AS line FROM customer WHERE"
    " c_acctbal >= 0 UNION ALL SELECT 'orders', CAST(o_orderkey AS BIGINT), 0 FROM orders WHERE o_custkey NOT IN (SELECT"
    " c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT 'lineitem', CAST(l_orderkey AS BIGINT),"
    " CAST(l_linenumber AS INTEGER) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey"
    " IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))",
    "display_status": "SELECT doc_id AS id, doc_id % 15 AS user_id, lower(coalesce(s.status, 'PENDING')) AS status FROM"
    " documents LEFT JOIN (SELECT doc_id AS d, arg_max(status, (ts, seq)) AS status FROM v_status_log GROUP BY 1) s"
    " ON s.d = doc_id",
    "topics_as_text": "SELECT user_id, top_topics FROM v_analytics",
    "analytics_rows": "SELECT user_id, CAST(total_interactions AS INTEGER) AS total_interactions, top_topics,"
    " last_updated_at FROM v_analytics WHERE user_id IS NOT NULL",
    "analytics_rejected": "SELECT NULL::BIGINT AS user_id, CAST(sum(n) AS BIGINT) AS total_interactions,"
    " CAST(to_json(list(topic ORDER BY n DESC, topic) [1:2]) AS VARCHAR) AS top_topics, max(last_at) AS last_updated_at"
    " FROM (SELECT topic, count(*) AS n, max(created_at) AS last_at FROM v_logs WHERE id % 97 = 0 GROUP BY topic)",
    "secured_calls": f"SELECT c.call_id, c.user_id, CASE WHEN {_HAS.format('can_query_analytics')} THEN 'OK' ELSE 'DENIED'"
    f" END AS status, CASE WHEN {_HAS.format('can_query_analytics')} THEN c.tool ELSE"
    f" {_DENIED.format('can_query_analytics')} END AS result FROM v_calls c LEFT JOIN v_perms p ON p.user_id = c.user_id",
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for key, sql in _SQL.items():
        ctes = [f"{name} AS ({VIEWS[name]})" for name in _needed(sql)]
        plain = sql.lstrip().upper().startswith("SELECT")
        if plain:
            prefix = f"WITH {', '.join(ctes)} " if ctes else ""
        else:
            prefix = "WITH RECURSIVE " + "".join(c + ", " for c in ctes)
        out[key] = prefix + sql
    return out
