"""Text operators: Markdown from HTML, header and token chunks, rolling history.

All but the history work inside one row, with regular expressions and array functions, so the text is
never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.constants import CHUNK_TOKENS
from parley.functions.values import let
from parley.operators.ordered import HOT_ROWS, block_window, split_hot, with_borders, without_borders

BLANKS = " \t\r\n"
SPACE = r"[ \t\r\n\f]+"

# Elements dropped with their content, and named entities with their characters.
DROPPED_ELEMENTS = ("script", "style", "nav", "footer")
BLOCK_ELEMENTS = ("div", "article", "section", "ul", "ol", "table", "tr", "body", "head", "html")
#: Named entities: those of the HTML 4 list and ``&apos;``; a hard space becomes a plain one.
ENTITIES = {name: chr(point) for name, point in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def _code_point(digits: Column, base: int) -> Column:
    """The character of a numeric reference, the replacement character where there is none."""
    bare = F.regexp_replace(digits, "^0+", "")
    number = F.when(F.length(bare) <= 7, F.conv(F.concat(F.lit("0"), bare), base, 10).try_cast("long"))
    known = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")


def _entities(c: Column) -> Column:
    """Decode named and numeric references in one pass: the text is cut before each ``&``, and what a reference
    stands for is not looked at again. Unknown names stay as they are."""
    pattern = r"^&(?:#[xX]([0-9a-fA-F]+)|#([0-9]+)|([A-Za-z][A-Za-z0-9]*));"
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(part: Column) -> Column:
        hexed, plain, name = (F.regexp_extract(part, pattern, i) for i in (1, 2, 3))
        char = (
            F.when(hexed != "", _code_point(hexed, 16))
            .when(plain != "", _code_point(plain, 10))
            .otherwise(F.try_element_at(names, name))
        )
        rest = F.regexp_replace(part, pattern, "")
        return F.when(part.rlike(pattern), F.coalesce(F.concat(char, rest), part)).otherwise(part)

    def parts(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, "(?=&)"), decoded), "")

    return let(c, lambda text: F.when(F.contains(text, F.lit("&")), parts(text)).otherwise(text))


def _deep_headings(c: Column) -> Column:
    for level in range(2, 7):
        c = F.regexp_replace(c, rf"<[hH]{level}\b[^>]*>", "\n\n" + "#" * level + " ")
    return c


def html_text(html: Column) -> Column:
    """Markdown of an HTML page: title and headings, paragraphs, list items; entities decoded.

    Comments and some elements go with their content, all other tags leave their text.
    """
    dropped = "|".join(DROPPED_ELEMENTS)
    c = F.regexp_replace(html, rf"(?is)<!--.*?-->|<({dropped})\b[^>]*>.*?</\1[ \t\r\n]*>", " ")
    c = F.regexp_replace(c, r"[ \t\r\n\f]{2,}|[\t\r\n\f]", " ")
    c = F.regexp_replace(c, r"<(?:(?i:title)|[hH]1)\b[^>]*>", "\n\n# ")
    c = let(c, lambda x: F.when(x.rlike("<[hH][2-6]"), _deep_headings(x)).otherwise(x))
    c = F.regexp_replace(c, r"<[lL][iI]\b[^>]*>", "\n- ")
    c = F.regexp_replace(c, r"<[bB][rR]\b[^>]*>", "\n")
    blocks = "|".join(("title", "h[1-6]", "p", *BLOCK_ELEMENTS))
    c = F.regexp_replace(c, rf"</?(?i:{blocks})\b[^>]*>", "\n\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    c = _entities(c)
    c = F.regexp_replace(c, r" +\n *|\n +", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.trim(c, F.lit(BLANKS))


def html_to_markdown(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", html_text(F.col("html")).alias("markdown"))


def convert_files(
    files: DataFrame, converter_factory: Callable, content: str = "content", out: str = "text"
) -> DataFrame:
    """Text of files by an external converter, loaded once per Python worker.

    ``converter_factory()`` returns a function from bytes to Markdown. A file it cannot convert gets NULL.
    """

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        convert = converter_factory()

        def text(data):
            try:
                return None if data is None else convert(bytes(data))
            except Exception:  # noqa: BLE001  one broken file must not end the job
                return None

        for batch in batches:
            yield batch.map(text)

    return files.withColumn(out, run(F.col(content)))


# ---- chunks by header ---------------------------------------------------------------------------

_MARK = "\u0001"
_HEADER = r"[ \t\r]*#{1,4}(?: [^\n]*|[ \t\r]*)$"
_TITLE = r"^[ \t\r]*#{1,4}([^\n]*)"


def _marked(text: Column) -> Column:
    """The text with a mark before each header line that is not inside a fence.

    The text is cut before every line that can open or close a fence. A block is opened by either kind of fence
    (with back quotes, no further ones may follow on the line) and closed by a bare line of its own kind only, so
    one fold over the parts tells which of them are inside. The mark character itself is escaped first, so any
    text is handled.
    """
    escaped = F.concat(F.lit("\n"), F.replace(text, F.lit(_MARK), F.lit(_MARK + "a")))
    parts = F.split(escaped, r"(?dm)(?=^[ \t\r]*(?:```|~~~))")
    mark = rf"(?dm)^(?={_HEADER})"
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(state: Column, part: Column) -> Column:
        line = F.regexp_extract(part, r"^[ \t\r]*((?:```+|~~~+)[^\n]*)", 1)
        kind = F.substring(line, 1, 3)
        opens = (kind == "~~~") | line.rlike(r"^`+[^`]*$")
        closes = line.rlike(r"^(?:`+|~+)[ \t\r]*$")
        now = (
            F.when((state["open"] == "") & (line != "") & opens, kind)
            .when((state["open"] == kind) & (line != "") & closes, F.lit(""))
            .otherwise(state["open"])
        )
        # A part begins at its fence line; after a closing one its rest is outside again.
        plain = F.regexp_replace(part, mark, _MARK + "h")
        return F.struct(now.alias("open"), F.concat(state["done"], F.array(F.when(now == "", plain).otherwise(part))).alias("done"))

    def marked(all_parts: Column) -> Column:
        whole = F.aggregate(all_parts, start, step, lambda state: F.array_join(state["done"], ""))
        return F.when(F.size(all_parts) > 1, whole).otherwise(F.regexp_replace(all_parts[0], mark, _MARK + "h"))

    return let(parts, marked)


def _clean(c: Column) -> Column:
    """Without marks and outer blanks."""
    return F.trim(F.replace(c, F.lit(_MARK + "a"), F.lit(_MARK)), F.lit(BLANKS))


def _parts(c: Column, level: int) -> Column:
    """Cut at the headers of one level; the part before the first one has no title."""
    title = lambda p: _clean(F.regexp_extract(p, _TITLE, 1))
    cut = F.split(c, _MARK + rf"h(?=[ \t\r]*#{{{level}}}(?!#))")
    return F.transform(cut, lambda p, i: F.struct(F.when(i > 0, title(p)).alias("t"), p.alias("p")))


def markdown_sections(text: Column) -> Column:
    """``array<struct<header_1, header_2, header_3, header_4, chunk_text>>`` in document order.

    Cutting by level 1, then each part by level 2 and so on gives every section the titles it stands
    under: a header of one level ends the parts of all deeper levels.
    """

    def leaf(t1, t2, t3, t4):
        titles = [t["t"].alias(f"header_{i}") for i, t in enumerate((t1, t2, t3, t4), 1)]
        return F.struct(*titles, _clean(t4["p"]).alias("chunk_text"))

    def level4(t1, t2, t3):
        return F.transform(_parts(t3["p"], 4), lambda t4: leaf(t1, t2, t3, t4))

    def level3(t1, t2):
        return F.flatten(F.transform(_parts(t2["p"], 3), lambda t3: level4(t1, t2, t3)))

    def level2(t1):
        return F.flatten(F.transform(_parts(t1["p"], 2), lambda t2: level3(t1, t2)))

    return F.flatten(F.transform(_parts(_marked(text), 1), level2))


def split_markdown(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_idx, header_1..header_4, chunk_text); a document without a chunk yields itself."""
    none = F.lit(None).cast("string")
    whole = F.struct(
        *[none.alias(f"header_{i}") for i in range(1, 5)], F.col(text).alias("chunk_text")
    )
    sections = F.filter(markdown_sections(F.col(text)), lambda s: s["chunk_text"] != "")
    chunks = let(sections, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(whole)))
    return (
        docs.filter(F.col(text).isNotNull())
        .select(key, F.posexplode(chunks).alias("chunk_idx", "_c"))
        .select(key, "chunk_idx", "_c.*")
    )


# ---- chunks by tokens ---------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Tokens of a text: its runs of non-blank characters."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def token_windows(docs: DataFrame, n: int = CHUNK_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Consecutive windows of ``n`` tokens."""

    def windows(ws: Column) -> Column:
        last = F.floor((F.size(ws) - 1) / n).cast("int")
        at = F.when(F.size(ws) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda j: F.array_join(F.slice(ws, j * n + 1, F.lit(n)), " "))

    return docs.select(
        key, F.posexplode(let(words(F.col(text)), windows)).alias("chunk_idx", "chunk_text")
    )


def chunk_tokens(
    docs: DataFrame, n: int = CHUNK_TOKENS, delimiter: str = "\n", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Whole lines packed greedily into chunks of at most ``n`` tokens; a longer line stands alone.

    The fold keeps only the first line of each chunk. Chunks without a token are dropped.
    """

    def first_lines(sizes: Column) -> Column:
        start = F.struct(
            F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"), F.lit(0).alias("i")
        )

        def step(acc: Column, size: Column) -> Column:
            fresh = (acc["i"] == 0) | (acc["n"] + size > n)
            starts = F.when(fresh, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"])
            return F.struct(
                starts.alias("starts"),
                F.when(fresh, size).otherwise(acc["n"] + size).alias("n"),
                (acc["i"] + 1).alias("i"),
            )

        return F.aggregate(sizes, start, step, lambda acc: F.concat(acc["starts"], F.array(acc["i"])))

    def chunks(lines: Column) -> Column:
        sizes = F.transform(lines, lambda line: F.size(words(line)))

        def cut(starts: Column) -> Column:
            ends = F.slice(starts, 2, F.size(starts) - 1)
            return F.zip_with(
                F.slice(starts, 1, F.size(starts) - 1),
                ends,
                lambda a, b: F.array_join(F.slice(lines, a + 1, b - a), delimiter),
            )

        return let(first_lines(sizes), cut)

    lines = F.split(F.col(text), "\\Q" + delimiter + "\\E")
    rows = F.transform(
        let(lines, chunks), lambda c: F.struct(F.size(words(c)).alias("n_tokens"), c.alias("chunk_text"))
    )
    kept = F.filter(rows, lambda r: r["n_tokens"] > 0)
    return docs.select(key, F.posexplode(kept).alias("chunk_idx", "_c")).select(key, "chunk_idx", "_c.*")


# ---- conversation buffer ------------------------------------------------------------------------


def rolling_history(turns: DataFrame, n: int, min_rows: int = HOT_ROWS) -> DataFrame:
    """Each turn with the text of the last ``n`` turns up to it, one ``role: text`` line per turn."""
    keys, order = ["conv_id"], ["turn"]
    rows = turns.select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("_line"))
    rows = with_borders(split_hot(rows, keys, F.col("turn"), min_rows), keys, order, before=n - 1)
    frame = block_window(keys, order).rowsBetween(-(n - 1), 0)
    rows = rows.withColumn("history", F.concat_ws("\n", F.collect_list("_line").over(frame)))
    return without_borders(rows).select("conv_id", "turn", "history")
