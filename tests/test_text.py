import random
import re

import pytest
from frames import plan
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.operators import text


def _chunks(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {}
    for r in text.split_markdown(docs).orderBy("doc_id", "chunk_idx").collect():
        out.setdefault(r["doc_id"], []).append(tuple(r)[2:])
    return [out.get(i, []) for i in range(len(texts))]


def _loop(doc):
    """The header rules as a loop over lines."""
    fence, crumbs, sections = "", [None] * 4, [([None] * 4, [])]
    for line in doc.split("\n"):
        t = line.strip(" \t\r")
        m = re.match(r"^(#{1,4})(?: (.*))?$", t, re.S)
        if not fence and re.match(r"```+[^`]*$|~~~", t):
            fence = t[:3]
        elif fence and t[:3] == fence and not t.strip(fence[0]):
            fence = ""
        elif m and not fence:
            level = len(m[1])
            crumbs = crumbs[: level - 1] + [(m[2] or "").strip(" \t\r")] + [None] * (4 - level)
            sections.append((crumbs, []))
        sections[-1][1].append(line)
    out = [(*c, "\n".join(b).strip(" \t\r\n")) for c, b in sections]
    out = [s for s in out if s[4]]
    return out or [(None, None, None, None, doc)]


CASES = [
    "",
    "   \n\t",
    "no header at all\nsecond line",
    "before\n# One\nbody\n### Three\nx\n## Two\ny\n# Next\nz",
    "# A\n```\n# not a header\n```\n## B",
    "~~~\n# inside\n",
    "```\n# inside\n```\n# outside\n  ```\n## inside again",
    "##### five is body\n#no space\n#\n## \n####  four  ",
    "  ## indented\ntext\n#\ttab is no space",
    "#\n#\n#",
    "a\u0001h# b\n# c\u0001a\nd\u0001",
    "# A\r\nbody\r\n## B\r\n",
    "line # not at a line start\n# yes",
]


def test_header_cases(spark):
    assert _chunks(spark, *CASES) == [_loop(c) for c in CASES]


def test_random_documents(spark):
    rnd = random.Random(3)
    lines = ["# a", "## b", "### c", "#### d", "##### e", "```", "~~~", "", "word", "  # x ", "#", "text # no"]
    lines += ["```x```", "``` sql", "~~~ `x`", "````", " ~~~ "]
    docs = ["\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 30))) for _ in range(300)]
    got = _chunks(spark, *docs)
    assert got == [_loop(d) for d in docs]
    for doc, chunks in zip(docs, got):  # every line with text stands in exactly one chunk
        if any(line.strip() for line in doc.split("\n")):
            kept = [x.strip() for c in chunks for x in c[4].split("\n") if x.strip()]
            assert kept == [x.strip() for x in doc.split("\n") if x.strip()]


def test_null_text_yields_no_chunk(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id int, text string")
    assert text.split_markdown(docs).count() == 0


def _pack(lines, n):
    out = []
    for line in lines:
        size = len(line.split())
        if out and out[-1][0] + size <= n:
            out[-1][0] += size
            out[-1][1].append(line)
        else:
            out.append([size, [line]])
    return [(k, "\n".join(x)) for k, x in out if k]


def test_chunk_tokens(spark):
    rnd = random.Random(5)
    docs = ["\n".join(" ".join("w" * rnd.randrange(0, 9)) for _ in range(rnd.randrange(1, 20))) for _ in range(60)]
    docs += ["", "\n\n", "one two three four five six"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    got = {}
    for r in text.chunk_tokens(df, 5).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["chunk_text"]))
    for i, d in enumerate(docs):
        assert got.get(i, []) == _pack(d.split("\n"), 5)


def test_chunk_tokens_takes_the_delimiter_literally(spark):
    df = spark.createDataFrame([(1, "a.b.c")], "doc_id int, text string")
    assert [r["chunk_text"] for r in text.chunk_tokens(df, 2, ".").collect()] == ["a.b", "c"]


@pytest.mark.parametrize("n", [1, 3, 512])
def test_token_windows(spark, n):
    docs = ["a b  c\nd\te f g", "", "  ", "x"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    got = {}
    for r in text.token_windows(df, n).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk_text"])
    for i, d in enumerate(docs):
        ws = d.split()
        assert got.get(i, []) == [" ".join(ws[j : j + n]) for j in range(0, len(ws), n)]


def _markdown(spark, html):
    return spark.createDataFrame([(html,)], "html string").select(text.html_text("html")).first()[0]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a</p><p>b</p>", "a\n\nb"),
        ("<h1>T</h1><h3 class='x'>U</h3>text", "# T\n\n### U\n\ntext"),
        ("<ul><li>one</li><li>two</li></ul>", "- one\n- two"),
        ("a<!-- <p>no</p> -->b<script>var t='</p>';</script>c<STYLE>p{}</STYLE>", "a b c"),
        ("<nav>x</nav>keep<footer>y</footer>", "keep"),
        ("1 &lt; 2 &amp;&amp; &quot;q&quot; &amp;lt; &#65;&#x42;&#8364;&#128512;", '1 < 2 && "q" &lt; AB€😀'),
        ("&#0; &#xD800; &#1114112;", "� � �"),
        ("&#; &#x; &#99999999999;", "&#; &#x; \ufffd"),
        ("line one\nline   two<br/>three", "line one line two\nthree"),
        ("<title>Name</title><body><p> x </p></body>", "# Name\n\nx"),
        ("", ""),
    ],
)
def test_html(spark, html, want):
    assert _markdown(spark, html) == want


def test_text_operators_stay_in_the_engine(spark):
    docs = spark.createDataFrame([(1, "# a\nb", "<p>")], "doc_id int, text string, html string")
    for df in (
        text.split_markdown(docs),
        text.chunk_tokens(docs),
        text.token_windows(docs),
        text.html_to_markdown(docs.withColumnRenamed("doc_id", "page_id")),
    ):
        p = plan(df)
        assert "Exchange" not in p and "Python" not in p and "Pandas" not in p


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="# \nab`~\t", max_size=40))
def test_the_loop_keeps_all_text(doc):
    kept = "".join(c[4] for c in _loop(doc))
    assert sorted(kept.replace("\n", "").replace(" ", "").replace("\t", "")) == sorted(
        doc.replace("\n", "").replace(" ", "").replace("\t", "")
    )
