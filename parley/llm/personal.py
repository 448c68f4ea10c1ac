"""Personal data by bootstrapped contextual extraction; built-in functions only.

1. *Seeds* are addresses, card and phone numbers that their patterns find and their rules confirm. Texts are matched
   once; what is kept of them are matches, distances and a few words around. A text is known by its hash from there
   on, so copies are looked at once, however many there are.
2. *Mentions* are all tokens with a digit or an at sign. Each has up to three *lexical patterns*: the two words before
   it, the word before it, and the words on both sides. Mentions that hold a seed have the seed's kind.
3. Patterns and values form a graph that is scored in rounds. A pattern's confidence in a kind is the share of the
   values of that kind among the distinct values it meets, where values of other kinds or of a form that the kind
   cannot have count in full against it, and unknown values of a fitting form count in part. A value's score is the
   chance that not all confident patterns which meet it are wrong. Values that score high enough are of that kind in
   the next round, where they support further patterns.
4. Mentions of the values found so are added to the seeds. Scores are whole thousandths, so the order of additions
   does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.store import own_columns, written

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; they end sooner when nothing new is found.
ROUNDS = 4
#: Thousandths: least confidence of a pattern, least score of a value, share by which an unknown value counts against.
LEAST_CONFIDENCE, LEAST_SCORE, UNKNOWN_SHARE = 700, 800, 250
#: Distinct known values that a pattern needs.
LEAST_SUPPORT = 3
#: Characters around a mention in which its neighbouring words are looked for.
AROUND = 80

# The patterns of the four kinds. Possessive steps and the conditions on where a match begins leave out attempts that
# must fail, so that a long run of letters or digits takes linear time; the matches are those of the plain patterns.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = (EMAIL, IP, CARD, PHONE)

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_BREAK = r"\s,;\"'<>|"
#: A token with a digit or an at sign, with the groups of digits that follow it after single spaces.
MENTION = rf"(?<![^{_BREAK}])[^{_BREAK}0-9@]*+[0-9@][^{_BREAK}]*+(?:\x20[(]?[0-9][0-9().-]*+)*+"
#: What a value of a kind looks like at least.
FORMS = (
    r"^[^@]+@[^@]+$",
    r"^[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}$",
    r"^[0-9](?:[\x20-]?[0-9]){11,18}$",
    r"^[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}$",
)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the check of card numbers: every second digit from the right counts twice."""
    back = F.reverse(digits)
    twice = F.translate(back, "0123456789", "0246813579")
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)),
        F.lit(0),
        lambda s, i: s + F.substring(F.when(i % 2 == 0, twice).otherwise(back), i, F.lit(1)).cast("int"),
    )
    return total % 10 == 0


def confirmed(kind: Column, match: Column) -> Column:
    """Whether a match of a kind's pattern keeps the kind's rule."""
    digits = _digits(match)
    n = F.char_length(digits)
    # Only texts of 16 to 19 digits reach the sum.
    card = F.when(n.between(16, 19), luhn(F.when(n.between(16, 19), digits).otherwise("0"))).otherwise(False)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == 2, card)
        .otherwise(n.between(8, 15))
    )


def _holds(text: Column, kind: int) -> Column:
    """Whether a text holds a confirmed match of a kind."""
    inner = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return F.exists(inner, lambda m: confirmed(F.lit(kind), m))


def _found(text: Column, pattern: str, around: int) -> Column:
    """array<struct(gap, match, before, after)>: matches of a pattern, each with the characters since the last one."""
    pieces = F.transform(
        F.split(text, pattern, -1),
        lambda p: F.struct(
            F.char_length(p).alias("gap"),
            (F.right(p, F.lit(around)) if around else F.lit("")).alias("before"),
            (F.left(p, F.lit(around)) if around else F.lit("")).alias("after"),
        ),
    )
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    after = F.transform(pieces, lambda p: p["after"])
    return F.zip_with(
        F.arrays_zip(pieces.alias("piece"), matches.alias("match")),
        F.slice(after, F.lit(2), F.greatest(F.size(after) - 1, F.lit(0))),
        lambda x, tail: F.struct(
            x["piece"]["gap"].alias("gap"), x["match"].alias("match"), x["piece"]["before"].alias("before"), tail.alias("after")
        ),
    )


_HIT = "array<struct<gap:int,match:string,before:string,after:string>>"


def matched(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, kind0 .. kind3, mentions): the matches in each text, one row per row of ``df``.

    ``text_key`` is a hash of the text, NULL where it has neither digit nor at sign and thus no match.
    """
    docs = own_columns(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    some = F.col("text").rlike("[0-9@]")
    has = (F.contains("text", F.lit("@")), F.col("text").rlike(r"[0-9]\.[0-9]"), F.lit(True), F.contains("text", F.lit("+")))
    none = F.array().cast(_HIT)
    hits = [
        F.when(some & h, _found(F.col("text"), p, 0).cast(_HIT)).otherwise(none).alias(f"kind{i}")
        for i, (h, p) in enumerate(zip(has, PATTERNS, strict=True))
    ]
    mentions = F.when(some, _found(F.col("text"), MENTION, AROUND).cast(_HIT)).otherwise(none).alias("mentions")
    key = F.when(some, F.unhex(F.sha2(F.col("text"), 256))).alias("text_key")
    return docs.select("doc_id", key, *hits, mentions)


def _placed(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows (text_key, kind, number, gap, match, ...) with ``start``; copies of a text count once."""
    rows = rows.filter("match IS NOT NULL").distinct()
    own = Window.partitionBy("text_key", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("match")
    start = F.sum((F.col("gap") + size).cast("long")).over(own) - size
    return rows.select("text_key", "kind", "match", start.alias("start"), *keep)


def base_spans(marked: DataFrame) -> DataFrame:
    """(text_key, kind, start, end): confirmed matches of the four kinds, once per text."""
    rows = None
    for i in range(len(KINDS)):
        own = marked.filter(F.size(f"kind{i}") > 0)
        own = own.select("text_key", F.lit(i).alias("kind"), F.posexplode(f"kind{i}").alias("number", "hit"))
        own = own.select("text_key", "kind", "number", "hit.gap", "hit.match")
        rows = own if rows is None else rows.unionByName(own)
    placed = _placed(rows).filter(confirmed(F.col("kind"), F.col("match")))
    return placed.select("text_key", "kind", "start", (F.col("start") + F.char_length("match")).alias("end"))


def mentions_of(marked: DataFrame) -> DataFrame:
    """(text_key, start, end, value, label, fits, patterns): identifier-like tokens, once per text.

    ``value`` is the trimmed token in lower case as a hash, ``label`` the kind of a seed in it, ``fits`` whether it
    has the form of each kind, ``patterns`` its lexical patterns.
    """
    rows = marked.filter(F.size("mentions") > 0)
    rows = rows.select("text_key", F.lit(-1).alias("kind"), F.posexplode("mentions").alias("number", "hit"))
    placed = _placed(rows.select("text_key", "kind", "number", "hit.*"), "before", "after")
    ahead = F.regexp_extract("match", "^[^0-9A-Za-z+(]+", 0)
    bare = F.regexp_replace(F.regexp_replace("match", "^[^0-9A-Za-z+(]+", ""), "[^0-9A-Za-z]+$", "")
    label = F.lit(None).cast("int")
    for i in reversed(range(len(KINDS))):
        label = F.when(_holds(F.col("match"), i), i).otherwise(label)
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    left = plain(F.regexp_extract("before", r"(\S+)\s*$", 1))
    two = plain(F.regexp_extract("before", r"(\S+\s+\S+)\s*$", 1))
    right = plain(F.regexp_extract("after", r"^\s*(\S+)", 1))
    patterns = F.array(
        F.when(two != "", F.concat(F.lit("2 "), two)),
        F.when(left != "", F.concat(F.lit("1 "), left)),
        F.when((left != "") & (right != ""), F.concat(F.lit("3 "), left, F.lit(" _ "), right)),
    )
    begin = F.col("start") + F.char_length(ahead)
    return placed.select(
        "text_key",
        begin.alias("start"),
        (begin + F.char_length(bare)).alias("end"),
        F.unhex(F.md5(F.lower(bare).cast("binary"))).alias("value"),
        label.alias("label"),
        F.array(*[bare.rlike(f) for f in FORMS]).alias("fits"),
        F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"),
    ).filter("end > start")


def pattern_scores(edges: DataFrame, found: DataFrame | None) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are confident, given the values found so far."""
    if found is None:
        rows = edges.withColumn("kind", F.lit(None).cast("int")).withColumn("score", F.lit(0).cast("long"))
    else:
        rows = edges.join(found, "value", "left")
    sums = []
    for i in range(len(KINDS)):
        known = F.when(F.col("label") == i, 1000).when(F.col("label").isNull() & (F.col("kind") == i), F.col("score"))
        unknown = F.when(F.col("label").isNotNull() | F.col("kind").isNotNull() | ~F.col("fits")[i], 1000)
        same = F.coalesce(F.col("label"), F.col("kind")) == i
        against = F.when(same, 0).otherwise(unknown.otherwise(UNKNOWN_SHARE))
        sums += [F.sum(known.otherwise(0)).alias(f"for{i}"), F.sum(against).alias(f"against{i}")]
    scored = rows.groupBy("pattern").agg(*sums)
    # One more value counts against each pattern, so that few values never make one certain.
    each = F.array(
        *[
            F.struct(
                F.lit(i).alias("kind"),
                F.col(f"for{i}").alias("support"),
                F.expr(f"1000 * for{i} div (for{i} + against{i} + 1000)").alias("confidence"),
            )
            for i in range(len(KINDS))
        ]
    )
    out = scored.select("pattern", F.explode(each).alias("x")).select("pattern", "x.*")
    strong = (F.col("support") >= 1000 * LEAST_SUPPORT) & (F.col("confidence") >= LEAST_CONFIDENCE)
    return out.filter(strong).select("pattern", "kind", "confidence")


def value_scores(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, kind, score) of the unlabelled values that confident patterns meet often enough, one kind each."""
    met = edges.filter("label IS NULL").join(patterns, "pattern").filter(F.get("fits", F.col("kind")))
    # Logarithms in whole millionths: their sum does not depend on the order.
    doubt = F.floor(1e6 * F.log(1 - F.col("confidence") / 1000)).cast("long")
    summed = met.groupBy("value", "kind").agg(F.sum(doubt).alias("doubt"))
    scored = summed.withColumn("score", F.floor(1000 * (1 - F.exp(F.col("doubt") / 1e6))).cast("long"))
    kept = scored.filter(F.col("score") >= LEAST_SCORE)
    best = kept.groupBy("value").agg(F.max(F.struct(F.col("score"), (-F.col("kind")).alias("back"))).alias("best"))
    return best.select("value", (-F.col("best.back")).alias("kind"), F.col("best.score").alias("score"))


def bootstrap(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, score): values without a label that the scored graph of ``mentions`` assigns to a kind."""
    edges = mentions.select("value", "label", "fits", F.explode("patterns").alias("pattern"))
    edges = written(
        edges.groupBy("value", "pattern").agg(F.min("label").alias("label"), F.max("fits").alias("fits")), "pii-edges"
    )
    found, seen = None, -1
    for _ in range(rounds):
        found = written(value_scores(edges, pattern_scores(edges, found)), "pii-values")
        n = found.count()
        if n == seen or n == 0:
            break
        seen = n
    return found


def _apart(spans: DataFrame) -> DataFrame:
    """Base spans, and those other spans that overlap no base span."""
    order = Window.partitionBy("text_key").orderBy("start", "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("text_key").orderBy(F.desc("start"), F.desc("end"))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    placed = spans.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return placed.filter(F.col("base") | free).drop("before", "after")


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def personal_data(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, spans): one row per row of ``df``; spans (kind, start, end, base) by kind, then start.

    Positions are code points, ends exclusive. ``base`` marks what a kind's own pattern finds; the others come from
    contexts. Equal texts have equal spans and are one witness for a pattern. NULL and empty texts have no spans; rows
    without an id and repeated rows are rows like any other; an empty table gives an empty result. Other columns of
    ``df`` are not read.
    """
    marked = written(matched(df, id_col, text_col), "pii-matches")
    some = marked.filter("text_key IS NOT NULL")
    mentions = written(mentions_of(some), "pii-mentions")
    found = bootstrap(mentions, rounds)
    more = mentions.filter("label IS NULL").join(found, "value").select("text_key", "kind", "start", "end")
    spans = base_spans(some).withColumn("base", F.lit(True)).unionByName(more.withColumn("base", F.lit(False)))
    grouped = (
        _apart(spans)
        .groupBy("text_key")
        .agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("spans"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform("spans", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"], s["end"], s["base"]))
    grouped = grouped.select("text_key", named.cast(_SPANS).alias("spans"))
    empty = F.array().cast(_SPANS)
    held = some.select("doc_id", "text_key").join(grouped, "text_key", "left")
    rest = marked.filter("text_key IS NULL").select("doc_id", empty.alias("spans"))
    return held.select("doc_id", F.coalesce("spans", empty).alias("spans")).unionByName(rest)


def as_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of ``personal_data``'s rows."""
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    digest = F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, as_text(F.col("spans")).alias("spans"))
