"""Document fingerprints: bottom-k sketches of shingle hashes, with built-in functions only.

A sketch is the ascending array of the k smallest distinct hashes of a text's shingles (five words, joined hashes of
the words). Sketches of parts merge into the sketch of the whole, and two of them estimate resemblance,
containment and the number of distinct shingles. A text with fewer than k distinct shingles has all of them in its
sketch, and what two such sketches say is exact.

``edited_fingerprints`` gives every document its successor in ascending order of ids. Documents are dealt into blocks
between quantiles of the ids, each sorted once; the first document of a block is copied to the block before it. So
texts move once, no window holds more than a block, and there is no global order in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.blocks import block_bounds, block_of, id_key
from parley.llm.store import own_columns

K = 128
SHINGLE = 5
_SPACE = " \t\n\x0b\x0c\r"


def with_sketch(df: DataFrame, text: Column, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of a text expression; the steps are columns, so that each is evaluated once."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))
    hashes, grams = F.col("_hashes"), F.col("_grams")
    at = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(shingle)])
    shingles = (
        F.when(F.size(hashes) >= shingle, F.transform(F.sequence(F.lit(0), F.size(hashes) - shingle), at))
        .when(F.size(hashes) > 0, F.array(F.xxhash64(hashes)))
        .otherwise(F.array().cast("array<bigint>"))
    )
    return (
        df.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn("_grams", shingles)
        .withColumn(name, F.slice(F.sort_array(F.array_distinct(grams)), 1, k))
        .drop("_hashes", "_grams")
    )


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """(keys, sketch): the sketch of all parts of each key. Each task passes on k hashes per key at most."""
    hashes = df.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    least = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    kept = hashes.withColumn("_rank", least).filter(F.col("_rank") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """The number of distinct shingles: counted below k, else estimated from the k-th smallest hash."""
    share = (F.element_at(sketch, -1).cast("double") - F.lit(-(2.0**63))) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of common shingles among all of both, 0 to 1; two empty sketches are alike."""
    both = F.array_union(a, b)
    whole = (F.size(a) < k) & (F.size(b) < k)
    seen = F.when(whole, both).otherwise(F.slice(F.sort_array(both), 1, k))
    common = F.size(F.array_intersect(seen, F.array_intersect(a, b)))
    return F.when(F.size(seen) == 0, F.lit(1.0)).otherwise(common / F.size(seen))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of ``a``'s shingles that ``b`` has, 0 to 1; nothing is contained in everything."""
    r, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    share = r * (n + m) / (1 + r) / n
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def as_text(sketch: Column) -> Column:
    """Sixteen hexadecimal digits per hash, in the sketch's order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) in blocks with ``block``, ``border`` and ``key``; border rows end each block.

    A border row is the first row of the next block that has any, for the last block that of the first one.
    NULL ids come first; rows of equal ids follow their texts.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), id_key().alias("key"))
    block = block_of(F.col("key"), block_bounds(keyed, "key", blocks))
    placed = keyed.withColumn("block", block).withColumn("border", F.lit(False))
    # One row per block: as many as the parameters say, whatever the corpus.
    firsts = sorted(tuple(r) for r in placed.groupBy("block").agg(F.min("key")).collect())
    ahead = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    starts = spark.createDataFrame(ahead, "key long, block int")
    border = (
        keyed.join(F.broadcast(starts), "key")
        .groupBy("key", "block")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", "key", "block", F.lit(True).alias("border"))
    )
    return placed.unionByName(border)


def edited_fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, blocks: int | None = None
) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, ...) per row of ``df``.

    The edited text is the text with its last quarter replaced by as many first characters of the next document in
    ascending order of ids, or all of them; after the last document comes the first. NULL texts are empty and have
    an empty fingerprint; a single document is its own successor; repeated rows follow each other; an empty table
    gives an empty result. ``n_shingles`` estimates the distinct shingles, ``next_has`` the share of them that the next
    document has. Other columns of ``df`` are not read.
    """
    placed = with_next(own_columns(df, doc_id=id_col, text=text_col), blocks).repartition("block")
    order = Window.partitionBy("block").orderBy("border", "key", "text")
    own = with_sketch(placed, F.col("text"), "sketch", k)
    follow = (
        own.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_sketch", F.lead("sketch").over(order))
        .filter(~F.col("border"))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("moved", F.floor(F.col("n_chars") / 4).cast("int"))
    )
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("moved")).cast("int"))
    edited = follow.select(
        "doc_id",
        "n_chars",
        "sketch",
        "next_sketch",
        F.concat(kept, F.substring(F.col("next_text"), F.lit(1), F.col("moved"))).alias("edited"),
    )
    both = with_sketch(edited, F.col("edited"), "edited_sketch", k)
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("sketch"), F.col("next_sketch"), k).alias("next_has"),
    )
