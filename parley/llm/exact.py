"""Exact deduplication: groups by a 128-bit hash of the text, compared byte by byte.

Three aggregations and one join on small rows; built-in functions only.

1. ``(hash, text)`` is the grouping key, so that Spark compares the bytes of all texts with the same hash. Copies
   meet map-side: a text that fills a third of the table leaves each task once.
2. Texts are dropped at once: a *class* (one distinct text) keeps its hash, its digest, the id that stays and its
   size. Classes are written to the shared folder.
3. Documents take the values of their class by hash. The join carries no text. A hash that two classes share, a
   collision, is taken out and joined on ``(hash, text)`` instead, which costs nothing when there is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.store import lower_ascii, own_columns, written


def md5_of(text: Column) -> Column:
    """128 bits of a text, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def text_classes(
    docs: DataFrame, largest: bool = False, normalise: Callable[[Column], Column] = lower_ascii, hasher=md5_of
) -> DataFrame:
    """(hash, text, keep_id, group_size): one row per distinct normalised text of ``docs`` (doc_id, text).

    The id that stays is the smallest of the group, or the largest; NULL ids count as members and are never
    chosen while another member has an id. A NULL text counts as empty.
    """
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    pick = F.max if largest else F.min
    return (
        docs.select("doc_id", text.alias("text"))
        .groupBy(hasher(F.col("text")).alias("hash"), "text")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    largest: bool = False,
    normalise: Callable[[Column], Column] = lower_ascii,
    hasher: Callable[[Column], Column] = md5_of,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, hash): one row per row of ``df``.

    Texts are equal when their normalised bytes are equal; NULL is the empty text. ``kept`` marks the row whose id
    is ``keep_id``. Rows that repeat id and text of the kept row are the same document: all are marked kept, see
    ``deduplicated`` for one of them. A group without any id has ``keep_id`` NULL and keeps its rows as one
    document in the same sense. An empty table gives an empty result. Other columns of ``df`` are not read.
    """
    docs = own_columns(df, doc_id=id_col, text=text_col)
    found = text_classes(docs, largest, normalise, hasher)
    values = ["hash", "keep_id", "group_size", "text_sha256"]
    classes = written(found.withColumn("text_sha256", F.sha2(F.col("text"), 256)).select(*values), "classes")
    shared = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")

    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    members = docs.select("doc_id", text.alias("text")).select("doc_id", hasher(F.col("text")).alias("hash"), "text")
    if shared.isEmpty():
        rows = members.select("doc_id", "hash").join(classes, "hash")
    else:
        compared = found.join(shared, "hash", "left_semi").withColumn("text_sha256", F.sha2(F.col("text"), 256))
        rows = (
            members.select("doc_id", "hash")
            .join(classes.join(shared, "hash", "left_anti"), "hash")
            .unionByName(
                members.join(shared, "hash", "left_semi").join(compared, ["hash", "text"]).drop("text")
            )
        )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "hash")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one row per distinct text.

    Of rows that repeat id and text of the kept row any one stays, since they are the same document; ids are compared
    as whole numbers, so 7 and '007' are one id.
    """
    normalise, hasher = options.get("normalise", lower_ascii), options.get("hasher", md5_of)
    stay = exact_dedup(df, id_col, text_col, **options).filter("kept")
    key = F.sha2(normalise(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), 256)
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.coalesce(F.col(f"`{id_col}`").try_cast("long").cast("string"), F.lit("")).alias("id_key"),
        key.alias("text_key"),
    )
    wanted = stay.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), F.col("text_sha256").alias("text_key")
    )
    once = keyed.join(wanted, ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"])
    return once.select("row.*")
