"""One registered query per operator of this folder, over whole tables with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    exact,
    language,
    lexical,
    licenses,
    packing,
    personal,
    pieces,
    prefix_trie,
    quality,
    simhash,
    sketches,
    token_files,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _register(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_register
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@_register
def op2_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@_register
def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.edited_fingerprints(table(spark, folder, "documents"))


@_register
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_dedup(table(spark, folder, "documents"), largest=True).drop("hash")


@_register
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@_register
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rate(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_register
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_distance=3)
    return found.select("doc_id", simhash.hex16(F.col("print")).alias("fingerprint"), "component_id")


@_register
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rate(table(spark, folder, "documents"), table(spark, folder, "labels"))


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: each source is a tree of two levels, where every fiftieth file is named LICENSE."""
    return docs.withColumn(
        "path",
        F.expr(
            "concat_ws('/', source, concat('d', doc_id div 1000), concat('e', doc_id div 50),"
            " CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE concat(doc_id, '.txt') END)"
        ),
    )


@_register
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(with_paths(table(spark, folder, "documents")))


@_register
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@_register
def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal.digests(personal.personal_data(table(spark, folder, "documents")))


@_register
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    nodes = prefix_trie.conversation_trie(table(spark, folder, "conversations"))
    return nodes.withColumn("depth", F.col("depth").cast("long"))


@_register
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
