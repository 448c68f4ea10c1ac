import pytest
from llm_tables import FOLDER, SCHEMA


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def edge(spark):
    """Rows that are easy to get wrong: NULLs, blank and long texts, repeated rows and ids, clashing columns."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "Hello World foo bar baz qux", "en"),
        (2, "hello world foo bar baz qux", "en"),
        (2, "hello world foo bar baz qux", "en"),
        (None, "a text without an id", "en"),
        (None, "a text without an id", None),
        (3, None, "en"),
        (4, "", None),
        (5, " \n\t ", "de"),
        (6, long, "en"),
        (7, "日本語 テキスト <|endoftext|> ü Ü 12 \x00", "ja"),
        (8, "one", "en"),
        (8, "another text of the same id", "en"),
        (9, "1234 5678", "en"),
    ]
    return spark.createDataFrame([(*r, "s", None, *["x"] * 7) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
