import hashlib
import string

import duckdb
from llm_tables import FOLDER, of
from pyspark.sql import functions as F

from parley.llm import exact, oracles, queries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, pick):
    groups = {}
    for doc, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = pick(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_edge_rows_against_brute_force(edge):
    pairs = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    for largest, pick in ((False, min), (True, max)):
        assert of(exact.exact_dedup(edge, largest=largest), *COLUMNS) == brute(pairs, pick)


def test_collisions_are_told_apart_by_bytes(edge, docs):
    weak = lambda text: F.length(text) % 3
    for df in (edge, docs):
        assert of(exact.exact_dedup(df, hasher=weak), *COLUMNS) == of(exact.exact_dedup(df), *COLUMNS)


def test_one_row_per_text_stays_with_its_columns(edge):
    kept = exact.deduplicated(edge)
    assert kept.columns == edge.columns
    texts = [(r["text"] or "").translate(LOWER) for r in kept.collect()]
    wanted = {(r["text"] or "").translate(LOWER) for r in edge.collect()}
    assert sorted(texts) == sorted(wanted)
    assert {r["doc_id"] for r in kept.collect() if r["text"] and "hello" in r["text"].lower()} == {1}


def test_ids_of_any_type_lose_no_group(spark):
    rows = [("007", "same text"), ("08", "same text"), ("9", "another"), ("x", "no number"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert of(exact.deduplicated(df), "doc_id") == [(None,), ("007",), ("9",), ("x",)]
    for kind in ("double", "decimal(12,2)", "int"):
        numbers = spark.createDataFrame([(7, "same text"), (8, "same text"), (9, "another")], "doc_id int, text string")
        found = exact.deduplicated(numbers.withColumn("doc_id", F.col("doc_id").cast(kind)))
        assert sorted(int(r["doc_id"]) for r in found.collect()) == [7, 9]


def test_empty_table(none):
    assert exact.exact_dedup(none).count() == 0
    assert exact.deduplicated(none).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    sql = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracles.oracle_sql()['op4_exact_dedup']})").fetchall()
    ours = of(queries.queries()["op4_exact_dedup"](spark, FOLDER), *COLUMNS)
    assert ours == sorted(sql, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_no_python_in_the_plan(docs):
    plan = exact.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
