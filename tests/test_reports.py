"""Reports whose texts move once to each part of the queries, against reports from joined hits."""

import time

import numpy as np
from frames import plan, rows
from pyspark.sql import functions as F

from parley.operators import vector_index, vectors
from parley.session import CLEANUP, staged

CHUNKS = "id long, owner long, chunk_text string, embedding array<float>"


def _tables(spark, n=240, dims=8):
    """Chunks around a few directions; some come twice, have no text or a zero vector. Queries repeat and lack ids."""
    rnd = np.random.RandomState(4)
    middles = rnd.normal(size=(6, dims))
    data = []
    for i in range(n):
        v = [0.0] * dims if i % 40 == 7 else (middles[i % 6] + 0.1 * rnd.normal(size=dims)).tolist()
        data.append((i, i % 3, None if i % 30 == 1 else f"text\n{i} " + "é€" * (i % 50), v))
    data += [(5, 2, "another text of chunk 5", data[5][3]), data[8]]
    chunks = spark.createDataFrame(data, CHUNKS)
    extra = [(3, 0, None, data[3][3]), (9, 1, None, data[2][3]), (None, 1, None, data[1][3]), (n + 5, 77, None, data[1][3])]
    asked = chunks.union(spark.createDataFrame(extra, CHUNKS)).withColumnRenamed("id", "query_id").drop("chunk_text")
    return asked, chunks


def test_reports_equal_those_of_joined_hits(spark):
    asked, chunks = _tables(spark)
    near = vector_index.neighbourhoods(asked, 8, rows=25, lists=4)
    hits = vectors.knn_join(asked, chunks, 8, 4)
    queries = asked.select("query_id", "owner")
    expected = rows(vectors.search_report(vectors.hits_with_text(hits, chunks), queries))
    got = vectors.search_report(vectors.hits_with_text(hits, chunks, near), queries, near=near)
    assert rows(got) == expected and len(expected) == asked.count()
    none = vectors.hits_with_text(hits, chunks.limit(0), near)
    assert {r[2] for r in vectors.search_report(none, queries, near=near).collect()} == {vectors.NOTHING_FOUND}
    assert vectors.search_report(vectors.hits_with_text(hits, chunks, near), queries.limit(0), near=near).count() == 0


def test_a_text_moves_once_to_each_part(spark):
    asked, chunks = _tables(spark)
    asked, chunks = asked.dropDuplicates(["query_id"]), chunks.dropDuplicates(["id"])
    hits = vectors.knn_join(asked, chunks, 8, 4).filter("query_id IS NOT NULL")
    near = vector_index.neighbourhoods(asked, 8, rows=1000, lists=4)
    # One for each owner, also for the one without chunks.
    assert near.select("part").distinct().count() == 4
    sent = vectors.hits_with_text(hits, chunks, near)
    assert sent.count() == hits.select("id").distinct().count() < hits.count() / 3
    physical = plan(vectors.search_report(sent, asked.select("query_id", "owner"), near=near))
    # Nothing is dealt out between the texts' way to their parts and the reports.
    assert "REPARTITION" in physical.split("Exchange ")[1]


def test_parts_are_bounded_and_cover_every_query(spark):
    asked, _ = _tables(spark)
    near = vector_index.neighbourhoods(asked, 8, rows=20, lists=4)
    usable = vectors.usable(asked, 8, "query_id", "owner").filter("query_id IS NOT NULL").select("query_id").distinct()
    assert rows(near.select("query_id")) == rows(usable)
    assert max(r["count"] for r in near.groupBy("part").count().collect()) <= 40
    assert vector_index.neighbourhoods(asked.limit(0), 8).count() == 0


def test_reports_that_are_unpacked_one_at_a_time_are_the_same(spark, monkeypatch):
    asked, chunks = _tables(spark)
    near = vector_index.neighbourhoods(asked, 8, rows=100, lists=4)
    hits, queries = vectors.knn_join(asked, chunks, 8, 4), asked.select("query_id", "owner")
    expected = rows(vectors.search_report(vectors.hits_with_text(hits, chunks), queries))
    monkeypatch.setattr(vectors, "REPORT_BYTES", 1)
    assert rows(vectors.search_report(vectors.hits_with_text(hits, chunks, near), queries, near=near)) == expected


def test_longer_texts_make_smaller_parts(spark):
    _, chunks = _tables(spark)
    assert vectors.part_rows(chunks) == vectors.PART_ROWS
    long = chunks.withColumn("chunk_text", F.repeat(F.lit("x"), vectors.PART_BYTES // 100))
    assert vectors.part_rows(long) == 100
    assert vectors.part_rows(chunks.limit(0)) == vectors.PART_ROWS


def test_a_large_owner_is_searched_in_rounds(spark):
    asked, chunks = _tables(spark)
    whole = vectors.knn_join(asked, chunks, 8, 4)
    # Owners have about 80 chunks: four parts, two rounds.
    rounds = vectors.knn_join(asked, chunks, 8, 4, q_rows=30, c_rows=25)
    assert len({f.split("/round-")[1].split("/")[0] for f in rounds.inputFiles() if "/round-" in f}) == 2
    assert rows(rounds.withColumn("similarity", F.round("similarity", 9))) == rows(
        whole.withColumn("similarity", F.round("similarity", 9))
    )


def test_what_a_staged_step_shuffled_is_gone_after_it(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {name for name in names if name.startswith("shuffle_")}

    before = shuffled()
    held = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    left = time.time() + 20
    while shuffled() - before and time.time() < left:
        time.sleep(0.2)
    assert not shuffled() - before
    assert held.count() == 7 and spark.conf.get(CLEANUP, None) is None
