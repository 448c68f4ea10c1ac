import hashlib

import numpy as np
import pyarrow as pa
import pytest
from frames import plan, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import vectors as VF
from parley.operators import vectors

SCHEMA = "id long, owner long, embedding array<float>"


def _table(spark, n=300, dims=8, seed=1, owners=(0, 0, 1, 2, None)):
    rnd = np.random.RandomState(seed)
    data = []
    for i in range(n):
        v = rnd.normal(size=dims).astype("float32").tolist()
        if i % 20 == 5:
            v = data[i - 5][2]  # an exact copy, for ties
        data.append((i, owners[i % len(owners)], v))
    data.append((n, 0, [0.0] * dims))
    data.append((n + 1, 0, [1.0] * (dims - 1)))
    return data, spark.createDataFrame(data, SCHEMA)


def _brute(data, dims, k):
    usable = [(i, o, np.array(v)) for i, o, v in data if o is not None and len(v) == dims and any(v)]
    out = []
    for qi, qo, q in usable:
        scored = []
        for ci, co, c in usable:
            if co == qo:
                s = float(q @ c / np.linalg.norm(q) / np.linalg.norm(c))
                scored.append((-round(s, 9), ci))
        out += [(qi, ci, r) for r, (_, ci) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("cut", [{}, {"q_rows": 40, "c_rows": 25}, {"c_rows": 7}, {"q_rows": 9}])
def test_knn_join_is_exact_whatever_the_cells(spark, cut):
    data, df = _table(spark)
    hits = vectors.knn_join(df.withColumnRenamed("id", "query_id"), df, 8, 4, **cut)
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in hits.collect()) == _brute(data, 8, 4)


def test_knn_join_with_fewer_chunks_than_k(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [1.0, 1.0])], SCHEMA)
    hits = vectors.knn_join(df.withColumnRenamed("id", "query_id"), df, 2, 5)
    assert rows(hits.select("query_id", "id")) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_pairs_are_ranked_inside_the_tasks(spark):
    _, df = _table(spark, 50)
    p = plan(vectors.knn_join(df.withColumnRenamed("id", "query_id"), df, 8, 4))
    assert "FlatMapCoGroupsInArrow" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_knn_exact(spark):
    data, df = _table(spark)
    docs = df.select("id", F.col("owner").alias("user_id"))
    chunks = df.select("id", F.col("id").alias("doc_id"), F.lit("t").alias("chunk_text"), "embedding")
    query = [1.0, -2.0, 3.0, 0.5, 0.0, 1.0, 1.0, -1.0]
    got = vectors.knn_exact(chunks, docs, query, 0, 5)
    assert "TakeOrderedAndProject" in plan(got)
    q = np.array(query)
    scored = sorted(
        (1 - float(np.array(v, "float64") @ q / np.linalg.norm(v) / np.linalg.norm(q)), i)
        for i, o, v in data
        if o == 0 and len(v) == 8 and any(v)
    )[:5]
    assert [(r["id"], r["rank"]) for r in got.collect()] == [(i, n) for n, (_, i) in enumerate(scored, 1)]


def test_recall_of_the_approximate_search(spark):
    _, df = _table(spark, 400, 16)
    queries = df.withColumnRenamed("id", "query_id")
    exact = vectors.knn_join(queries, df, 16)
    approx = vectors.knn_approx(queries, df, 16)
    assert rows(approx.groupBy("query_id", "id").count().filter("count > 1")) == []
    recall = vectors.ann_recall(approx, exact).first()
    assert recall["recall"] > 0.9 and recall["neighbours"] == exact.count()
    one_cell = rows(approx.select("query_id", "id", "rank"))
    cut = vectors.knn_approx(queries, df, 16, q_rows=5, c_rows=5)
    assert rows(cut.select("query_id", "id", "rank")) == one_cell


def test_owners_of_every_size_are_searched_alike(spark):
    """An owner's neighbours do not change when other owners, or more chunks of others, come along."""
    _, df = _table(spark, 300, 8)
    queries = df.withColumnRenamed("id", "query_id")
    cols = ["query_id", "id", "rank"]
    both = rows(vectors.knn_approx(queries, df, 8).select(cols))
    small = df.filter("owner > 0")
    alone = rows(vectors.knn_approx(small.withColumnRenamed("id", "query_id"), small, 8).select(cols))
    mine = {r["id"] for r in small.collect()}
    assert [r for r in both if r[0] in mine] == alone


def test_recall_over_the_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    given = spark.read.parquet(f"{folder}/embeddings.parquet")
    chunks = given.selectExpr("vec_id AS id", "vec_id % 15 AS owner", "embedding")
    queries = chunks.withColumnRenamed("id", "query_id")
    found = vectors.ann_recall(vectors.knn_approx(queries, chunks, 64), vectors.knn_join(queries, chunks, 64)).first()
    assert found["neighbours"] == 5 * chunks.count() and found["recall"] >= 0.9


def test_distance_edges(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], [0.0, 2.0]), (2, [1.0, 1.0], [2.0, 2.0]), (3, [0.0, 0.0], [1.0, 0.0]), (4, [1.0], [1.0, 2.0]), (5, None, [1.0])],
        "id int, a array<float>, b array<float>",
    )
    got = {r[0]: r[1] for r in df.select("id", VF.cosine_distance(F.col("a"), F.col("b"))).collect()}
    assert got[1] == 1.0 and abs(got[2]) < 1e-12 and got[3] is None and got[4] is None and got[5] is None
    dims = df.select("id", VF.has_dim(F.col("a"), 2)).collect()
    assert [r[1] for r in dims] == [True, True, True, False, False]
    assert df.select(VF.unit(F.col("b"))).first()[0] == [0.0, 1.0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.floats(width=32, allow_nan=False, allow_infinity=False), max_size=6), min_size=1, max_size=8))
def test_vector_text_round_trip(spark, vs):
    df = spark.createDataFrame([(v,) for v in vs], "v array<float>")
    back = df.select(VF.text_to_vector(VF.vector_to_text(F.col("v")))).collect()
    assert [r[0] for r in back] == vs


def test_hash_embed(spark):
    docs = ["a b a", "", "x\ny  z x", "ärger ärger"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, chunk_text string")
    got = {r["id"]: r["embedding"] for r in vectors.hash_embed(df, dims=16).collect()}
    for i, d in enumerate(docs):
        v = np.zeros(16)
        for w in d.split():
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        n = np.linalg.norm(v)
        assert np.allclose(got[i], v / n if n else v, atol=1e-6)


def test_embed_with_a_model(spark):
    def factory():
        def predict(texts):
            return np.array([[float(len(t)), 1.0] for t in texts], dtype="float32")

        return predict

    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, "é")], "id int, chunk_text string").repartition(2)
    got = {r["id"]: r["embedding"] for r in vectors.embed(df, factory).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [1.0, 1.0]}


def _sizes_of_cells(k, schema):
    def run(queries, chunks):
        columns = [[None], [None], [None], [queries.num_rows], [chunks.num_rows]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _cells(spark, k, q_rows, c_rows, owners):
    data = [(i, i % owners, [1.0, float(i)]) for i in range(400)]
    q = spark.createDataFrame(data, "query_id long, owner long, _v array<float>")
    c = spark.createDataFrame(data, "id long, owner long, _v array<float>")
    sizes = vectors.block_sizes(q, ["owner"])
    found = vectors.block_topk(
        q, c, sizes, sizes, ["owner"], k, q_rows, c_rows, cell=_sizes_of_cells, counted=["queries", "chunks"]
    )
    return found.select("queries", "chunks", F.spark_partition_id().alias("task")).collect()


def test_large_blocks_have_their_own_cells_in_many_tasks(spark):
    cells = _cells(spark, 3, 150, 150, owners=2)
    assert len(cells) == 2 * 2 * 2 and sum(r["queries"] * r["chunks"] for r in cells) == 2 * 200 * 200
    assert max(r["queries"] for r in cells) < 150 and max(r["chunks"] for r in cells) < 150
    # Their bytes are few, but their work is not gathered in one task.
    assert len({r["task"] for r in cells}) >= 4


def test_a_cell_holds_fewer_queries_where_more_neighbours_are_wanted(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HITS", 1000)
    assert max(r["queries"] for r in _cells(spark, 20, 20_000, 50_000, owners=1)) < 100
    assert max(r["queries"] for r in _cells(spark, 1, 20_000, 50_000, owners=1)) == 400


def test_the_nearest_of_many_equal_and_odd_vectors():
    rnd = np.random.RandomState(2)
    for n, k in ((30, 5), (700, 5), (5000, 50)):
        c = rnd.normal(size=(n, 6))
        c[n // 2 :: 7] = c[3]
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        q = np.concatenate([c[:20], c[-3:]])
        best, sims = vectors._nearest(q, c, k)
        expected = np.argsort(-(q @ c.T).round(9), axis=1, kind="stable")[:, :k]
        assert (best == expected).all() and np.allclose(sims, np.take_along_axis(q @ c.T, expected, axis=1))
        c[1] = np.nan
        best, _ = vectors._nearest(q[4:8], c, k)
        assert (best == np.argsort(-(q[4:8] @ c.T).round(9), axis=1, kind="stable")[:, :k]).all()


def test_search_report(spark):
    hits = spark.createDataFrame(
        [(1, 2, 0.25, "second"), (1, 1, 0.98765, "first\nline")], "query_id int, rank int, similarity double, chunk_text string"
    )
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r[0]: r[1] for r in vectors.search_report(hits, queries).collect()}
    assert got == {
        1: "Result 1 (Similarity: 0.9877):\nfirst\nline\n\nResult 2 (Similarity: 0.2500):\nsecond",
        2: "No matching knowledge base documents found.",
    }


def test_ingest_batch_keys_are_repeatable(spark):
    docs = spark.createDataFrame([(1, "# a\nb\n# c\nd"), (2, "plain")], "doc_id long, text string")
    first = vectors.ingest_batch(docs).select("id", "doc_id", "chunk_idx")
    assert rows(first) == rows(vectors.ingest_batch(docs.repartition(3)).select("id", "doc_id", "chunk_idx"))
    assert first.count() == 3
