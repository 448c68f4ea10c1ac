"""Exact search with cells and bounds against the search of all pairs."""

import numpy as np
import pytest
from frames import rows

from parley.operators import access, vector_prune, vectors
from parley.plans.views import DIMS, Inputs

SCHEMA = "id long, owner long, embedding array<float>"
HITS = ["query_id", "id", "rank"]


def _asked(df):
    return df.withColumnRenamed("id", "query_id")


def _grouped(n=600, dims=12, seed=3, owners=(0, 0, 1, 2, None)):
    """Vectors around a few directions, with exact copies, zero vectors and one of another length."""
    rnd = np.random.RandomState(seed)
    middles = rnd.normal(size=(9, dims))
    data = []
    for i in range(n):
        v = (middles[rnd.randint(9)] + 0.15 * rnd.normal(size=dims)).astype("float32").tolist()
        if i % 20 == 5:
            v = data[i - 5][2]
        data.append((i, owners[i % len(owners)], v))
    return data + [(n, 0, [0.0] * dims), (n + 1, 0, [1.0] * (dims - 1)), (n + 2, 0, None)]


@pytest.mark.parametrize("cut", [{"axes": 1}, {"lists": 5, "q_rows": 40, "c_rows": 25}])
def test_equals_the_search_of_all_pairs(spark, cut):
    df = spark.createDataFrame(_grouped(), SCHEMA)
    got = vector_prune.knn_pruned(_asked(df), df, 12, 4, **cut)
    assert rows(got.hits.select(HITS)) == rows(vectors.knn_join(_asked(df), df, 12, 4).select(HITS))


def test_grouped_vectors_are_mostly_left_out(spark):
    df = spark.createDataFrame(_grouped(), SCHEMA)
    work = vector_prune.knn_pruned(_asked(df), df, 12, 4, lists=16).work.first()
    assert work["possible"] == 240 * 240 + 2 * 120 * 120
    assert work["compared"] < work["possible"] / 3


def test_queries_go_to_the_parts_they_can_reach(spark):
    df = spark.createDataFrame(_grouped(owners=(0,)), SCHEMA)
    got = vector_prune.knn_pruned(_asked(df), df, 12, 4, lists=16, c_rows=50)
    assert rows(got.hits.select(HITS)) == rows(vectors.knn_join(_asked(df), df, 12, 4).select(HITS))
    work = got.work.first()
    assert work["bounded"] < work["possible"] / 2


def test_vectors_in_all_directions_are_still_exact(spark):
    rnd = np.random.RandomState(5)
    df = spark.createDataFrame([(i, i % 2, rnd.normal(size=32).tolist()) for i in range(300)], SCHEMA)
    got = vector_prune.knn_pruned(_asked(df), df, 32, 3, lists=8)
    assert rows(got.hits.select(HITS)) == rows(vectors.knn_join(_asked(df), df, 32, 3).select(HITS))
    work = got.work.first()
    assert work["compared"] <= work["possible"] == 2 * 150 * 150


def test_equal_vectors_and_repeated_queries(spark):
    same = spark.createDataFrame([(i, 1, [1.0, 2.0, 3.0, 4.0]) for i in range(40)], SCHEMA)
    asked = _asked(same.filter("id < 3").union(same.filter("id = 1")))
    got = vector_prune.knn_pruned(asked, same, 4, 5, c_rows=15).hits
    assert rows(got.select(HITS)) == rows(vectors.knn_join(asked, same, 4, 5).select(HITS))


def test_fewer_chunks_than_k_other_owners_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [1.0, 1.0])], SCHEMA)
    asked = _asked(spark.createDataFrame([(1, 1, [1.0, 0.5]), (2, 7, [1.0, 0.0]), (None, 2, [1.0, 0.0])], SCHEMA))
    got = vector_prune.knn_pruned(asked, df, 2, 5).hits
    assert rows(got.select("query_id", "id")) == [(1, 1), (1, 2), (None, 3)]
    nothing = vector_prune.knn_pruned(asked, df.limit(0), 2)
    assert nothing.hits.count() == 0 and tuple(nothing.work.first()) == (0, 0, 0)
    assert vector_prune.knn_pruned(asked.limit(0), df, 2).hits.count() == 0


def test_less_than_half_of_the_pairs_of_all_documents(spark):
    i = Inputs(spark, "/root/testdata/sf0.01")
    owned = access.chunk_owner(i.chunks, i.owners)
    got = vector_prune.knn_pruned(_asked(owned), owned, DIMS)
    assert rows(got.hits.select(HITS)) == rows(vectors.knn_join(_asked(owned), owned, DIMS).select(HITS))
    work = got.work.first()
    assert work["compared"] < work["possible"] / 2
