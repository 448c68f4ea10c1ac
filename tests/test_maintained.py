"""The maintained table after batches of additions and retractions against the table made anew."""

import datetime as dt
import os
import random

from frames import rows

from parley.operators import analytics, maintained

LOG = "id long, user_id long, topic string, created_at timestamp"
START = dt.datetime(2024, 1, 1)


def _logs(spark, data):
    return spark.createDataFrame(data, LOG)


def _random_rows(n, seed, first=0):
    rnd = random.Random(seed)
    times = [None, *[START + dt.timedelta(hours=h) for h in range(40)]]
    return [
        (first + i, rnd.choice([1, 1, 1, 2, 3, 4, None]), rnd.choice(["a", "b", "c", None]), rnd.choice(times))
        for i in range(n)
    ]


def _same(spark, path, live):
    want = analytics.user_analytics(_logs(spark, live)) if live else None
    return rows(maintained.current(spark, path)) == (rows(want) if live else [])


def test_any_sequence_of_batches_equals_the_table_made_anew(spark, tmp_path):
    path, live, rnd = str(tmp_path / "t"), [], random.Random(1)
    for number in range(4):
        new = _random_rows(30, number, first=100 * number)
        gone = rnd.sample(live, len(live) // 3)
        live = [r for r in live if r not in gone] + new
        batch = maintained.changes(_logs(spark, new), _logs(spark, gone) if gone else None)
        maintained.apply_batch(batch, number, path, buckets=4)
        assert _same(spark, path, live)
        if number == 2:
            maintained.merge(spark, path, 1)


def test_only_changed_users_are_written_and_a_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(1, 1, "a", START), (2, 1, "b", START + dt.timedelta(days=1)), (3, 2, "a", START), (4, None, None, None)]
    late = [(5, 1, "b", START)]
    second = maintained.changes(_logs(spark, late), _logs(spark, first[1:2]))
    maintained.apply_batch(maintained.changes(_logs(spark, first)), 0, path, buckets=4)
    for _ in range(2):
        maintained.apply_batch(second, 1, path, buckets=4)
        assert rows(spark.read.parquet(f"{path}/table/batch=1").select("user_id")) == [(1,)]
        # The last time falls back to the one before the row that was taken back.
        assert _same(spark, path, [first[0], first[2], first[3], late[0]])
    maintained.merge(spark, path, 1)
    maintained.apply_batch(maintained.changes(None, _logs(spark, [first[0], late[0]])), 2, path, buckets=4)
    assert _same(spark, path, [first[2], first[3]])


def test_early_retractions_empty_batches_and_streams(spark, tmp_path):
    path, row = str(tmp_path / "t"), [(1, 1, "a", START)]
    maintained.apply_batch(maintained.changes(None, _logs(spark, row)), 0, path)
    assert _same(spark, path, [])
    maintained.apply_batch(maintained.changes(_logs(spark, row)).limit(0), 1, path)
    assert _same(spark, path, [])
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    os.makedirs(source)
    maintained.changes(_logs(spark, row * 3)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("user_id long, topic string, created_at timestamp, n long").parquet(source)
    own = str(tmp_path / "own")
    query = stream.writeStream.foreachBatch(maintained.on_batch(own)).option("checkpointLocation", mark)
    query = query.trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert query.exception() is None and _same(spark, own, row * 3)
