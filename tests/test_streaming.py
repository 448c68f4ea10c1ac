"""Streams against their batch twins, with replays and restarts."""

import datetime as dt
import json
import os
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from parley.operators import access, analytics, integrity, limits, status, vectors
from parley.operators.validate import parse_events
from parley.schemas import role_seeds
from parley.sources import readers, sinks
from parley.streaming import ingestion, stateful

UID = "00000000-0000-0000-0000-{:012d}"


def _event(n, path="/f.pdf"):
    return json.dumps({"doc_id": UID.format(n), "user_id": "u", "file_path": path, "file_name": "f"})


def _write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def _run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def _texts(spark):
    data = [("/one.pdf", "# A\nalpha\n# B\nbeta"), ("/two.pdf", "plain"), ("/f.pdf", "x")]
    return spark.createDataFrame(data, "path string, text string")


def _loader(spark):
    def load(docs):
        return docs.join(_texts(spark), F.col("file_path") == F.col("path"), "left").select("doc_id", "text")

    return load


def test_ingestion_end_to_end_with_restart_and_redelivery(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run():
        events = readers.read_events(spark, "text", {"path": source})
        _run(ingestion.start_ingestion(events, _loader(spark), out, mark))

    _write(source, "1.json", [_event(1, "/one.pdf"), _event(2, "/missing.pdf"), "{bad", _event(1, "/one.pdf")])
    run()
    _write(source, "2.json", [_event(3, "/two.pdf"), _event(1, "/one.pdf"), '{"doc_id": "x"}'])
    run()
    run()  # nothing new

    chunks = ingestion.stored_chunks(spark, out)
    got = rows(chunks.select("doc_id", "chunk_idx", "chunk_text", "header_1"))
    assert got == [
        (UID.format(1), 0, "# A\nalpha", "A"),
        (UID.format(1), 1, "# B\nbeta", "B"),
        (UID.format(3), 0, "plain", None),
    ]
    assert chunks.filter(F.size("embedding") != 64).count() == 0
    log = ingestion.status_log(spark, out)
    now = {r["doc_id"]: r["status"] for r in status.latest_status(log).collect()}
    assert now == {UID.format(1): "COMPLETE", UID.format(2): "FAILED", UID.format(3): "COMPLETE"}
    bad = ingestion.quarantine(spark, out)
    assert rows(bad.select("reason")) == [("BAD_JSON",), ("MISSING_FIELD",)]


def test_a_batch_may_run_again(spark, tmp_path):
    out = str(tmp_path / "out")
    events = parse_events(spark.createDataFrame([(_event(1, "/one.pdf"),), ("{",)], "value string"))
    for _ in range(2):
        ingestion.process_batch(events, 0, _loader(spark), ingestion.hashed(), out)
    assert ingestion.stored_chunks(spark, out).count() == 2
    assert sinks.read_batches(spark, f"{out}/chunks").count() == 2  # nothing is written twice
    assert ingestion.status_log(spark, out).count() == 3
    assert ingestion.quarantine(spark, out).count() == 1


def test_streams_with_one_target_add_up(spark, tmp_path):
    out = str(tmp_path / "out")
    for n, mark in ((1, "m1"), (2, "m2"), (3, "m1-after-a-reset")):
        source = str(tmp_path / f"in{n}")
        _write(source, "1.json", [_event(n, "/one.pdf")])
        events = readers.read_events(spark, "text", {"path": source})
        _run(ingestion.start_ingestion(events, _loader(spark), out, str(tmp_path / mark)))
    assert {r["doc_id"] for r in ingestion.stored_chunks(spark, out).collect()} == {UID.format(n) for n in (1, 2, 3)}
    assert status.status_transitions(ingestion.status_log(spark, out)).count() == 0


def test_a_failing_embedder_fails_its_document_only(spark, tmp_path):
    out = str(tmp_path / "out")
    lines = [(_event(1, "/one.pdf"),), (_event(2, "/two.pdf"),)]
    events = parse_events(spark.createDataFrame(lines, "value string"))

    def embedder(chunks):
        bad = F.col("chunk_text") == "plain"
        return chunks.withColumn("embedding", F.when(~bad, F.array(F.lit(1.0).cast("float"))))

    for batch_id in (0, 1):  # the second delivery starts anew
        ingestion.process_batch(events, batch_id, _loader(spark), embedder, out)
    log = ingestion.status_log(spark, out)
    now = {r["doc_id"]: r["status"] for r in status.latest_status(log).collect()}
    assert now == {UID.format(1): "COMPLETE", UID.format(2): "FAILED"}
    assert status.status_transitions(log).count() == 0
    assert {r["doc_id"] for r in ingestion.stored_chunks(spark, out).collect()} == {UID.format(1)}


def test_a_model_that_raises_fails_the_text_only(spark, tmp_path):
    def factory():
        def predict(texts):
            if any(t == "plain" for t in texts):
                raise ValueError("no embedding")
            return [[float(len(t))] for t in texts]

        return predict

    out = str(tmp_path / "out")
    lines = [(_event(1, "/one.pdf"),), (_event(2, "/two.pdf"),), (_event(3),)]
    events = parse_events(spark.createDataFrame(lines, "value string"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("raising", "one batch")
    ingestion.process_batch(events, 0, _loader(spark), lambda chunks: vectors.embed(chunks, factory), out)
    made = len(jobs.getJobIdsForGroup("raising"))
    spark.sparkContext.setJobGroup("other", "other")
    now = {r["doc_id"]: r["status"] for r in status.latest_status(ingestion.status_log(spark, out)).collect()}
    assert now == {UID.format(1): "COMPLETE", UID.format(2): "FAILED", UID.format(3): "COMPLETE"}
    assert sorted(r["embedding"] for r in ingestion.stored_chunks(spark, out).collect()) == [[1.0], [8.0], [9.0]]
    more = [(_event(n, "/two.pdf" if n % 2 else "/one.pdf"),) for n in range(4, 30)]
    spark.sparkContext.setJobGroup("many", "a batch with many failing documents")
    events = parse_events(spark.createDataFrame(more, "value string"))
    ingestion.process_batch(events, 1, _loader(spark), lambda chunks: vectors.embed(chunks, factory), out)
    assert len(jobs.getJobIdsForGroup("many")) <= made + 3  # jobs do not grow with failures
    spark.sparkContext.setJobGroup("other", "other")


def test_nothing_is_visible_before_the_commit(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    events = parse_events(spark.createDataFrame([(_event(1, "/one.pdf"),), ("{",)], "value string"))

    class Lost(Exception):
        pass

    def stopped(*_):
        raise Lost

    # The process dies after all outputs were written and before the commit.
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", stopped)
        with pytest.raises(Lost):
            m.setattr(sinks, "is_committed", lambda *a: False)
            m.setattr(ingestion, "is_committed", lambda *a: False)
            ingestion.process_batch(events, 0, lambda docs: docs.select("doc_id", F.lit("# A\nb").alias("text")), ingestion.hashed(), out)
    assert sinks.read_batches(spark, f"{out}/chunks").count() > 0
    for name in ("chunks", "status_ended", "quarantine"):
        assert sinks.read_committed(spark, out, name).count() == 0
    # The batch runs again: all of it is visible, and what the lost attempt left behind is not.
    for _ in range(2):
        ingestion.process_batch(events, 0, _loader(spark), ingestion.hashed(), out)
        assert ingestion.stored_chunks(spark, out).count() == 2
        assert sinks.read_committed(spark, out, "status_ended").count() == 1
        assert ingestion.quarantine(spark, out).count() == 1


def _requests(n=300, seed=1):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    data = sorted((rnd.randrange(0, 6000), rnd.choice([1, 1, 2, 3])) for _ in range(n))
    return [(i, u, base + dt.timedelta(seconds=s)) for i, (s, u) in enumerate(data)]


@pytest.fixture
def request_stream(spark, tmp_path):
    """Requests in three files that arrive in time order."""
    data = _requests()
    folder = str(tmp_path / "requests")
    schema = "id long, user_id long, ts timestamp"
    for k in range(3):
        part = spark.createDataFrame(data[k * 100 : (k + 1) * 100], schema).coalesce(1)
        part.write.mode("append").parquet(folder)
        names = [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")]
        for name in names:
            if not os.path.basename(name).startswith("k"):
                os.link(name, os.path.join(folder, f"k{k}.parquet"))
                os.utime(os.path.join(folder, f"k{k}.parquet"), (1_700_000_000 + k, 1_700_000_000 + k))
                os.unlink(name)
    batch = spark.createDataFrame(data, schema)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return stream, batch


def _collect(df, name, mark):
    _run(
        df.writeStream.format("parquet")
        .option("path", name)
        .option("checkpointLocation", mark)
        .trigger(availableNow=True)
        .start()
    )


def test_token_bucket_stream(spark, request_stream, tmp_path):
    stream, batch = request_stream
    out, mark = str(tmp_path / "o"), str(tmp_path / "m")
    _collect(stateful.token_bucket_stream(stream(), 3, 60), out, mark)
    _collect(stateful.token_bucket_stream(stream(), 3, 60), out, mark)  # restart, nothing new
    want = limits.token_bucket(batch, 3, 60)
    cols = ["id", "user_id", "admitted", "credit_us"]
    assert rows(spark.read.parquet(out).select(cols)) == rows(want.select(cols))


def test_ttl_stream(spark, request_stream, tmp_path):
    stream, batch = request_stream
    out = str(tmp_path / "o")
    _collect(stateful.ttl_windows_stream(stream(), "user_id", "ts", 300), out, str(tmp_path / "m"))
    got = spark.read.parquet(out).groupBy("user_id", "anchor_us").agg((F.sum("accesses") - 1).alias("hits"))
    want = limits.ttl_windows(batch, "user_id", "ts", 300)
    assert rows(got) == rows(want.select("user_id", F.unix_micros("window_start"), "hits"))


def test_requests_per_minute_stream(spark, request_stream, tmp_path):
    stream, batch = request_stream
    out = str(tmp_path / "o")
    _collect(stateful.requests_per_minute_stream(stream(), "user_id", "ts", "0 seconds"), out, str(tmp_path / "m"))
    got, want = set(rows(spark.read.parquet(out))), set(rows(limits.requests_per_minute(batch)))
    assert got <= want and len(want - got) <= 3  # only minutes the watermark has not passed


def test_running_counts_equal_the_batch_counts(spark, request_stream, tmp_path):
    stream, batch = request_stream
    target, mark = str(tmp_path / "t"), str(tmp_path / "m")

    def upsert_into(changed, batch_id):
        path = f"{target}/{batch_id}"
        if batch_id:
            changed = integrity.upsert(spark.read.parquet(f"{target}/{batch_id - 1}"), changed, ["user_id"])
        changed.write.mode("overwrite").parquet(path)

    _run(ingestion.interaction_counts_stream(stream(), upsert_into, mark))
    last = max(int(x) for x in os.listdir(target))
    want = analytics.interaction_counts(batch).select("user_id", "total_interactions")
    assert rows(spark.read.parquet(f"{target}/{last}")) == rows(want)


def test_redelivered_events_are_dropped(spark, request_stream, tmp_path):
    stream, batch = request_stream
    twice = stream().unionByName(stream())
    out = str(tmp_path / "o")
    _collect(ingestion.dedupe_stream(twice, "id", "ts"), out, str(tmp_path / "m"))
    assert rows(spark.read.parquet(out)) == rows(batch)


def test_stream_with_static_permissions(spark, request_stream, tmp_path):
    stream, batch = request_stream
    users = spark.createDataFrame([(1, 1), (2, 3)], "id long, role_id int")
    perms = access.user_permissions(users, role_seeds(spark))
    out = str(tmp_path / "o")
    _collect(ingestion.enrich_stream(stream(), perms, "can_write_knowledge"), out, str(tmp_path / "m"))
    assert rows(spark.read.parquet(out)) == rows(access.with_permission(batch, perms, "can_write_knowledge"))
