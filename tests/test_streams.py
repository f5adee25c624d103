"""Streams that restart: tails of files, watched jobs and trailing windows."""

import datetime
import os

from pyspark.sql import functions as F

from tenderflow.sources import tail
from tenderflow.streaming import heartbeats, sessions

START = datetime.datetime(2024, 5, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def run(query, name, checkpoint):
    """One run over all that is there, from the checkpoint on."""
    found = query.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    found.awaitTermination()
    return query.sparkSession.table(name).collect()


def test_tail_goes_on_after_a_restart(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs", tmp_path / "out", tmp_path / "checkpoint"
    folder.mkdir()

    def once(idle=900.0):
        query = tail.tailed(spark, f"file://{folder}", idle, 8).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()
        done = spark.read.parquet(str(out)).collect() if out.exists() else []
        new = [r for r in done if (r.path, r.start, r.next, bytes(r.content), r.ended) not in seen]
        seen.update((r.path, r.start, r.next, bytes(r.content), r.ended) for r in done)
        texts = {}
        for r in sorted(new, key=lambda r: (r.path, r.start)):
            name = os.path.basename(r.path)
            texts[name] = texts.get(name, b"") + bytes(r.content)
        return texts, sorted(os.path.basename(r.path) for r in new if r.ended), [r.next for r in new if r.path.endswith("a")]

    seen = set()
    (folder / "a").write_bytes("first line, é".encode())
    (folder / "_hidden").write_bytes(b"no")
    assert once()[0] == {"a": "first line, é".encode()}
    (folder / "a").write_bytes("first line, é and more than eight bytes".encode())
    (folder / "b").write_bytes(b"other")
    texts, _, ends = once()
    assert texts == {"a": b" and more than eight bytes", "b": b"other"} and max(ends) == 40
    assert once()[0] == {}
    (folder / "a").write_bytes(b"anew")
    assert once()[0] == {"a": b"anew"}
    os.utime(folder / "b", (0, 0))
    assert once(100.0)[1] == ["b"] and once(100.0)[1] == []


BEATS = "job string, kind string, status string, at timestamp, generation long, attempts int"


def test_watched_jobs_are_those_that_the_batch_finds(spark, tmp_path):
    """Micro-batches in order of time, the query stopped and started again between them; then the same by `abandoned`."""
    first = [("x", "extract", "running", at(0), 1, 1), ("y", "other", "running", at(0), 1, 3), ("z", "other", "running", at(10), 1, 1), ("d", "other", "running", at(0), 1, 1), ("d", "other", "done", at(20), 1, 1)]
    second = [("z", "other", "running", at(150), 1, 1), ("t", "other", "running", at(301), 1, 1)]
    third = [("y", "other", "running", at(310), 1, 3), ("z", "other", "running", at(320), 1, 1), ("t", "other", "running", at(602), 1, 1), (None, "other", "running", at(1), 1, 1)]
    folder = tmp_path / "in"
    folder.mkdir()
    seen, out = [], {}
    for k, rows in enumerate([first, second, third, [("t", "other", "running", at(603), 1, 1)]]):
        spark.createDataFrame(rows, BEATS).coalesce(1).write.mode("append").parquet(str(folder))
        query = heartbeats.watched_jobs(spark.readStream.schema(BEATS).parquet(str(folder)), ["extract"], "0 seconds")
        sink = query.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        sink.awaitTermination()
        seen += rows
        out[k] = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # y was silent from 0 to 180: dead, as it had three runs; its old worker came back and is fenced
    assert ("y", "dead", 2, at(0)) in out[1] and ("y", "fenced", 1, at(310)) in out[2]
    # x may be silent for 600 seconds; z beat at 150 and at 320, d was done
    assert {r for r in out[3] if r[0] != "t"} == {("y", "dead", 2, at(0)), ("y", "fenced", 1, at(310)), ("x", "requeue", 2, at(0)), ("z", "requeue", 2, at(320))}
    latest = spark.createDataFrame([("x", "extract", "running", at(0), 1, 1), ("y", "other", "running", at(0), 1, 3), ("d", "other", "done", at(20), 1, 1), ("z", "other", "running", at(320), 1, 1)], BEATS).withColumnRenamed("at", "heartbeat")
    batch = sessions.abandoned(latest, F.lit(at(602)), ["extract"])
    assert {(r.job, r.action, r.generation, r.heartbeat) for r in batch.collect()} == {r for r in out[3] if r[1] != "fenced" and r[0] != "t"}


def test_sessions_with_stragglers_are_followed_by_a_run(spark):
    found = spark.createDataFrame([("a", at(0), at(60), 2, 0), ("a", at(100), at(160), 3, 2)], f"{sessions.SCHEMA}, stragglers long")
    assert [tuple(r) for r in sessions.follow_ups(found).collect()] == [("a", at(160), 2)]


def test_trailing_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = [(("b" if k % 3 else "a"), at(3600 * k + 7), k) for k in range(60)] + [("a", at(3600 * 500), 0)]
    schema = "kind string, ts timestamp, amount long"
    (tmp_path / "in").mkdir()
    for part in (rows[:20], rows[20:60], rows[60:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    totals = [F.sum("amount").alias("amount"), F.count("*").alias("n")]
    found = run(sessions.trailing_windows(stream, "ts", ["kind"], totals, 24, late="0 seconds"), "trailing", tmp_path / "checkpoint")
    assert found
    for hour in (24, 40, 61):
        now = at(3600 * hour)
        one = sessions.trailing(spark.createDataFrame(rows[:60], schema), "ts", F.lit(now), 24).groupBy("kind").agg(*totals)
        assert {tuple(r) for r in one.collect()} == {(r.kind, r.amount, r.n) for r in found if r.until == now}
