"""Jobs on a stream of heartbeats: lost ones are given back after a time of silence, and late writes of lost workers are told."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tenderflow.streaming.sessions import EXTRACT_SILENT, RUNS, SILENT

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that a job which ended or was given up is remembered, to fence late writes.
KEPT = 86_400
HELD = "kind string, generation long, attempts long, beat long, timer long"
FOUND = "job string, action string, generation long, beat long"


class Watch(StatefulProcessor):
    """The newest run of one job, and a timer for the moment at which its silence is too long."""

    def __init__(self, extract_kinds: list[str]):
        self.extract_kinds = extract_kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", HELD)

    def _hold(self, kind: str, generation: int, attempts: int, beat: int | None, timer: int) -> None:
        held = self.job.get()
        if held is not None and held[4] != timer:
            self.handle.deleteTimer(held[4])
        if held is None or held[4] != timer:
            self.handle.registerTimer(timer)
        self.job.update((kind, generation, attempts, beat, timer))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.job.get()
        kind, generation, attempts, beat = held[:4] if held else (None, None, 0, None)
        fresh, latest = False, 0
        for r in sorted(rows, key=lambda r: (r.generation, r.millis)):
            if generation is not None and r.generation < generation:
                yield Row(job=key[0], action="fenced", generation=r.generation, beat=r.millis)
                continue
            again = r.generation == generation and beat is not None
            kind, generation, attempts, fresh, latest = r.kind, r.generation, r.attempts, True, max(latest, r.millis)
            beat = (max(beat, r.millis) if again else r.millis) if r.status == "running" else None
        if fresh:
            silent = EXTRACT_SILENT if kind in self.extract_kinds else SILENT
            self._hold(kind, generation, attempts, beat, latest + 1000 * KEPT if beat is None else beat + 1000 * silent)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, now = self.job.get(), expiredTimerInfo.getExpiryTimeInMs()
        if held is None or held[4] != now:
            return
        kind, generation, attempts, beat, _ = held
        if beat is None:
            self.job.clear()
            return
        yield Row(job=key[0], action="requeue" if attempts < RUNS else "dead", generation=generation + 1, beat=beat)
        self.job.update((kind, generation + 1, attempts, None, now + 1000 * KEPT))
        self.handle.registerTimer(now + 1000 * KEPT)

    def close(self) -> None:
        pass


def watched_jobs(beats: DataFrame, extract_kinds: list[str], late: str = "10 seconds") -> DataFrame:
    """job, action, generation, beat of a stream of beats (job, kind, status, at, generation, attempts).

    A running job whose last beat lies as long before the watermark as its kind may be silent is given back: requeue while runs
    are left, else dead, with the next generation. A beat of an older generation than the job has by then is given out as
    fenced: what that worker still writes must not count. Other states than running end the watch; a job that came to its end
    is forgotten after a day. Rows without job, generation or at are left out. State lives in RocksDB, which this sets where
    the session names no other store.
    """
    spark = beats.sparkSession
    if spark.conf.get(STORE, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)
    rows = beats.where("job IS NOT NULL AND at IS NOT NULL AND generation IS NOT NULL")
    rows = rows.select(F.col("job").cast("string").alias("job"), "kind", "status", "at", F.unix_millis("at").alias("millis"), F.col("generation").cast("long").alias("generation"), F.coalesce(F.col("attempts").cast("long"), F.lit(0)).alias("attempts"))
    found = rows.withWatermark("at", late).groupBy("job").transformWithState(Watch(extract_kinds), FOUND, "append", "eventTime")
    return found.select("job", "action", "generation", F.timestamp_millis("beat").alias("beat"))
