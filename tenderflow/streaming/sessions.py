"""Sessions with a quiet gap and a hard cap, in batch and on a stream, and jobs that went silent.

A session opens with an event, and is due GAP seconds after its last event, but never later than CAP seconds after its
first: an event at that moment still joins, a later one opens the next session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP, CAP = 60, 300
#: Seconds of a slot in which one task looks for quiet gaps of a key.
SLOT = 86_400
SCHEMA = "key string, started timestamp, due timestamp, n long"
#: Seconds without a heartbeat after which a job counts as abandoned, for extractions and for all others, and runs a job gets.
EXTRACT_SILENT, SILENT, RUNS = 600, 180, 3
RETRY_SECONDS = 30
#: Seconds that a sign-in attempt counts.
TTL = 300


def quiet_pieces(rows: DataFrame, gap: int, slot: int) -> DataFrame:
    """Adds piece to rows (key, at in microseconds): where the run of events without more than the gap between two began.

    Keys are taken apart in slots of time: windows see one slot of a key, and only a slot's first and last event and its last
    cut go on to the window over the whole key. So a key that holds much of all rows is spread over its slots.
    """
    micro = 1_000_000
    rows = rows.withColumn("slot", F.floor(F.col("at") / (slot * micro)))
    inside = W.partitionBy("key", "slot").orderBy("at")
    far = F.col("at") - F.lag("at").over(inside) > gap * micro
    rows = rows.withColumn("cut", F.when(far, F.col("at")))
    ends = rows.groupBy("key", "slot").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.max("cut").alias("cut"))
    slots = W.partitionBy("key").orderBy("slot")
    before = F.lag("high").over(slots)
    ends = ends.withColumn("opens", F.when(before.isNull() | (F.col("low") - before > gap * micro), F.col("low")))
    # where the piece that a slot begins in started
    ends = ends.withColumn("began", F.coalesce("opens", F.last(F.coalesce("cut", "opens"), True).over(slots.rowsBetween(W.unboundedPreceding, -1))))
    latest = F.last("cut", True).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    found = rows.withColumn("latest", latest).join(ends.select("key", "slot", "began"), ["key", "slot"])
    return found.select("key", "at", F.coalesce("latest", "began").alias("piece"))


class Walk:
    """Sessions of one piece after the other, of events in order; a piece may go on in the next batch."""

    def __init__(self, gap: int, cap: int):
        self.gap, self.cap = gap * 1_000_000, cap * 1_000_000
        self.piece: tuple[str, int] | None = None
        self.first = self.last = self.n = 0

    def due(self) -> int:
        return min(self.last + self.gap, self.first + self.cap)

    def closed(self) -> list[tuple[str, int, int, int]]:
        """The session that is open, if any, which ends here."""
        out = [(self.piece[0], self.first, self.due(), self.n)] if self.n else []
        self.n = 0
        return out

    def take(self, key: str, piece: int, at: np.ndarray) -> list[tuple[str, int, int, int]]:
        """The sessions that events of a piece close; events lie no further apart than the gap, so only the cap cuts."""
        out = self.closed() if self.piece != (key, piece) else []
        self.piece, i = (key, piece), 0
        while i < len(at):
            if not self.n:
                self.first = int(at[i])
            end = int(np.searchsorted(at, self.first + self.cap, "right"))
            if end > i:
                self.last, self.n = int(at[end - 1]), self.n + end - i
            if end < len(at):
                out += self.closed()
            i = end
        return out


def capped_sessions(events: DataFrame, gap: int = GAP, cap: int = CAP) -> DataFrame:
    """key, started, due and number of events of every session of events (key, ts).

    Where more than the gap lies between two events no session goes on, so keys are cut there (`quiet_pieces`) and the pieces
    are dealt over tasks. A task goes over its sorted pieces once, a batch of Arrow columns at a time, with one search for
    each session and none for each event; it holds a batch, however long a piece is. Rows without key or ts belong to no session.
    """
    rows = events.where("key IS NOT NULL AND ts IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Walk(gap, cap)
        for batch in batches:
            keys, piece, at = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            code, names = keys.indices.to_numpy(), keys.dictionary.to_pylist()
            edges = np.flatnonzero((code[1:] != code[:-1]) | (piece[1:] != piece[:-1])) + 1
            out: list[tuple] = []
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                out += state.take(names[code[low]], int(piece[low]), at[low:high])
            yield sessions_of(out)
        yield sessions_of(state.closed())

    def sessions_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["key", "started", "due", "n"])

    pieces = quiet_pieces(rows, gap, SLOT).select("key", "piece", "at").repartition("key", "piece").sortWithinPartitions("key", "piece", "at")
    found = pieces.mapInArrow(walk, "key string, started long, due long, n long")
    return found.select("key", F.timestamp_micros("started").alias("started"), F.timestamp_micros("due").alias("due"), "n")


def streamed_sessions(events: DataFrame, gap: int = GAP, cap: int = CAP, late: str = "10 seconds") -> DataFrame:
    """The same of a stream of events (key, ts): a session is given out once the watermark has passed the moment it was due.

    Adds stragglers: events that came for a time at which the key's last session was already given out; they are counted with
    the session in which they arrive, so that a run that missed them can be followed by another.
    """
    rows = events.where("key IS NOT NULL AND ts IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0, 0, 0, 0)
        first, last, n, closed, stragglers = held
        micro = 1_000_000
        done: list[tuple] = []

        def due() -> int:
            return min(last + gap * micro, first + cap * micro)

        def give_out() -> None:
            nonlocal n, closed, stragglers
            done.append((key[0], pd.Timestamp(first, unit="us"), pd.Timestamp(due(), unit="us"), n, stragglers))
            closed, n, stragglers = due(), 0, 0

        times = sorted(int(x.value // 1000) for batch in batches for x in batch["ts"])
        for ts in times:
            if closed and ts <= closed and not n:
                stragglers += 1
            if n and ts > due():
                give_out()
            if not n:
                first, last, n = ts, ts, 1
            else:
                first, last, n = min(first, ts), max(last, ts), n + 1
        watermark = state.getCurrentWatermarkMs()
        if n and watermark * 1000 > due():
            give_out()
        if n:
            state.update((first, last, n, closed, stragglers))
            state.setTimeoutTimestamp(max(due() // 1000 + 1, watermark + 1))
        elif closed:
            # what was given out last is kept for one more cap, to tell stragglers
            state.update((0, 0, 0, closed, stragglers))
            if state.hasTimedOut and watermark * 1000 > closed + cap * micro:
                state.remove()
            else:
                state.setTimeoutTimestamp(max((closed + cap * micro) // 1000 + 1, watermark + 1))
        if done:
            yield pd.DataFrame(done, columns=["key", "started", "due", "n", "stragglers"])

    kept = "first long, last long, n long, closed long, stragglers long"
    return rows.groupBy("key").applyInPandasWithState(step, f"{SCHEMA}, stragglers long", kept, "append", GroupStateTimeout.EventTimeTimeout)


def follow_ups(found: DataFrame) -> DataFrame:
    """key, run_at, stragglers: for sessions of `streamed_sessions` whose events came too late for the run they belonged to, the run that takes them in."""
    return found.where("stragglers > 0").select("key", F.col("due").alias("run_at"), "stragglers")


def trailing(rows: DataFrame, when: str, now: Column, hours: int) -> DataFrame:
    """The rows of the last hours before now."""
    start = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) - hours * 3_600_000_000)
    return rows.where((F.col(when) >= start) & (F.col(when) < now))


def trailing_windows(rows: DataFrame, when: str, keys: list[str], totals: list[Column], hours: int, every: int = 1, late: str = "10 minutes") -> DataFrame:
    """keys, until and totals over the `hours` before each moment `until`, which come every few hours: on a stream as soon as the watermark is past it.

    Each row counts in hours / every windows, which bounds the state: what the watermark has passed is let go.
    """
    window = F.window(when, f"{hours} hours", f"{every} hours")
    return rows.withWatermark(when, late).groupBy(window, *keys).agg(*totals).withColumn("until", F.col("window.end")).drop("window")


def abandoned(jobs: DataFrame, now: Column, extract_kinds: list[str]) -> DataFrame:
    """Running jobs (kind, status, heartbeat, attempts, generation) whose heartbeat is missing or too old.

    action is requeue while runs are left, else dead; generation is one higher, so that what the lost worker still writes can be told.
    """
    window = F.when(F.col("kind").isin(extract_kinds), EXTRACT_SILENT).otherwise(SILENT)
    silent = F.col("heartbeat").isNull() | (F.unix_micros(F.col("heartbeat").cast("timestamp")) <= F.unix_micros(now) - window * 1_000_000)
    found = jobs.where((F.col("status") == "running") & silent)
    return found.withColumn("action", F.when(F.col("attempts") < RUNS, "requeue").otherwise("dead")).withColumn("generation", F.col("generation") + 1)


def fenced(writes: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Writes (key, generation, ...) of the generation that the job has now; late ones of lost workers go."""
    return writes.join(jobs.select(key, "generation"), [key, "generation"], "left_semi")


def retry_delay(attempts: Column) -> Column:
    """Seconds before the next run: doubling from RETRY_SECONDS, from the first attempt on."""
    return (RETRY_SECONDS * F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0)))).cast("long")


def tail(lines: DataFrame, offset: Column) -> DataFrame:
    """What is new in files (path, content) since an offset in bytes: all of it where the file is shorter than that, as it began anew.

    Adds text (the new part) and next (the offset to go on from).
    """
    size = F.octet_length("content")
    start = F.when(size < offset, 0).otherwise(offset)
    return lines.withColumn("text", F.substr(F.col("content").cast("binary"), start + 1, size).cast("string")).withColumn("next", size)


def live_attempts(attempts: DataFrame, key: str, when: str, ttl: int = TTL) -> DataFrame:
    """Adds live: attempts of the key up to this one that have not expired, that is, that are less than `ttl` seconds old."""
    recent = W.partitionBy(key).orderBy(F.unix_micros(F.col(when).cast("timestamp"))).rangeBetween(1 - ttl * 1_000_000, 0)
    return attempts.withColumn("live", F.count("*").over(recent))


def streamed_attempts(attempts: DataFrame, key: str, when: str, ttl: int = TTL, late: str = "10 seconds") -> DataFrame:
    """key, started, n: attempts by windows of `ttl` seconds; the watermark lets the state of a window go once it has expired."""
    window = F.window(when, f"{ttl} seconds")
    return attempts.withWatermark(when, late).groupBy(window, key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("started"), "n")
