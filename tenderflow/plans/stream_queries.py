"""Sessions and jobs over the events and orders tables, as batch forms of what the streams compute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.plans.base import carrier
from tenderflow.sources.tables import Tables
from tenderflow.streaming import sessions

NOW = "2024-01-20 12:00:00"


@carrier("""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  s AS (SELECT user_id, i, ts, ts AS first FROM e WHERE i = 1
    UNION ALL SELECT e.user_id, e.i, e.ts, CASE WHEN e.ts <= least(s.ts + INTERVAL 3600 SECOND, s.first + INTERVAL 7200 SECOND) THEN s.first ELSE e.ts END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
  SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(first) AS started, epoch_us(least(max(ts) + INTERVAL 3600 SECOND, first + INTERVAL 7200 SECOND)) AS due, count(*) AS n FROM s GROUP BY user_id, first""")
def q_capped_sessions(t: Tables) -> DataFrame:
    found = sessions.capped_sessions(t.events.select(F.col("user_id").alias("key"), "ts"), gap=3600, cap=7200)
    return found.select("key", F.unix_micros("started").alias("started"), F.unix_micros("due").alias("due"), "n")


JOBS = """SELECT event_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'running' END AS status, CASE WHEN event_id % 10 = 1 THEN NULL ELSE ts END AS heartbeat, event_id % 5 AS attempts, event_id % 4 AS generation FROM events"""


@carrier(f"""SELECT event_id, CASE WHEN attempts < 3 THEN 'requeue' ELSE 'dead' END AS action, generation + 1 AS generation, CAST(30 * pow(2, greatest(attempts - 1, 0)) AS BIGINT) AS delay FROM ({JOBS})
  WHERE status = 'running' AND (heartbeat IS NULL OR heartbeat <= TIMESTAMP '{NOW}' - CASE WHEN kind = 'purchase' THEN INTERVAL 600 SECOND ELSE INTERVAL 180 SECOND END)""")
def q_abandoned_jobs(t: Tables) -> DataFrame:
    key = F.col("event_id")
    jobs = t.events.select(
        "event_id", F.col("event_type").alias("kind"), F.when(key % 3 == 0, "done").otherwise("running").alias("status"),
        F.when(key % 10 != 1, F.col("ts")).alias("heartbeat"), (key % 5).alias("attempts"), (key % 4).alias("generation"),
    )
    found = sessions.abandoned(jobs, F.lit(NOW).cast("timestamp"), ["purchase"])
    return found.select("event_id", "action", "generation", sessions.retry_delay(F.col("attempts")).alias("delay"))
