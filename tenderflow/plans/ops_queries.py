"""Operational queries on events as jobs and runs: spend, durations, gaps, latest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenderflow.functions import money as m
from tenderflow.operators import history
from tenderflow.plans.base import carrier, places, total
from tenderflow.sources.tables import Tables

JOBS = """SELECT event_id, ts, user_id AS project, event_type AS type, value AS cost, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' WHEN 2 THEN 'dead' ELSE 'done' END AS status FROM events"""
STATUS = {0: "queued", 1: "failed", 2: "dead"}


def jobs(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.coalesce(m.lookup(k % 5, STATUS), F.lit("done"))
    return t.events.select("event_id", "ts", F.col("user_id").alias("project"), F.col("event_type").alias("type"), F.col("value").alias("cost"), k.alias("k"), status.alias("status"))


def finished_parts() -> list[Column]:
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status").isin("failed", "dead"))
    return [F.count("*").alias("total"), done.alias("done"), failed.alias("failed"), F.round(failed / F.nullif(done + failed, F.lit(0)), 3).alias("failure_rate")]


SPEND = f"{total('round(CAST(cost AS DECIMAL(18,4)), 2)')} AS spend, count(*) AS n"


def spend() -> list[Column]:
    return [m.exact_sum(F.col("cost")).alias("spend"), F.count("*").alias("n")]


@carrier(f"SELECT {SPEND} FROM ({JOBS}) WHERE cost IS NOT NULL")
def q_spend_total(t: Tables) -> DataFrame:
    return jobs(t).where("cost IS NOT NULL").agg(*spend())


@carrier(f"SELECT type, {SPEND} FROM ({JOBS}) WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 168 HOUR GROUP BY ALL")
def q_spend_by_type(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").alias("newest"))
    recent = jobs(t).join(F.broadcast(newest), F.col("ts") > F.col("newest") - F.expr("INTERVAL 168 HOURS"))
    return recent.groupBy("type").agg(*spend())


@carrier(f"SELECT project, {SPEND} FROM ({JOBS}) GROUP BY ALL ORDER BY spend DESC, project LIMIT 50")
def q_spend_by_project(t: Tables) -> DataFrame:
    return jobs(t).groupBy("project").agg(*spend()).orderBy(F.desc("spend"), "project").limit(50)


FAILED = "count(*) FILTER (WHERE status IN ('failed', 'dead'))"
DONE = "count(*) FILTER (WHERE status = 'done')"


@carrier(f"""SELECT type, count(*) AS total, {DONE} AS done, {FAILED} AS failed, {places(f"CAST({FAILED} AS DOUBLE) / nullif({DONE} + {FAILED}, 0)", 3)} AS failure_rate,
  min(ts) FILTER (WHERE status = 'queued') AS oldest_queued, {places("avg(k) FILTER (WHERE status = 'done')", 1)} AS avg_seconds FROM ({JOBS}) GROUP BY ALL""")
def q_job_metrics(t: Tables) -> DataFrame:
    seconds = F.round(F.avg(F.when(F.col("status") == "done", F.col("k"))), 1)
    oldest = F.min(F.when(F.col("status") == "queued", F.col("ts")))
    return jobs(t).groupBy("type").agg(*finished_parts(), oldest.alias("oldest_queued"), seconds.alias("avg_seconds"))


@carrier(f"""SELECT project, count(*) AS total, {DONE} AS done, {FAILED} AS failed, {places(f"CAST({FAILED} AS DOUBLE) / nullif({DONE} + {FAILED}, 0)", 3)} AS failure_rate FROM ({JOBS}) GROUP BY ALL""")
def q_failure_rate(t: Tables) -> DataFrame:
    return jobs(t).groupBy("project").agg(*finished_parts())


@carrier(f"SELECT event_id, ts, project FROM ({JOBS}) WHERE status = 'queued' ORDER BY ts, event_id LIMIT 1")
def q_oldest_open(t: Tables) -> DataFrame:
    return jobs(t).where("status = 'queued'").orderBy("ts", "event_id").limit(1).select("event_id", "ts", "project")


@carrier(f"SELECT event_id, ts, type FROM ({JOBS}) WHERE status = 'failed' ORDER BY ts, event_id LIMIT 500")
def q_oldest_first(t: Tables) -> DataFrame:
    return jobs(t).where("status = 'failed'").orderBy("ts", "event_id").limit(500).select("event_id", "ts", "type")


@carrier(f"SELECT count(*) AS n FROM ({JOBS}) WHERE status = 'dead' AND k >= 50")
def q_filtered_count(t: Tables) -> DataFrame:
    return jobs(t).where("status = 'dead' AND k >= 50").agg(F.count("*").alias("n"))


@carrier("SELECT nullif(p_type, 'PROMO') AS division, count(*) AS n FROM part GROUP BY ALL")
def q_count_by_division(t: Tables) -> DataFrame:
    return t.part.groupBy(F.nullif("p_type", F.lit("PROMO")).alias("division")).agg(F.count("*").alias("n"))


@carrier(f"SELECT project, status, count(*) AS n FROM ({JOBS}) GROUP BY ALL")
def q_counts_by_project(t: Tables) -> DataFrame:
    return jobs(t).groupBy("project", "status").agg(F.count("*").alias("n"))


@carrier("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NULL GROUP BY ALL")
def q_status_counts(t: Tables) -> DataFrame:
    base = F.nullif("o_orderpriority", F.lit("5-LOW")).isNull()
    return t.orders.where(base).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@carrier(f"""SELECT count(*) AS total, count(*) FILTER (WHERE type = 'click') AS corrections, count(*) FILTER (WHERE status = 'queued') AS pending,
  count(*) FILTER (WHERE status = 'done') AS learned FROM ({JOBS})""")
def q_feedback_counts(t: Tables) -> DataFrame:
    when = {"corrections": F.col("type") == "click", "pending": F.col("status") == "queued", "learned": F.col("status") == "done"}
    return jobs(t).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in when.items()])


@carrier("SELECT user_id, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL")
def q_p95(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@carrier(f"""WITH g AS (SELECT user_id, date_diff('millisecond', lag(date_trunc('millisecond', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), date_trunc('millisecond', ts)) AS gap FROM events)
  SELECT user_id, {places("avg(gap)", 3)} AS mean_gap_ms FROM g GROUP BY ALL""")
def q_mean_gap(t: Tables) -> DataFrame:
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    gap = ms - F.lag(ms).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.round(F.avg("gap"), 3).alias("mean_gap_ms"))


@carrier(f"""SELECT user_id, {places("CAST(sum(CASE WHEN event_type = 'view' THEN k ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN event_type IN ('view', 'click') THEN k ELSE 0 END), 0)", 4)} AS hit_ratio
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL""")
def q_hit_ratio(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    read = F.sum(F.when(F.col("event_type") == "view", k).otherwise(0))
    both = F.sum(F.when(F.col("event_type").isin("view", "click"), k).otherwise(0))
    return t.events.groupBy("user_id").agg(F.round(F.try_divide(read, both), 4).alias("hit_ratio"))


@carrier("SELECT user_id, arg_max(event_type, (value, event_id)) AS model FROM events GROUP BY ALL")
def q_argmax_last(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("model"))


@carrier("SELECT event_type, coalesce(max(strftime(ts, '%Y-%m-%d %H:%M')), '') AS watermark FROM events GROUP BY ALL")
def q_watermark(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.coalesce(F.max(F.date_format("ts", "yyyy-MM-dd HH:mm")), F.lit("")).alias("watermark"))


@carrier(f"SELECT project, event_id, status FROM ({JOBS}) QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) = 1")
def q_latest_per_key(t: Tables) -> DataFrame:
    return history.first_per_key(jobs(t), ["project"], [F.desc("ts"), F.desc("event_id")]).select("project", "event_id", "status")


@carrier("SELECT conv_id, turn, length(text) AS n FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1")
def q_last_event_per_key(t: Tables) -> DataFrame:
    found = history.first_per_key(t.conversations.where("role = 'assistant'"), ["conv_id"], [F.desc("turn"), F.desc("text")])
    return found.select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@carrier(f"""WITH x AS (SELECT project, type, arg_max(k, (ts, event_id)) AS k FROM ({JOBS}) GROUP BY ALL)
  SELECT project, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most, count(*) FILTER (WHERE k >= 50) AS cold FROM x GROUP BY ALL""")
def q_cold_prefix(t: Tables) -> DataFrame:
    last = jobs(t).groupBy("project", "type").agg(F.max_by("k", F.struct("ts", "event_id")).alias("k"))
    return last.groupBy("project").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"), F.count_if(F.col("k") >= 50).alias("cold"))


@carrier(f"""SELECT type, count(*) AS calls, max(k) AS most, CAST(sum(k) AS BIGINT) AS total, CAST(quantile_disc(k, 0.95) AS BIGINT) AS p95, count(DISTINCT project) AS projects FROM ({JOBS}) GROUP BY ALL""")
def q_tool_stats(t: Tables) -> DataFrame:
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY k)").cast("long")
    return jobs(t).groupBy("type").agg(F.count("*").alias("calls"), F.max("k").alias("most"), F.sum("k").alias("total"), p95.alias("p95"), F.countDistinct("project").alias("projects"))


@carrier(f"""SELECT d.event_id, d.project, c_name AS name FROM ({JOBS}) d LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON d.project = c_custkey WHERE status = 'dead'""")
def q_dead_letters(t: Tables) -> DataFrame:
    known = t.customer.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("name"))
    return jobs(t).where("status = 'dead'").join(known, F.col("project") == F.col("c_custkey"), "left").select("event_id", "project", "name")


@carrier(f"SELECT event_id, least(ts + to_seconds(CAST(greatest(k - 20, 0) * 30 AS DOUBLE)), TIMESTAMP '2024-01-15 00:00:00') AS due FROM ({JOBS})")
def q_capped_due(t: Tables) -> DataFrame:
    late = F.make_dt_interval(secs=F.greatest(F.col("k") - 20, F.lit(0)) * 30)
    return jobs(t).select("event_id", F.least(F.col("ts") + late, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("due"))


@carrier(f"SELECT project, event_id FROM ({JOBS}) WHERE nullif(k % 3, 0) IS NULL AND status IS DISTINCT FROM 'done'")
def q_open_calls(t: Tables) -> DataFrame:
    return jobs(t).where(F.nullif(F.col("k") % 3, F.lit(0)).isNull() & ~F.col("status").eqNullSafe("done")).select("project", "event_id")


@carrier("SELECT count(*) AS total, count(DISTINCT role) AS roles, count(DISTINCT coalesce(nullif(role, 'system'), 'unknown')) AS agents FROM conversations")
def q_distinct_counts(t: Tables) -> DataFrame:
    agent = F.coalesce(F.nullif("role", F.lit("system")), F.lit("unknown"))
    return t.conversations.agg(F.count("*").alias("total"), F.countDistinct("role").alias("roles"), F.countDistinct(agent).alias("agents"))


@carrier(f"""WITH p AS (SELECT *, lag(status) OVER (PARTITION BY project ORDER BY ts, event_id) AS was FROM ({JOBS})),
  e(a, b) AS (VALUES ('queued', 'done'), ('queued', 'failed'), ('failed', 'queued'), ('failed', 'dead'), ('done', 'done'))
  SELECT event_id, was, status FROM p WHERE was IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE a = was AND b = status)""")
def q_illegal_transitions(t: Tables) -> DataFrame:
    edges = [("queued", "done"), ("queued", "failed"), ("failed", "queued"), ("failed", "dead"), ("done", "done")]
    allowed = t.spark.createDataFrame(edges, "was string, status string")
    steps = jobs(t).withColumn("was", F.lag("status").over(W.partitionBy("project").orderBy("ts", "event_id"))).where("was IS NOT NULL")
    return steps.join(F.broadcast(allowed), ["was", "status"], "left_anti").select("event_id", "was", "status")
