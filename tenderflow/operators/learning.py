"""What matching learned from people: an ordered fold of feedback events that a replay does not change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELTAS = "batch long, spec_key string, confirms long, rejects long, reasons array<string>, last_at timestamp, last_item string, last_spec string, confirmed_at timestamp, confirmed_by string"
EVENTS = "batch long, event_id long, outcome string"
#: The event that speaks against a match; all others speak for it.
REJECTED = "matchRejected"


def judged(events: DataFrame) -> DataFrame:
    """events (event_id, event_type, spec_key, spec, proposed_item, corrected_item, reason, occurred_at, user) with item and outcome.

    A rejection teaches about the item that was proposed, every other event about the one chosen instead. Without an item, or
    with a specification whose key is blank, an event is skipped: it teaches nothing, however often it is read.
    """
    item = F.when(F.col("event_type") == REJECTED, F.col("proposed_item")).otherwise(F.col("corrected_item"))
    teaches = item.isNotNull() & (F.trim(F.coalesce("spec_key", F.lit(""))) != "")
    outcome = F.when(~teaches, "skipped").when(F.col("event_type") == REJECTED, "rejected").otherwise("learned")
    return events.withColumn("item", item).withColumn("outcome", outcome)


def folded(events: DataFrame) -> DataFrame:
    """spec_key, confirms, rejects, reasons, and the last item, specification and confirmation, of judged events, each event_id once.

    The latest event by time, then id, gives the last values. Counters and sets are the same in any order of reading.
    """
    once = events.where("outcome <> 'skipped'").dropDuplicates(["event_id"])
    at = F.struct("occurred_at", "event_id")
    yes = F.col("outcome") == "learned"
    found = once.groupBy("spec_key").agg(
        F.count_if(yes).alias("confirms"),
        F.count_if(~yes).alias("rejects"),
        F.array_sort(F.collect_set(F.when(F.trim("reason") != "", F.col("reason")))).alias("reasons"),
        F.max_by(F.struct("occurred_at", "item", "spec"), at).alias("last"),
        F.max_by(F.struct("occurred_at", "user"), F.when(yes, at)).alias("confirmed"),
    )
    return found.select("spec_key", "confirms", "rejects", "reasons", F.col("last.occurred_at").alias("last_at"), F.col("last.item").alias("last_item"), F.col("last.spec").alias("last_spec"), F.col("confirmed.occurred_at").alias("confirmed_at"), F.col("confirmed.user").alias("confirmed_by"))


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(folder)


def drain(events: DataFrame, batch: int, folder: str) -> dict[str, int]:
    """Takes one batch of events into the store in folder, as a function for foreachBatch; gives what it read, learned, rejected and skipped.

    An event that another batch took before does nothing, also where a batch holds it twice. A batch writes its own partitions
    of `events` and `deltas` and replaces them as a whole, so one that is run again after a failure, or in full, leaves the
    same store. Events are joined by id and added up by key; nothing but the counts comes to the driver.
    """
    spark = events.sparkSession
    marks = spark.createDataFrame([], EVENTS) if not _exists(spark, f"{folder}/events") else _stored(spark, f"{folder}/events", EVENTS)
    taken = marks.where(F.col("batch") != batch).select("event_id")
    fresh = judged(events).dropDuplicates(["event_id"]).join(taken, "event_id", "left_anti").persist()
    try:
        counts = dict(fresh.groupBy("outcome").count().collect())
        fresh.select("event_id", "outcome").write.mode("overwrite").parquet(f"{folder}/events/batch={batch}")
        folded(fresh).write.mode("overwrite").parquet(f"{folder}/deltas/batch={batch}")
    finally:
        fresh.unpersist()
    return {"read": sum(counts.values()), **{k: counts.get(k, 0) for k in ("learned", "rejected", "skipped")}}


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def learned(spark: SparkSession, folder: str) -> DataFrame:
    """What the store in folder knows: the deltas of all batches added up by key, the latest values last."""
    rows = _stored(spark, f"{folder}/deltas", DELTAS)
    last = F.max_by(F.struct("last_at", "last_item", "last_spec"), F.struct("last_at", "batch"))
    confirmed = F.max_by(F.struct("confirmed_at", "confirmed_by"), F.when(F.col("confirmed_at").isNotNull(), F.struct("confirmed_at", "batch")))
    found = rows.groupBy("spec_key").agg(F.sum("confirms").alias("confirms"), F.sum("rejects").alias("rejects"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), last.alias("last"), confirmed.alias("confirmed"))
    return found.select("spec_key", "confirms", "rejects", "reasons", "last.*", "confirmed.*")
