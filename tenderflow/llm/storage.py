"""Written tables that cut lineage, and joins against id lists whose size is checked first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most ids that a broadcast may carry (8 bytes each); larger lists take a shuffled join.
BROADCAST_IDS = 1_000_000
#: Spark's setting for the most bytes of an Arrow batch, and the value used where it is unset.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4194304b"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session that leaves it unset uses a folder in its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, since texts may be long, where the session leaves that open."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_row_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with one row for each doc_id: of rows that share one, which are looked for first, the smallest text."""
    again = written(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return docs
    once = written(semi_join_ids(docs, again, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "once")
    return anti_join_ids(docs, again, "doc_id").unionByName(once)


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (distinct, written). Broadcast below BROADCAST_IDS, shuffled join beyond."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def anti_join_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in ids (distinct, written); joins as semi_join_ids does."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_anti")
