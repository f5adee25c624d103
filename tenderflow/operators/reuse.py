"""Work that is done again only where what it depends on changed: fingerprints, a manifest, and tables refreshed by partition."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CONFIDENCE_FLOOR = 0.75


def canonical(*columns: str) -> Column:
    """JSON of the columns in the order of their names, nulls included, for hashing."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def content_key(columns: list[str], **about: str) -> Column:
    """SHA-256 of the columns and of what else the result depends on (version, operation, options), in any order."""
    return F.sha2(F.concat_ws("\n", canonical(*columns), *[F.lit(f"{k}={v}") for k, v in sorted(about.items())]), 256)


def reusable(entries: DataFrame, dependencies: dict[str, str | None], floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Entries (confidence and a column for each dependency) that may be used again.

    Kept are those with at least the floor's confidence whose every dependency is what it is now. A dependency that is not
    known now (None) proves nothing, so nothing is reused; nor is an entry that does not name one.
    """
    if any(v is None for v in dependencies.values()):
        return entries.limit(0)
    kept = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) >= floor
    for name, now in dependencies.items():
        kept = kept & F.coalesce(F.col(name) == now, F.lit(False))
    return entries.where(kept)


def fingerprints(rows: DataFrame, by: str, version: str) -> DataFrame:
    """by, fingerprint: of the rows of each partition in any order, repeated ones counted, and of the version of the work on them.

    Two 64-bit hashes of each row are added up and combined bit by bit before the shuffle; the digest is made of these.
    """
    row = canonical(*rows.columns)
    one, two = F.xxhash64(F.lit(1), row), F.xxhash64(F.lit(2), row)
    found = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(one.cast("decimal(20,0)")).alias("a"), F.sum(two.cast("decimal(20,0)")).alias("b"), F.bit_xor(one).alias("c"))
    return found.select(by, F.sha2(F.concat_ws("|", F.lit(version), *[F.col(c).cast("string") for c in "nabc"]), 256).alias("fingerprint"))


def _latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest whole manifest in folder."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(f"{folder}/manifest")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [str(f.getPath()) for f in files.listStatus(path) if files.exists(jvm.Path(f.getPath(), "_SUCCESS"))] if files.exists(path) else []
    return spark.read.parquet(max(runs, key=lambda p: p.rsplit("/", 1)[1])) if runs else None


def refresh(rows: DataFrame, by: str, version: str, compute: Callable[[DataFrame], DataFrame], folder: str) -> dict[str, int]:
    """Brings the table in folder up to date: compute (which keeps the column by) runs on the partitions whose fingerprint changed, and on no others.

    Gives how many partitions were computed, reused and dropped. Changed partitions replace their own files, dropped ones
    leave the manifest. The manifest is written last: a run that fails before that is done again. Where nothing changed
    nothing is written.
    """
    spark = rows.sparkSession
    now, before = fingerprints(rows, by, version).persist(), _latest(spark, folder)
    try:
        known = before if before is not None else now.limit(0)
        changed = now.join(known, [by, "fingerprint"], "left_anti").select(by)
        n, todo, gone = now.count(), changed.count(), known.join(now, by, "left_anti").count()
        if todo:
            part = compute(rows.join(changed, by, "left_semi"))
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{folder}/data")
        if todo or gone:
            now.write.parquet(f"{folder}/manifest/{time.time_ns():020d}")
    finally:
        now.unpersist()
    return {"computed": todo, "reused": n - todo, "dropped": gone}


def current(spark: SparkSession, by: str, folder: str) -> DataFrame:
    """The table in folder as of its newest manifest."""
    known = _latest(spark, folder)
    if known is None:
        raise ValueError(f"nothing was refreshed in {folder}")
    data = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    return data.join(known.select(by), by, "left_semi")


def saved_versions(saves: DataFrame, path: str, order: list[Column], content: str) -> DataFrame:
    """saves with sha256, bytes, unchanged (the content is that of the save before) and version, which rises with each change of a path."""
    along = W.partitionBy(path).orderBy(*order)
    rows = saves.withColumn("sha256", F.sha2(F.col(content), 256)).withColumn("bytes", F.octet_length(content).cast("long"))
    rows = rows.withColumn("unchanged", F.coalesce(F.lag("sha256").over(along) == F.col("sha256"), F.lit(False)))
    return rows.withColumn("version", F.sum((~F.col("unchanged")).cast("long")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
