"""A run compared with a reviewed reference: what it covers, where it kept silent, and what it asserted wrongly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(value: Column) -> Column:
    """A value as compared: trimmed text in capitals, null where empty."""
    text = value.cast("string")
    return F.when(text != "", F.upper(F.trim(text)))


def _long(frame: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """One row a key and field; of rows that share a key the last by `seq` counts where there is one, else any by its values."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), _plain(F.col(f)).alias(name)) for f in fields])
    order = F.col("seq") if "seq" in frame.columns else F.to_json(cells)
    one = frame.select(F.trim(F.col(key).cast("string")).alias(key), order.alias("seq"), cells.alias("cells"), *(["unknown"] if "unknown" in frame.columns else []))
    one = one.where(F.col(key) != "")
    kept = one.groupBy(key).agg(F.max_by(F.struct(*[c for c in one.columns if c not in (key, "seq")]), "seq").alias("r"))
    return kept.select(key, F.inline("r.cells"), *([F.col("r.unknown").alias("unknown")] if "unknown" in one.columns else []))


def compared(actual: DataFrame, golden: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, wanted, got, verdict for each field of each reference row.

    verdict: covered; silent (another value than wanted, or any value where the reference says nothing or names the field in
    its array `unknown`); honest (nothing where nothing is known); open (nothing where something is wanted); missing (wanted,
    but the run has no row); null for fields of missing rows of which nothing is wanted. Values are compared as trimmed text in
    capitals. Both sides are unpivoted to a row a field and meet in one join on key and field.
    """
    wanted, got = _long(golden, key, fields, "wanted"), _long(actual, key, fields, "got").withColumn("found", F.lit(True))
    rows = wanted.join(got, [key, "field"], "left")
    known = F.col("wanted").isNotNull()
    if "unknown" in golden.columns:
        known = known & ~F.coalesce(F.array_contains("unknown", F.col("field")), F.lit(False))
    verdict = (
        F.when(F.col("found").isNull(), F.when(F.col("wanted").isNotNull(), "missing"))
        .when(~known, F.when(F.col("got").isNull(), "honest").otherwise("silent"))
        .when(F.col("got") == F.col("wanted"), "covered")
        .when(F.col("got").isNotNull(), "silent")
        .otherwise("open")
    )
    return rows.select(key, "field", "wanted", "got", (~known).alias("absent"), verdict.alias("verdict"))


def golden_score(actual: DataFrame, golden: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: expected, found, missing and extra rows, available, covered, absent, honest, silent fields, coverage and honesty.

    coverage is the covered share of what is wanted, missing rows included; honesty the share left blank of what the reference
    does not know, in rows that the run has. Both have three places, and are 1 where there is nothing to cover.
    """
    rows = compared(actual, golden, key, fields)
    is_ = lambda *v: F.count_if(F.col("verdict").isin(*v))
    unread = (F.col("verdict") == "silent") & F.col("absent")
    counts = rows.agg(
        is_("covered").alias("covered"),
        (is_("covered", "open", "missing") + F.count_if((F.col("verdict") == "silent") & ~F.col("absent"))).alias("available"),
        is_("honest").alias("honest"),
        (is_("honest") + F.count_if(unread)).alias("absent"),
        is_("silent").alias("silent"),
    )
    keys = [f.select(F.trim(F.col(key).cast("string")).alias(key)).where(F.col(key) != "").distinct().withColumn(n, F.lit(1)) for f, n in ((golden, "g"), (actual, "a"))]
    both = keys[0].join(keys[1], key, "full_outer").agg(
        F.count("g").alias("expected"), F.count("a").alias("found"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("extra")
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 3)).otherwise(1.0)
    return both.join(F.broadcast(counts)).select("*", share("covered", "available").alias("coverage"), share("honest", "absent").alias("honesty"))
