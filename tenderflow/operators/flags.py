"""Rule tables: one input row gives a flag row for each rule that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = list[tuple[str, str, Column]]


def raise_flags(df: DataFrame, subject: Column, rules: Rules) -> DataFrame:
    """subject, rule, severity; a condition that is null does not hold."""
    hits = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, cond in rules]
    return df.select(subject.alias("subject"), F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("subject", "hit.rule", "hit.severity")


def first_verdict(rules: list[tuple[Column, bool, str]], reason: str) -> tuple[Column, Column]:
    """(verdict, reason) of the first rule that holds; a null verdict with the given reason where none does."""
    verdict, why = F.lit(None).cast("boolean"), F.lit(reason)
    for cond, value, text in reversed(rules):
        verdict, why = F.when(cond, F.lit(value)).otherwise(verdict), F.when(cond, F.lit(text)).otherwise(why)
    return verdict, why
