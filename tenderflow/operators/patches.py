"""Patches of cells: applied in order where they hold, turned down with a reason where they don't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fields that need no page behind them, fields that record a person's decision, and lengths that notes keep.
EVIDENCE_EXEMPT = ["flags", "notes", "evidence_note", "confidence"]
NOT_PATCHABLE = ["confirmed_by", "added_by_hand"]
ROOTS = ["openings", "lines", "items"]
EXCERPT, NOTE = 120, 2_000


def judged(patches: DataFrame, marks: DataFrame, fields: list[str], lists: list[str], rules: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """patches (seq, path, op, value, source_page, excerpt) with mark, field and reason, null where a patch holds.

    marks (mark) are the rows there are. A path reads openings/<mark>/<field>; marks are compared in capitals. rules give for a
    field whether its contract accepts a value; only the fields in `lists` may be appended to. The reasons, in this order: path, unknown mark, protected, unknown field, no
    evidence (page and excerpt), unknown op, contract.
    """
    parts = F.split(F.regexp_replace(F.coalesce("path", F.lit("")), r"^[\s/]+|[\s/]+$", ""), "/", -1)
    rows = patches.withColumn("parts", parts).withColumn("good", (F.size("parts") == 3) & F.get("parts", F.lit(0)).isin(ROOTS))
    rows = rows.withColumn("mark", F.when(F.col("good"), F.upper(F.trim(F.get("parts", F.lit(1)))))).withColumn("field", F.when(F.col("good"), F.get("parts", F.lit(2))))
    known = marks.select(F.upper(F.trim("mark")).alias("mark")).where("mark <> ''").distinct().withColumn("known", F.lit(True))
    op = F.lower(F.coalesce(F.nullif(F.col("op"), F.lit("")), F.lit("set")))
    evidence = F.col("source_page").isNotNull() & (F.trim(F.coalesce("excerpt", F.lit(""))) != "")
    accepted = F.lit(True)
    for name, rule in rules.items():
        accepted = F.when(F.col("field") == name, F.coalesce(rule(F.col("value")), F.lit(False))).otherwise(accepted)
    reason = (
        F.when(~F.col("good"), "path").when(F.col("known").isNull(), "mark").when(F.col("field").isin(NOT_PATCHABLE), "protected").when(~F.col("field").isin(fields), "field")
        .when(~F.col("field").isin(EVIDENCE_EXEMPT) & ~evidence, "evidence").when(~op.isin("set", "append"), "op").when(~accepted | ((op == "append") & ~F.col("field").isin(lists)), "contract")
    )
    return rows.join(known, "mark", "left").select(*[c for c in patches.columns if c != "op"], op.alias("op"), "mark", "field", reason.alias("reason"))


def patched_cells(verdicts: DataFrame, lists: list[str]) -> DataFrame:
    """mark, field, values of each cell that a patch changed: the last value set, or for fields that are lists what was appended since.

    anew says whether the cell was set, so that its values take the place of what it held; else they come after that. Only what
    comes from a cell's last set on counts, so one pass over each cell's patches in order gives its state.
    """
    held = verdicts.where("reason IS NULL")
    order = W.partitionBy("mark", "field").orderBy("seq")
    since = held.withColumn("last_set", F.max(F.when(F.col("op") == "set", F.col("seq"))).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    kept = since.where(F.col("last_set").isNull() | (F.col("seq") >= F.col("last_set")))
    values = F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])
    cells = kept.groupBy("mark", "field").agg(values.alias("values"), F.max(F.col("last_set").isNotNull()).alias("anew"))
    return cells.select("mark", "field", F.when(F.col("field").isin(lists), F.col("values")).otherwise(F.slice("values", -1, 1)).alias("values"), "anew")


def patch_notes(verdicts: DataFrame) -> DataFrame:
    """mark, flags, evidence_note: flags of what was turned down on a known mark, each once and sorted, and the evidence of what was applied, in order."""
    flag = F.when(F.col("reason").isin("protected", "field", "contract"), F.concat(F.lit("patch_rejected_"), "field")).when(F.col("reason") == "evidence", F.concat(F.lit("patch_unevidenced_"), "field"))
    note = F.when(F.col("reason").isNull() & F.col("source_page").isNotNull(), F.concat("field", F.lit(" <- p"), F.col("source_page").cast("string"), F.lit(": "), F.left(F.coalesce("excerpt", F.lit("")), F.lit(EXCERPT))))
    rows = verdicts.where("mark IS NOT NULL AND (reason IS NULL OR reason <> 'mark')").withColumn("flag", flag).withColumn("note", note)
    notes = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("seq", "note")))), lambda x: x["note"]), "; ")
    return rows.groupBy("mark").agg(F.array_sort(F.collect_set("flag")).alias("flags"), F.left(notes, F.lit(NOTE)).alias("evidence_note"))
