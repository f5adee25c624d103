"""Review flags: what an estimator has to look at in the quote lines and the scope of a bid. Missing columns count as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.functions.money import margin_status
from tenderflow.operators.contracts import Fields, findings, together

# Cost sources that leave a price to a person.
UNFINISHED = ("MANUAL", "VENDOR_RFQ", "DISTRIBUTOR_MANUAL")


def line_flags(lines: DataFrame, floor: Column, excluded: DataFrame) -> DataFrame:
    """floor: lowest margin of a line; excluded: names of vendors that are not quoted, a configured list of a few rows. One flag for each name that a vendor holds."""
    f = Fields(lines)
    label = F.when(f.filled("group_name"), f("group_name")).when(f.filled("line_id"), f("line_id")).otherwise("unknown line")
    vendor = F.lower(F.when(f.filled("vendor"), f("vendor")).otherwise(f("manufacturer")))
    margin = f("margin", "double")
    flags = findings(
        lines,
        label,
        [
            ("cost", "medium", F.upper(f("cost_source")).isin(*UNFINISHED) & f("cost").isNull()),
            ("margin", "medium", margin.isNotNull() & (margin_status(margin, floor) == "below_band")),
            ("margin_override", "medium", margin.isNotNull() & f.true("margin_overridden") & ~f.filled("margin_override_reason")),
            ("substitution", "medium", f.filled("substitution_note")),
        ],
    )
    names = excluded.where(Fields(excluded).filled("name")).select(F.lower("name").alias("name"))
    return together(flags, findings(lines.join(names, vendor.contains(F.col("name"))), label, [("out_of_scope", "high", F.lit(True))]))


def scope_flags(bids: DataFrame, openings: DataFrame, items: DataFrame) -> DataFrame:
    """bids (bid, brand_mismatch, fire_ratings_present, state); items found but not quoted (bid, item)."""
    b, i = Fields(bids), Fields(items)
    seen = openings.select("bid", F.lit(True).alias("has_openings")).distinct()
    rules = [
        ("no_scope", "high", F.col("has_openings").isNull()),
        ("project_identity", "critical", b.filled("brand_mismatch")),
        ("fire_rating", "high", ~b("fire_ratings_present", "boolean")),
        ("sales_tax", "medium", ~b.filled("state")),
    ]
    return together(findings(bids.join(seen, "bid", "left"), F.lit("bid"), rules), findings(items, F.coalesce(i("item"), F.lit("unknown item")), [("out_of_scope", "low", F.lit(True))]))
