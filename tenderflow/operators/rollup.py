"""Quote roll-ups: groups, alternates, sections, taxes and blended margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenderflow.functions.money import exact_sum, money


def priced(lines: DataFrame) -> DataFrame:
    """Adds sell, extended and error from cost, margin and qty."""
    from tenderflow.functions import money as m

    cost, margin, qty = F.col("cost"), F.col("margin"), F.col("qty")
    error = m.line_error(cost, margin, qty)
    sell = F.when(cost.isNotNull() & error.isNull(), m.sale_each(cost, margin))
    return lines.select("*", sell.alias("sell"), F.when(error.isNull(), m.extended(cost, margin, qty)).alias("extended"), error.alias("error"))


def group_subtotals(lines: DataFrame, keys: list[str], group: Column) -> DataFrame:
    """Subtotal of each group under keys; unpriced lines add nothing but are counted."""
    return lines.groupBy(*keys, group.alias("group_key")).agg(
        F.coalesce(exact_sum(F.col("extended")), F.lit(0.0)).alias("subtotal"),
        F.count("*").alias("n_lines"),
        F.count_if(F.col("extended").isNull()).alias("n_unpriced"),
    )


def with_tax(totals: DataFrame, rate: Column) -> DataFrame:
    """Adds tax and grand_total to subtotal."""
    tax = money(F.col("subtotal") * rate)
    return totals.withColumn("tax", tax).withColumn("grand_total", money(F.col("subtotal") + tax))


def named(*columns: str, otherwise: str) -> Column:
    """The first of the columns that is neither null nor empty, else `otherwise`."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(otherwise))


def blended_margin(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(sell - cost) / sell over lines with a cost, to four places; null where nothing was sold.

    A missing quantity counts as 0, as does a missing extended price; line costs are summed unrounded. `unpriced` are the lines without cost.
    """
    costed = F.col("cost").isNotNull()
    line = (F.col("cost") * F.coalesce("qty", F.lit(0.0))).cast("decimal(30,8)")
    sold = F.coalesce(exact_sum(F.when(costed, F.col("extended"))), F.lit(0.0))
    out = lines.groupBy(*keys).agg(sold.alias("sold"), F.coalesce(F.sum(F.when(costed, line)).cast("double"), F.lit(0.0)).alias("spent"), F.count_if(~costed).alias("unpriced"))
    blended = F.round((F.col("sold") - F.col("spent")) / F.nullif(F.col("sold"), F.lit(0.0)), 4)
    return out.select(*keys, "sold", money(F.col("spent")).alias("spent"), "unpriced", blended.alias("blended"))


# The blocks of a quote in the order they print, and the divisions that lead to them.
SECTIONS = {"door": "Doors, Frames & Hardware", "accessories": "Restroom Accessories & Washroom Equipment", "frp": "FRP Wall Panels", "other": "Other"}
DIVISIONS = {"10": "accessories", "06": "frp", "08": "door"}


def section_of(division: Column, declared: Column) -> Column:
    """The declared block where it is one, else that of the division; door without a division, other for any that is not known."""
    code = F.trim(division)
    by_code = F.when(F.coalesce(division, F.lit("")) == "", "door")
    for start, section in DIVISIONS.items():
        by_code = by_code.when(code.startswith(start), section)
    return F.when(declared.isin(list(SECTIONS)), declared).otherwise(by_code.otherwise("other"))


def quote_sections(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, place, section, title, group, opening_size, n_lines, subtotal and section_total of the groups of each quote's blocks.

    lines: keys, order, division, group_type, group, opening_size, ext_price. A line without a group falls into one named after its block. The
    opening size is that of a group's first line; a line without a price counts as nothing. Blocks without lines are left out.
    """
    rows = lines.withColumn("section", section_of(F.col("division"), F.col("group_type")))
    places = {s: i for i, s in enumerate(SECTIONS, 1)}
    title = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])[F.col("section")]
    place = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])[F.col("section")]
    group = F.coalesce(F.nullif("group", F.lit("")), title)
    found = rows.groupBy(*keys, place.alias("place"), "section", title.alias("title"), group.alias("group")).agg(
        F.min_by(F.struct("opening_size"), order).alias("first"), F.count("*").alias("n_lines"), F.coalesce(F.sum(F.col("ext_price").cast("decimal(18,2)")), F.lit(0)).alias("exact")
    )
    total = F.sum("exact").over(W.partitionBy(*keys, "section")).cast("double")
    return found.select(*keys, "place", "section", "title", "group", F.col("first.opening_size").alias("opening_size"), "n_lines", F.col("exact").cast("double").alias("subtotal"), total.alias("section_total"))
