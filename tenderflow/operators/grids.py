"""Price grids from positioned numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEAST_COLUMNS, TOLERANCE = 6, 3.0
NUMBER = r"^\d{1,4}$"


def header_steps(values: Column) -> Column:
    """Whether numbers climb in steps of 2, or of both 2 and 4, as the widths of a grid do."""
    steps = F.array_sort(F.array_distinct(F.zip_with(F.expr("slice(values, 1, size(values) - 1)"), F.expr("slice(values, 2, size(values))"), lambda a, b: b - a)))
    return (F.size(values) >= LEAST_COLUMNS) & ((steps == F.array(F.lit(2))) | (steps == F.array(F.lit(2), F.lit(4))))


def edge_counts(edges: Column) -> Column:
    """Right edges and how many numbers end there; a number joins the first edge within TOLERANCE, else it makes one."""
    none = F.array().cast("array<struct<edge: double, n: int>>")

    def join(slots: Column, x: Column) -> Column:
        at = F.array_position(F.transform(slots, lambda s: F.abs(s["edge"] - x) <= TOLERANCE), F.lit(True)) - 1
        grown = F.transform(slots, lambda s, i: F.struct(s["edge"].alias("edge"), F.when(i == at, s["n"] + 1).otherwise(s["n"]).alias("n")))
        new = F.array_append(slots, F.struct(F.round(x, 1).alias("edge"), F.lit(1).alias("n")))
        return F.when(at >= 0, grown).otherwise(new)

    return F.aggregate(edges, none, join)


def price_grid(words: DataFrame, page: str = "page") -> DataFrame:
    """page, height, width, price from words (page, x0, x1, y0, word); pages without a header of widths have no rows.

    The header is the longest row of climbing even steps, the upper of equals. Below it the columns stand where most right edges are, or else
    under the header's; a row's first number left of them is its height. Rows that repeat the widths are further headers, and rows with less
    than half of the columns are none. Of two numbers in a cell the right one counts, of two rows of one height the lower one.
    """
    numbers = words.where(F.col("word").rlike(NUMBER)).select(page, F.round("y0", 1).alias("line"), "x0", "x1", F.col("word").cast("int").alias("value"))
    rows = numbers.groupBy(page, "line").agg(F.sort_array(F.collect_list(F.struct("x0", "value", "x1"))).alias("row"))
    rows = rows.select(page, "line", F.col("row.value").alias("values"), F.col("row.x1").alias("ends")).where(header_steps(F.col("values")))
    best = F.max(F.struct(F.size("values").alias("n"), (-F.col("line")).alias("up"), "values", "ends"))
    header = rows.groupBy(page).agg(best.alias("h")).select(page, (-F.col("h.up")).alias("top"), F.col("h.values").alias("widths"), F.col("h.ends").alias("heads"))
    below = numbers.join(header, page).where(F.col("line") > F.col("top"))

    inside = below.where(F.col("x1") >= F.get("heads", F.lit(0)) - TOLERANCE)
    listed = inside.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("line", "x0", "x1"))).alias("all"))
    ranked = F.array_sort(F.transform(edge_counts(F.transform("all", lambda w: w["x1"])), lambda s, i: F.struct((-s["n"]).alias("less"), i.alias("i"), s["edge"].alias("edge"))))
    listed = listed.select(page, F.transform(ranked, lambda s: s["edge"]).alias("common"))
    most = F.slice("common", F.lit(1), F.size("widths"))
    edges = F.when(F.size("common") >= F.size("widths"), F.array_sort(most)).otherwise(F.col("heads"))
    columns = header.join(listed, page).select(page, edges.alias("edges"))

    cells = below.join(columns, page)
    first = F.get("edges", F.lit(0)) - TOLERANCE
    at = F.array_position(F.transform("edges", lambda e: F.abs(F.col("x1") - e) <= TOLERANCE), F.lit(True))
    cells = cells.withColumn("width", F.when(at > 0, F.get("widths", (at - 1).cast("int"))))
    by_row = W.partitionBy(page, "line")
    cells = cells.withColumn("height", F.min(F.when(F.col("x1") < first, F.struct("x0", "value"))).over(by_row)["value"])
    cells = cells.where("width IS NOT NULL AND height IS NOT NULL").groupBy(page, "line", "height", "width", F.size("widths").alias("n")).agg(F.max_by("value", "x0").alias("price"))
    cells = cells.withColumn("held", F.count("*").over(by_row)).withColumn("echo", F.count_if(F.col("width") == F.col("price")).over(by_row))
    good = (F.col("held") >= F.floor(F.col("n") / 2)) & (F.col("echo") < F.greatest(F.lit(3), F.floor(F.col("held") / 2)))
    cells = cells.where(good).withColumn("low", F.max("line").over(W.partitionBy(page, "height")))
    return cells.where("line = low").select(page, "height", "width", "price")
