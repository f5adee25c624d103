"""Rows, cells and bands of positioned words, and lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROW_HEIGHT, CELL_GAP, BAND_GAP, LAST_BAND = 6.0, 12.0, 200.0, 450.0


def with_rows(words: DataFrame) -> DataFrame:
    """Adds bucket, the row a word is in, from y0."""
    return words.withColumn("bucket", F.floor(F.col("y0") / ROW_HEIGHT))


def row_texts(words: DataFrame) -> DataFrame:
    """page, bucket, n, text with the words of a row from left to right; word breaks ties."""
    listed = F.sort_array(F.collect_list(F.struct("x0", "word")))
    return with_rows(words).groupBy("page", "bucket").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda w: w["word"]), " ").alias("text"))


def cells(words: DataFrame) -> DataFrame:
    """page, bucket, cell, text, x0, x1: a new cell where the gap to the word before is over CELL_GAP."""
    order = W.partitionBy("page", "bucket").orderBy("x0", "word", "x1")
    gap = F.col("x0") - F.lag("x1").over(order)
    rows = with_rows(words).withColumn("opens", F.coalesce((gap > CELL_GAP).cast("int"), F.lit(0)))
    rows = rows.withColumn("cell", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("x0", "word", "x1"))), lambda w: w["word"])
    return rows.groupBy("page", "bucket", "cell").agg(F.array_join(listed, " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def band_starts(starts: Column) -> Column:
    """Of sorted distinct starts those at least BAND_GAP right of the last kept one."""
    none = F.array().cast("array<double>")
    return F.aggregate(starts, none, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= BAND_GAP), F.array_append(kept, x)).otherwise(kept))


def bands(words: DataFrame) -> DataFrame:
    """page, band, left_edge, right_edge: each band ends where the next begins, the last after the smallest gap."""
    kept = words.groupBy("page").agg(band_starts(F.array_sort(F.collect_set("x0"))).alias("kept"))
    gaps = F.zip_with(F.expr("slice(kept, 1, size(kept) - 1)"), F.expr("slice(kept, 2, size(kept))"), lambda a, b: b - a)
    smallest = F.coalesce(F.array_min(gaps), F.lit(LAST_BAND))
    right = F.coalesce(F.try_element_at("kept", F.col("band") + 2), F.col("left_edge") + F.col("smallest"))
    return kept.select("page", "kept", smallest.alias("smallest"), F.posexplode("kept").alias("band", "left_edge")).select("page", "band", "left_edge", right.alias("right_edge"))


def carried(df: DataFrame, keys: list[str], order: list[str], header: Column) -> Column:
    """The last header at or before a row within keys."""
    return F.last(header, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def within_budget(texts: Column, most: int) -> Column:
    """How many of the texts fit into `most` characters; the first always does."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["total"] + F.length(x)
        full = acc["full"] | ((acc["n"] > 0) & (total > most))
        return F.struct(total.alias("total"), F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"), full.alias("full"))

    return F.aggregate(texts, start, step)["n"]


def overlap_share(a: str, b: str) -> Column:
    """Share of box a that box b covers; boxes have x0, x1, y0, y1."""
    c = lambda box, side: F.col(f"{box}.{side}")
    width = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    height = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    return F.try_divide(width * height, (c(a, "x1") - c(a, "x0")) * (c(a, "y1") - c(a, "y0")))


#: Share of a block that a box must cover, and block types that make no claim about text: fixed values.
COVERED = 0.5
NO_TEXT_TYPES = ["discarded", "image", "figure"]


def _cell_size(*frames: DataFrame) -> float:
    """Side of a grid cell such that all boxes together touch at most about four cells each, whatever their sizes."""
    sizes = None
    for f in frames:
        wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        one = f.select(wide.alias("w"), high.alias("h"))
        sizes = one if sizes is None else sizes.unionByName(one)
    r = sizes.agg(F.avg("w").alias("w"), F.avg("h").alias("h"), F.avg(F.col("w") * F.col("h")).alias("area")).first()
    return max(r.w or 0.0, r.h or 0.0, (r.area or 0.0) ** 0.5, 1e-6)


def _on_grid(boxes: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell that a box touches."""
    for axis in "xy":
        low, high = (F.floor(F.col(f"{axis}{k}") / cell) for k in (0, 1))
        boxes = boxes.withColumn(f"c{axis}", F.explode(F.sequence(low, high)))
    return boxes


def covered_blocks(blocks: DataFrame, boxes: DataFrame, page: str, block: str) -> DataFrame:
    """page, block, share: the largest share of each block (page, block, x0, y0, x1, y1) that one box of its page covers, 0 without any.

    Blocks and boxes are dealt to the cells of a grid and meet in a cell of their page, so a page of many boxes is compared
    cell by cell and spreads over tasks. A pair that shares several cells is judged in one, that of the first corner of its
    overlap. Blocks and boxes without an area, or with a null corner, are left out.
    """
    corners = ["x0", "y0", "x1", "y1"]
    real = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    blocks, boxes = blocks.select(page, block, *corners).where(real), boxes.select(page, *corners).where(real)
    cell = _cell_size(blocks, boxes)
    a, b = _on_grid(blocks, cell).alias("a"), _on_grid(boxes, cell).alias("b")
    first = [F.col(f"a.c{x}") == F.floor(F.greatest(f"a.{x}0", f"b.{x}0") / cell) for x in "xy"]
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (page, "cx", "cy")]
    found = a.join(b, [*same, *first]).groupBy(F.col(f"a.{page}").alias(page), F.col(f"a.{block}").alias(block)).agg(F.max(overlap_share("a", "b")).alias("share"))
    return blocks.select(page, block).join(found, [page, block], "left").select(page, block, F.coalesce("share", F.lit(0.0)).alias("share"))


def verified_pages(blocks: DataFrame, boxes: DataFrame, page: str, block: str) -> DataFrame:
    """page, blocks, ratio: of the blocks of a page that claim text, the share of which a box covers at least half.

    blocks also have text and type; those without text or a place, and images, figures and discarded ones, claim nothing. A page
    without such blocks is left out; one with blocks but no box has a null ratio, as there is nothing to compare with.
    """
    placed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    claims = blocks.where(placed & (F.trim(F.coalesce("text", F.lit(""))) != "") & ~F.coalesce(F.col("type").isin(NO_TEXT_TYPES), F.lit(False)))
    hits = covered_blocks(claims, boxes, page, block).groupBy(page).agg(F.count_if(F.col("share") >= COVERED).alias("hits"))
    pages = claims.groupBy(page).agg(F.count("*").alias("blocks")).join(boxes.select(page).distinct().withColumn("has_boxes", F.lit(True)), page, "left")
    ratio = F.when(F.col("has_boxes"), F.round(F.coalesce("hits", F.lit(0)) / F.col("blocks"), 4))
    return pages.join(hits, page, "left").select(page, "blocks", ratio.alias("ratio"))
