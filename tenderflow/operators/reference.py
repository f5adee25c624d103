"""Reference sheets: vendor tiers, special nets, stock lists, customer margins, what a sheet's prices mean, and where a cost comes from.

Every lookup is an equi-join on folded names, against the first record of each name in sheet order; nothing is guessed: what a
sheet does not say is null, with a word on why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import money as m

#: The vendor whose sheet publishes special nets, vendors of accessories, the division of accessories, and margins.
NETS_OF = "hager"
ACCESSORY_VENDORS = ["bobrick", "gamco", "asi", "bradley", "world_dryer"]
ACCESSORY_DIVISION, ACCESSORY_MARGIN, MARGIN = "10 28", 0.56, 0.27
#: Flags that a price from the catalogue settles, and the one that it leaves.
SETTLED, BACKFILLED = ["requires_page_lookup", "manual_page_lookup_pending"], "catalog_baseline_backfilled"


def folded(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name.cast("string"), F.lit(""))))


def base_token(part: Column) -> Column:
    """A part number in capitals up to its first dash or space; null where that is empty."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(part)), r"^([^-\s]*)", 1), F.lit(""))


def _first(records: DataFrame, names: Column, seq: str = "seq") -> DataFrame:
    """needle and record: the first record, by its place in the sheet, of each of its names."""
    columns = [c for c in records.columns]
    rows = records.select(F.explode(F.array_distinct(F.array_compact(names))).alias("needle"), F.struct(*columns).alias("record"))
    return rows.where("needle <> ''").groupBy("needle").agg(F.min_by("record", f"record.{seq}").alias("record"))


def vendor_tiers(asked: DataFrame, vendor: str, category: str, records: DataFrame) -> DataFrame:
    """asked with vendor_name, category_key, multiplier, available, effective_date and tier_note of the tier sheet.

    records: seq, key, name, multiplier, categories (map), effective_date. A vendor is found by key or name in any case. Where a
    category is asked of a vendor that has categories, its own multiplier counts, and an unknown one gives none but lists what
    there is; else the vendor's flat multiplier counts. tier_note: unknown vendor, unknown category, or null.
    """
    found = _first(records, F.array(folded(F.col("key")), folded(F.col("name"))))
    rows = asked.withColumn("needle", folded(F.col(vendor))).join(found, "needle", "left").drop("needle")
    wanted = F.nullif(F.translate(folded(F.col(category)), " -", "__"), F.lit(""))
    grouped = wanted.isNotNull() & (F.size("record.categories") > 0)
    own = F.try_element_at("record.categories", wanted)
    note = F.when(F.col("record").isNull(), "unknown vendor").when(grouped & own.isNull(), "unknown category")
    return rows.select(
        *asked.columns, F.col("record.name").alias("vendor_name"), F.when(grouped, wanted).alias("category_key"), F.when(grouped, own).otherwise(F.col("record.multiplier")).alias("multiplier"),
        F.when(grouped & own.isNull(), F.array_sort(F.map_keys("record.categories"))).alias("available"), F.col("record.effective_date").alias("effective_date"), note.alias("tier_note"),
    )


def special_nets(asked: DataFrame, key: str, vendor: str, part: str, items: DataFrame) -> DataFrame:
    """asked with net_price and item_code: the first item (seq, part_number, item_code, net_price) of that part number, of its base token, or with either as code.

    Only the vendor NETS_OF has special nets. They are costs already. key tells the asked rows apart.
    """
    codes = F.array(F.upper(F.trim(F.coalesce("part_number", F.lit("")))), F.upper(F.trim(F.coalesce("item_code", F.lit("")))))
    found = _first(items, codes)
    needles = F.array_distinct(F.array_compact(F.array(F.nullif(F.upper(F.trim(part)), F.lit("")), base_token(F.col(part)))))
    rows = asked.where(folded(F.col(vendor)) == NETS_OF).select(key, F.explode(needles).alias("needle")).join(found, "needle")
    hit = rows.groupBy(key).agg(F.min_by("record", "record.seq").alias("record"))
    return asked.join(hit, key, "left").select(*asked.columns, F.col("record.net_price").alias("net_price"), F.col("record.item_code").alias("item_code"))


def stock_parts(asked: DataFrame, key: str, vendor: str, part: str, lists: DataFrame) -> DataFrame:
    """asked with stock: whether the vendor's list (vendor, part_number) has the part or its base token; null where there is no list."""
    listed = lists.select(folded(F.col("vendor")).alias("v"), F.upper(F.trim("part_number")).alias("needle"))
    vendors = listed.select("v").distinct().withColumn("has_list", F.lit(True))
    needles = F.array_distinct(F.array_compact(F.array(F.nullif(F.upper(F.trim(part)), F.lit("")), base_token(F.col(part)))))
    rows = asked.select(key, folded(F.col(vendor)).alias("v"), F.explode(needles).alias("needle"))
    hit = rows.join(listed.where("needle <> ''").distinct(), ["v", "needle"], "left_semi").select(key).distinct().withColumn("hit", F.lit(True))
    found = asked.withColumn("v", folded(F.col(vendor))).join(vendors, "v", "left").join(hit, key, "left")
    return found.select(*asked.columns, F.when(F.col("has_list"), F.coalesce("hit", F.lit(False))).alias("stock"))


def customer_margins(asked: DataFrame, customer: str, records: DataFrame) -> DataFrame:
    """asked with special_margin: that of the first record (seq, name, margin) of the customer's name in any case."""
    found = _first(records, F.array(folded(F.col("name"))))
    return asked.withColumn("needle", folded(F.col(customer))).join(found, "needle", "left").select(*asked.columns, F.col("record.margin").alias("special_margin"))


def price_basis(asked: DataFrame, file: str, vendor: str, kinds: DataFrame, records: DataFrame) -> DataFrame:
    """asked with basis: net, list or unknown, for prices read off a sheet.

    A sheet of kind multiplier_sheet (kinds: file, kind) holds nets. Else a vendor with categories or a multiplier other than 1
    in any record is list-priced; one whose record states a net program (basis net, or the word net in tier or note) and has no
    multiplier, or 1, is net; all others are unknown.
    """
    flat = F.col("multiplier").isNotNull() & (F.abs(F.col("multiplier") - 1.0) >= 1e-9)
    wording = F.lower(F.concat_ws(" ", F.coalesce("tier", F.lit("")), F.coalesce("note", F.lit(""))))
    stated = F.coalesce(F.col("basis") == "net", F.lit(False)) | F.array_contains(F.split(F.trim(wording), r"\s+"), "net") | wording.contains("net program")
    names = F.explode(F.array_distinct(F.array(folded(F.col("key")), folded(F.col("name"))))).alias("needle")
    listed, net = flat | (F.coalesce(F.size("categories"), F.lit(0)) > 0), stated & ~flat
    known = records.select(names, listed.alias("listed"), net.alias("net")).where("needle <> ''").groupBy("needle").agg(F.bool_or("listed").alias("listed"), F.bool_or("net").alias("net"))
    sheets = kinds.groupBy(F.col("file").alias("sheet")).agg(F.max_by("kind", F.col("kind") == "multiplier_sheet").alias("kind"))
    rows = asked.withColumn("needle", folded(F.col(vendor))).join(known, "needle", "left").join(sheets, F.col(file) == F.col("sheet"), "left")
    basis = F.when(F.col("kind") == "multiplier_sheet", "net").when(F.col("listed"), "list").when(F.col("net"), "net").otherwise("unknown")
    return rows.select(*asked.columns, basis.alias("basis"))


def cost_ladder(lines: DataFrame, basis: str | None = None) -> DataFrame:
    """lines with cost_source and cost: the first that answers of a fresh purchase, a special net, the catalogue, list times multiplier; else manual without a cost.

    lines: feed_cost and feed_fresh, net_price, catalog_cost, list_price and multiplier; basis names a column that says what
    list_price is: a net price is a cost as it stands, an unknown one none.
    """
    times = m.cost_from_list(F.col("list_price"), F.col("multiplier"), F.array().cast("array<double>"))
    if basis is not None:
        times = F.when(F.col(basis) == "net", F.col("list_price")).when(F.col(basis) == "list", times)
    source, cost = m.first_of([("P21_LAST_PO", F.when(F.col("feed_fresh"), F.col("feed_cost"))), ("SPECIAL_NET", F.col("net_price")), ("CATALOG_BASELINE", F.col("catalog_cost")), ("LIST_X_MULTIPLIER", times)])
    return lines.withColumn("cost_source", F.when(source == "manual", "MANUAL").otherwise(source)).withColumn("cost", cost)


def default_margin(line: Column, item: Column, division: Column, vendor: Column) -> Column:
    """The line's own margin, the item's, that of accessories by division or vendor, or the usual one; texts that are no numbers say nothing."""
    accessory = F.coalesce(division.startswith(ACCESSORY_DIVISION), F.lit(False)) | F.coalesce(F.lower(vendor).isin(ACCESSORY_VENDORS), F.lit(False))
    return F.coalesce(line.try_cast("double"), item.try_cast("double"), F.when(accessory, ACCESSORY_MARGIN).otherwise(MARGIN))


def priced_from_catalog(lines: DataFrame, items: DataFrame, on: list[str]) -> DataFrame:
    """lines with cost, margin, sale_ea, ext_price, cost_source, list_price, multiplier and flags where the catalogue has a cost for them; others as they were.

    lines: on, quantity, margin, division, cost, sale_ea, ext_price, cost_source, list_price, multiplier, flags (array); items: on
    (unique), cost, list_price, multiplier, default_margin, division, vendor. An item's cost is its own, or its list price
    times its multiplier to the cent, half to even; a negative one is none. No quantity, or 0, counts as 1. A line's own list
    price and multiplier stay.
    """
    item = items.select(*on, F.struct("cost", "list_price", "multiplier", "default_margin", F.nullif("division", F.lit("")).alias("division"), "vendor").alias("item"))
    rows = lines.join(item, on, "left")
    cost = F.coalesce("item.cost", m.half_even(F.col("item.list_price") * F.col("item.multiplier")))
    rows = rows.withColumn("found", F.when(cost >= 0, cost))
    margin = default_margin(F.col("margin"), F.col("item.default_margin"), F.coalesce("item.division", "division"), F.col("item.vendor"))
    rows = rows.withColumn("rate", margin).withColumn("qty", F.coalesce(F.nullif(F.col("quantity").cast("double"), F.lit(0.0)), F.lit(1.0)))
    flags = F.array_union(F.array_except(F.coalesce("flags", F.array().cast("array<string>")), F.array(*map(F.lit, SETTLED))), F.array(F.lit(BACKFILLED)))
    new = {
        "cost": m.money(F.col("found")), "margin": F.col("rate"), "sale_ea": m.sale_each(F.col("found"), F.col("rate")), "ext_price": m.extended(F.col("found"), F.col("rate"), F.col("qty")), "cost_source": F.lit("CATALOG_BASELINE"),
        "list_price": F.coalesce("list_price", "item.list_price"), "multiplier": F.coalesce("multiplier", "item.multiplier"), "flags": flags,
    }
    hit = F.col("found").isNotNull()
    new = {c: x if c == "flags" else x.cast(lines.schema[c].dataType) for c, x in new.items()}
    return rows.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in lines.columns])
