"""Reference sheets: suppliers as vendors with tiers, parts as what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.operators import reference
from tenderflow.plans.base import carrier, cents
from tenderflow.sources.tables import Tables

#: How many vendors parts are dealt to, some of them in no sheet; kinds of parts that vendors have multipliers for.
VENDORS = 120
TIER_SQL = """SELECT s_suppkey AS seq, 'v' || s_suppkey % 90 AS key, s_name AS name, s_suppkey % 6 AS m, CASE WHEN s_suppkey % 6 = 0 THEN 'Net program' WHEN s_suppkey % 6 = 1 THEN 'Priced NET of freight' END AS tier, CASE s_suppkey % 6 WHEN 1 THEN 1.0 WHEN 2 THEN 0.45 WHEN 3 THEN 0.6 WHEN 5 THEN 0.7 END AS multiplier,
  s_suppkey % 6 IN (3, 4) AS grouped, CASE WHEN s_suppkey % 12 = 8 THEN 'net' END AS basis, s_acctbal AS bal FROM supplier"""
ASKED_SQL = f"SELECT p_partkey, p_type, p_size, p_retailprice, p_brand, CASE WHEN p_partkey % 2 = 0 THEN ' V' || p_partkey % {VENDORS} ELSE 'supplier#' || lpad(CAST(p_partkey % {VENDORS} AS VARCHAR), 9, '0') END AS vendor, CASE WHEN p_partkey % 5 <> 0 THEN p_type || CASE WHEN p_partkey % 3 = 0 THEN '-steel' ELSE ' Steel' END END AS category FROM part"
FIRST_SQL = f"WITH t AS ({TIER_SQL}), n AS (SELECT lower(key) AS needle, * FROM t UNION ALL SELECT lower(name), * FROM t), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY needle ORDER BY seq) = 1), a AS ({ASKED_SQL})"


def tiers(t: Tables) -> DataFrame:
    key, k = F.col("s_suppkey"), F.col("s_suppkey") % 6
    rates = F.when(k.isin(3, 4), F.create_map(F.lit("economy_steel"), F.lit(0.4), F.lit("large_steel"), F.lit(0.5), F.lit("promo_steel"), F.lit(0.25)))
    return t.supplier.select(
        key.alias("seq"), F.concat(F.lit("v"), (key % 90).cast("string")).alias("key"), F.col("s_name").alias("name"), F.when(k == 0, "Net program").when(k == 1, "Priced NET of freight").alias("tier"), F.lit(None).cast("string").alias("note"),
        F.when(k == 1, 1.0).when(k == 2, 0.45).when(k == 3, 0.6).when(k == 5, 0.7).alias("multiplier"), rates.alias("categories"), F.when(key % 12 == 8, "net").alias("basis"), F.col("s_acctbal").cast("string").alias("effective_date"),
    )


def asked(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    number = (key % VENDORS).cast("string")
    vendor = F.when(key % 2 == 0, F.concat(F.lit(" V"), number)).otherwise(F.concat(F.lit("supplier#"), F.lpad(number, 9, "0")))
    category = F.when(key % 5 != 0, F.concat("p_type", F.when(key % 3 == 0, "-steel").otherwise(" Steel")))
    return t.part.select("p_partkey", "p_type", "p_size", "p_retailprice", "p_brand", vendor.alias("vendor"), category.alias("category"))


RATE_SQL = "CASE p_type WHEN 'ECONOMY' THEN 0.4 WHEN 'LARGE' THEN 0.5 WHEN 'PROMO' THEN 0.25 END"
TIERED_SQL = f"""{FIRST_SQL}, r AS (SELECT a.*, f.name AS vendor_name, CAST(CASE WHEN category IS NOT NULL AND grouped THEN {RATE_SQL} ELSE multiplier END AS DOUBLE) AS multiplier,
    CASE WHEN name IS NULL THEN 'unknown vendor' WHEN category IS NOT NULL AND grouped AND {RATE_SQL} IS NULL THEN 'unknown category' END AS tier_note FROM a LEFT JOIN f ON lower(trim(vendor)) = needle)"""


@carrier(f"{TIERED_SQL} SELECT p_partkey, vendor_name, multiplier, CASE WHEN tier_note = 'unknown category' THEN 'economy_steel,large_steel,promo_steel' END AS available, tier_note FROM r")
def q_tier_lookup(t: Tables) -> DataFrame:
    found = reference.vendor_tiers(asked(t), "vendor", "category", tiers(t))
    return found.select("p_partkey", "vendor_name", "multiplier", F.array_join("available", ",").alias("available"), "tier_note")


BASIS_SQL = f"""{FIRST_SQL}, k AS (SELECT needle, bool_or(grouped OR coalesce(multiplier <> 1, false)) AS listed, bool_or((tier IS NOT NULL OR coalesce(basis = 'net', false)) AND coalesce(multiplier = 1, true)) AS net FROM n GROUP BY needle),
  b AS (SELECT a.*, CASE WHEN p_brand = 'Brand#7' THEN 'net' WHEN listed THEN 'list' WHEN net THEN 'net' ELSE 'unknown' END AS basis FROM a LEFT JOIN k ON lower(trim(vendor)) = needle)"""


def based(t: Tables) -> DataFrame:
    kinds = t.part.select(F.col("p_brand").alias("file")).distinct().withColumn("kind", F.when(F.col("file") == "Brand#7", "multiplier_sheet").otherwise("price_list"))
    return reference.price_basis(asked(t), "p_brand", "vendor", kinds, tiers(t))


@carrier(f"{BASIS_SQL} SELECT p_partkey, basis FROM b")
def q_price_basis(t: Tables) -> DataFrame:
    return based(t).select("p_partkey", "basis")


NET_SQL = """SELECT p_partkey AS seq, CASE WHEN p_partkey % 4 <> 1 THEN 'bb' || p_partkey % 400 END AS part_number, 'C' || p_partkey % 50 AS item_code, p_retailprice / 2 AS net_price FROM part WHERE p_size > 40"""
NUMBER_SQL = "CASE p_partkey % 4 WHEN 0 THEN 'BB' || p_partkey % 600 WHEN 1 THEN 'BB' || p_partkey % 600 || '-US26D' WHEN 2 THEN ' c' || p_partkey % 90 || ' x' ELSE '-' END"
NETS_SQL = f"""i AS ({NET_SQL}), c AS (SELECT upper(part_number) AS needle, * FROM i WHERE part_number IS NOT NULL UNION ALL SELECT item_code, * FROM i),
  q AS (SELECT p_partkey, upper(trim({NUMBER_SQL})) AS number, regexp_extract(upper(trim({NUMBER_SQL})), '^([^- ]*)', 1) AS base FROM part WHERE p_partkey % 3 = 0),
  s AS (SELECT p_partkey, arg_min(net_price, seq) AS net_price, arg_min(item_code, seq) AS item_code FROM q JOIN c ON needle IN (number, base) WHERE needle <> '' GROUP BY p_partkey)"""


def part_number() -> Column:
    key = F.col("p_partkey")
    one = F.concat(F.lit("BB"), (key % 600).cast("string"))
    return F.when(key % 4 == 0, one).when(key % 4 == 1, F.concat(one, F.lit("-US26D"))).when(key % 4 == 2, F.concat(F.lit(" c"), (key % 90).cast("string"), F.lit(" x"))).otherwise("-")


def with_nets(t: Tables, rows: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    items = t.part.where("p_size > 40").select(key.alias("seq"), F.when(key % 4 != 1, F.concat(F.lit("bb"), (key % 400).cast("string"))).alias("part_number"), F.concat(F.lit("C"), (key % 50).cast("string")).alias("item_code"), (F.col("p_retailprice") / 2).alias("net_price"))
    rows = rows.withColumn("number", part_number()).withColumn("maker", F.when(key % 3 == 0, "Hager").otherwise("Other"))
    return reference.special_nets(rows, "p_partkey", "maker", "number", items)


@carrier(f"WITH {NETS_SQL} SELECT part.p_partkey, net_price, item_code FROM part LEFT JOIN s ON s.p_partkey = part.p_partkey")
def q_special_nets(t: Tables) -> DataFrame:
    return with_nets(t, t.part.select("p_partkey")).select("p_partkey", "net_price", "item_code")


@carrier(f"""WITH l AS (SELECT DISTINCT 'Brand#' || (1 + p_partkey % 9) AS v, 'BB' || p_partkey % 400 AS needle FROM part WHERE p_size > 40)
  SELECT p_partkey, CASE WHEN p_brand IN (SELECT v FROM l) THEN EXISTS (SELECT 1 FROM l WHERE v = p_brand AND needle IN (upper(trim({NUMBER_SQL})), regexp_extract(upper(trim({NUMBER_SQL})), '^([^- ]*)', 1))) END AS stock FROM part""")
def q_stock_parts(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    lists = t.part.where("p_size > 40").select(F.concat(F.lit("brand#"), (1 + key % 9).cast("string")).alias("vendor"), F.concat(F.lit("bb"), (key % 400).cast("string")).alias("part_number"))
    rows = t.part.select("p_partkey", "p_brand", part_number().alias("number"))
    return reference.stock_parts(rows, "p_partkey", "p_brand", "number", lists).select("p_partkey", "stock")


@carrier("""WITH r AS (SELECT lower(n_name) AS name, n_nationkey AS seq, 0.2 + n_nationkey / CAST(100 AS DOUBLE) AS margin FROM nation WHERE n_nationkey % 2 = 0)
  SELECT c_custkey, margin AS special_margin FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN r ON r.name = lower(n_name)""")
def q_customer_margin(t: Tables) -> DataFrame:
    """Customers named after their nation; of two records of one name the first counts."""
    nation = t.nation.select("n_nationkey", "n_name")
    records = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("seq"), F.upper("n_name").alias("name"), (0.2 + F.col("n_nationkey") / 100).alias("margin"))
    records = records.unionByName(records.select((F.col("seq") + 100).alias("seq"), F.lower("name").alias("name"), F.lit(0.9).alias("margin")))
    rows = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit(" "), "n_name").alias("customer"))
    return reference.customer_margins(rows, "customer", records).select("c_custkey", "special_margin")


COST = f"""CASE WHEN feed IS NOT NULL THEN feed WHEN net_price IS NOT NULL THEN net_price WHEN cat IS NOT NULL THEN cat WHEN basis = 'net' THEN p_retailprice WHEN basis = 'list' AND multiplier > 0 AND multiplier <= 1 THEN {cents("p_retailprice * multiplier")} END"""


@carrier(f"""{TIERED_SQL}, {BASIS_SQL[len(FIRST_SQL) + 2 :]}, {NETS_SQL},
  x AS (SELECT r.p_partkey, r.p_retailprice, r.multiplier, b.basis, s.net_price, CASE WHEN r.p_partkey % 11 = 0 AND r.p_partkey % 2 = 0 THEN r.p_retailprice * 0.9 END AS feed, CASE WHEN r.p_partkey % 7 = 0 THEN r.p_retailprice END AS cat FROM r JOIN b ON r.p_partkey = b.p_partkey LEFT JOIN s ON s.p_partkey = r.p_partkey)
  SELECT p_partkey, CASE WHEN feed IS NOT NULL THEN 'P21_LAST_PO' WHEN net_price IS NOT NULL THEN 'SPECIAL_NET' WHEN cat IS NOT NULL THEN 'CATALOG_BASELINE' WHEN {COST} IS NOT NULL THEN 'LIST_X_MULTIPLIER' ELSE 'MANUAL' END AS cost_source, CAST({COST} AS DOUBLE) AS cost FROM x""")
def q_cost_ladder(t: Tables) -> DataFrame:
    """A fresh purchase, a special net, the catalogue, list times the vendor's multiplier by what its sheet's prices are, else manual."""
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    rows = reference.vendor_tiers(based(t), "vendor", "category", tiers(t))
    rows = with_nets(t, rows).withColumns({"feed_cost": F.when(key % 11 == 0, price * 0.9), "feed_fresh": key % 2 == 0, "catalog_cost": F.when(key % 7 == 0, price), "list_price": price})
    return reference.cost_ladder(rows, "basis").select("p_partkey", "cost_source", "cost")


LINE_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE WHEN l_suppkey % 5 = 0 THEN 0.35 END AS margin, CASE WHEN l_suppkey % 3 = 0 THEN '10 28 13' ELSE '08 71 00' END AS division FROM lineitem"""
ITEM_SQL = """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_retailprice WHEN p_size % 4 = 1 THEN -1 END AS own, CASE WHEN p_size % 4 <> 3 THEN p_retailprice END AS list_price, CASE WHEN p_size % 8 <> 6 THEN CAST(0.45 AS DOUBLE) END AS mult, CASE WHEN p_size % 6 = 0 THEN 0.4 END AS dm, CASE WHEN p_brand = 'Brand#9' THEN 'bobrick' END AS vendor FROM part"""


@carrier(f"""WITH x AS (SELECT *, CASE WHEN own >= 0 THEN own WHEN own IS NULL THEN CAST(round_even(CAST(CAST(list_price * mult AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) END AS found,
    CAST(coalesce(margin, dm, CASE WHEN division LIKE '10 28%' OR vendor = 'bobrick' THEN 0.56 ELSE 0.27 END) AS DOUBLE) AS rate FROM ({LINE_SQL}) LEFT JOIN ({ITEM_SQL}) ON l_partkey = p_partkey)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {cents("found")} AS cost, CASE WHEN found IS NULL THEN CAST(margin AS DOUBLE) ELSE rate END AS margin, {cents("found / (1 - rate)")} AS sale_ea, {cents("found / (1 - rate) * l_quantity")} AS ext_price,
    CASE WHEN found IS NULL THEN 'MANUAL' ELSE 'CATALOG_BASELINE' END AS cost_source, CASE WHEN found IS NULL THEN 'requires_page_lookup,keep' ELSE 'keep,catalog_baseline_backfilled' END AS flags FROM x""")
def q_catalog_backfill(t: Tables) -> DataFrame:
    supp, size = F.col("l_suppkey"), F.col("p_size")
    nothing = [F.lit(None).cast("double").alias(c) for c in ("cost", "sale_ea", "ext_price", "list_price", "multiplier")]
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("quantity"), F.when(supp % 5 == 0, 0.35).alias("margin"), F.when(supp % 3 == 0, "10 28 13").otherwise("08 71 00").alias("division"),
        F.lit("MANUAL").alias("cost_source"), F.array(F.lit("requires_page_lookup"), F.lit("keep")).alias("flags"), *nothing,
    )
    items = t.part.select(
        F.col("p_partkey").alias("l_partkey"), F.when(size % 4 == 0, F.col("p_retailprice")).when(size % 4 == 1, -1.0).alias("cost"), F.when(size % 4 != 3, F.col("p_retailprice")).alias("list_price"), F.when(size % 8 != 6, 0.45).alias("multiplier"),
        F.when(size % 6 == 0, "0.4").when(size % 6 == 1, "n/a").alias("default_margin"), F.lit("").alias("division"), F.when(F.col("p_brand") == "Brand#9", "Bobrick").alias("vendor"),
    )
    found = reference.priced_from_catalog(lines, items, ["l_partkey"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cost", "margin", "sale_ea", "ext_price", "cost_source", F.array_join("flags", ",").alias("flags"))
