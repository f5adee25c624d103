"""Pricing and roll-up queries on order lines as estimate lines and parts as catalog items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import money as m
from tenderflow.operators import rollup
from tenderflow.plans.base import carrier, cents, total
from tenderflow.sources.tables import Tables

#: Fixed values of the carrier: the margin of each division and the floor of each type, and the tax rates.
MARGINS = {"ECONOMY": 0.27, "MEDIUM": 0.3, "PROMO": 0.35, "STANDARD": 0.4, "SMALL": 0.45, "LARGE": 0.56}
STATES = {"NATION_0": "OH", "NATION_1": "KY", "NATION_2": "IN", "NATION_3": "TX", "NATION_4": "NONE"}
RATES = {"OH": 0.08, "KY": 0.065, "IN": 0.07}
SECTIONS = {"ECONOMY": "Doors", "MEDIUM": "Frames", "PROMO": "Hardware", "STANDARD": "Hardware", "SMALL": "Specialties"}


def _map(key: str, values: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


LINES = f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_returnflag AS grp, nullif(l_linestatus, 'F') AS alternate,
  p_type AS division, p_brand AS brand, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE p_retailprice END AS cost,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS qty, CAST({_map("p_type", MARGINS)} AS DOUBLE) AS margin, l_discount, l_tax, l_shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
ERROR = "CASE WHEN cost IS NULL THEN 'unpriced' WHEN qty IS NULL THEN 'no quantity' END"
PRICED = f"""SELECT *, CASE WHEN {ERROR} IS NULL THEN {cents("cost / (1 - margin)")} END AS sell,
  CASE WHEN {ERROR} IS NULL THEN {cents("cost / (1 - margin) * qty")} END AS extended, {ERROR} AS error FROM ({LINES})"""
BIDS = f"""SELECT o_orderkey, o_custkey, CAST({_map("n_name", STATES)} AS VARCHAR) AS state FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
RATE = f"coalesce({_map('state', RATES)}, 0.0)"


def lines(t: Tables) -> DataFrame:
    part = t.part.select("p_partkey", "p_type", "p_brand", "p_retailprice")
    joined = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        "l_partkey",
        F.col("l_returnflag").alias("grp"),
        F.nullif("l_linestatus", F.lit("F")).alias("alternate"),
        F.col("p_type").alias("division"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("p_retailprice")).alias("cost"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity")).alias("qty"),
        m.lookup(F.col("p_type"), MARGINS).cast("double").alias("margin"),
        "l_discount",
        "l_tax",
        "l_shipdate",
    )


def priced(t: Tables) -> DataFrame:
    return rollup.priced(lines(t))


def bids(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", "o_custkey", m.lookup(F.col("n_name"), STATES).cast("string").alias("state"))


@carrier(f"SELECT l_orderkey, l_linenumber, l_partkey, sell, extended, error FROM ({PRICED})")
def q_price_lines(t: Tables) -> DataFrame:
    return priced(t).select("l_orderkey", "l_linenumber", "l_partkey", "sell", "extended", "error")


@carrier(f"""WITH g AS (SELECT l_orderkey, coalesce(nullif(brand, ''), 'ungrouped') AS g, coalesce({total("extended")}, 0) AS s FROM ({PRICED}) GROUP BY ALL),
  q AS (SELECT l_orderkey, {total("s")} AS subtotal, count(*) AS n_groups FROM g GROUP BY ALL),
  x AS (SELECT q.*, state, {cents(f"subtotal * {RATE}")} AS tax FROM q JOIN ({BIDS}) ON l_orderkey = o_orderkey)
  SELECT l_orderkey, n_groups, state, subtotal, tax, {cents("subtotal + tax")} AS grand_total FROM x""")
def q_quote_totals(t: Tables) -> DataFrame:
    groups = rollup.group_subtotals(priced(t), ["l_orderkey"], rollup.named("brand", otherwise="ungrouped"))
    quotes = groups.groupBy("l_orderkey").agg(m.exact_sum(F.col("subtotal")).alias("subtotal"), F.count("*").alias("n_groups"))
    quotes = quotes.join(bids(t), F.col("l_orderkey") == F.col("o_orderkey"))
    return rollup.with_tax(quotes, m.tax_rate(F.col("state"), RATES)).select("l_orderkey", "n_groups", "state", "subtotal", "tax", "grand_total")


@carrier(f"""SELECT l_orderkey, coalesce(nullif(grp, ''), nullif(division, ''), 'Other') AS group_key, coalesce({total("extended")}, 0) AS subtotal, count(*) AS n_lines,
  count(*) FILTER (WHERE extended IS NULL) AS n_unpriced FROM ({PRICED}) GROUP BY ALL""")
def q_quote_groups(t: Tables) -> DataFrame:
    return rollup.group_subtotals(priced(t), ["l_orderkey"], rollup.named("grp", "division", otherwise="Other"))


@carrier(f"""WITH x AS (SELECT division, coalesce({total("CASE WHEN cost IS NOT NULL THEN extended END")}, 0) AS sold, coalesce(CAST(sum(CAST(cost * coalesce(qty, 0) AS DECIMAL(30, 8))) AS DOUBLE), 0) AS spent,
  count(*) FILTER (WHERE cost IS NULL) AS unpriced FROM ({PRICED}) GROUP BY ALL)
  SELECT division, sold, {cents("spent")} AS spent, unpriced, CAST(round(CAST((sold - spent) / nullif(sold, 0) AS DECIMAL(30, 12)), 4) AS DOUBLE) AS blended FROM x""")
def q_blended_margin(t: Tables) -> DataFrame:
    return rollup.blended_margin(priced(t), ["division"])


@carrier(f"""WITH x AS (SELECT alternate, coalesce({total("extended")}, 0) AS subtotal, count(*) AS n_lines FROM ({PRICED}) GROUP BY ALL)
  SELECT CAST(row_number() OVER (ORDER BY alternate NULLS FIRST) AS BIGINT) AS place, alternate, n_lines, subtotal,
  CAST(CASE WHEN alternate IS NULL THEN 250 ELSE 0 END AS DOUBLE) AS freight, {cents("subtotal + CASE WHEN alternate IS NULL THEN 250 ELSE 0 END")} AS grand_total FROM x""")
def q_alternate_totals(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    out = priced(t).groupBy("alternate").agg(F.coalesce(m.exact_sum(F.col("extended")), F.lit(0.0)).alias("subtotal"), F.count("*").alias("n_lines"))
    freight = F.when(F.col("alternate").isNull(), 250.0).otherwise(0.0)
    place = F.row_number().over(W.orderBy(F.asc_nulls_first("alternate"))).cast("long")
    return out.select(place.alias("place"), "alternate", "n_lines", "subtotal", freight.alias("freight"), m.money(F.col("subtotal") + freight).alias("grand_total"))


@carrier(f"""SELECT coalesce({_map("division", SECTIONS)}, 'Other') AS section, grp, coalesce({total("extended")}, 0) AS subtotal, CAST(GROUPING(grp) AS INTEGER) AS level
  FROM ({PRICED}) GROUP BY ROLLUP (1, 2) HAVING GROUPING(section) = 0""".replace("GROUP BY ROLLUP (1, 2) HAVING GROUPING(section) = 0", "GROUP BY GROUPING SETS ((1, 2), (1))"))
def q_quote_layout(t: Tables) -> DataFrame:
    """Sections with their groups (level 0) and their totals (level 1): a group without name is no total."""
    section = F.coalesce(m.lookup(F.col("division"), SECTIONS), F.lit("Other"))
    rolled = priced(t).withColumn("section", section).rollup("section", "grp").agg(F.coalesce(m.exact_sum(F.col("extended")), F.lit(0.0)).alias("subtotal"), F.grouping_id().cast("int").alias("level"))
    return rolled.where("level < 3")


@carrier(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, qty, {cents("sell * 1.1")} AS unit FROM ({PRICED}) WHERE sell IS NOT NULL)
  SELECT l_orderkey, l_linenumber, l_partkey, unit, {cents("unit * qty")} AS marked_up FROM x""")
def q_proposal_markup(t: Tables) -> DataFrame:
    sold = priced(t).where("sell IS NOT NULL").withColumn("unit", m.money(F.col("sell") * 1.1))
    return sold.select("l_orderkey", "l_linenumber", "l_partkey", "unit", m.money(F.col("unit") * F.col("qty")).alias("marked_up"))


@carrier(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_discount * 6 AS DOUBLE) AS applied, CASE WHEN l_discount * 6 < margin - 1e-9 THEN 'below_band' ELSE 'pass' END AS status FROM ({LINES})")
def q_margin_check(t: Tables) -> DataFrame:
    applied = F.col("l_discount") * 6
    return lines(t).select("l_orderkey", "l_linenumber", "l_partkey", applied.alias("applied"), m.margin_status(applied, F.col("margin")).alias("status"))


@carrier(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN 1 - l_discount * 5 > 0 AND 1 - l_discount * 5 <= 1
  THEN {cents("(cost + l_discount * 100 + l_tax * 100) * (1 - l_discount * 5)")} END AS net FROM ({LINES})""")
def q_cost_from_list(t: Tables) -> DataFrame:
    adders = F.array(F.col("l_discount") * 100, F.col("l_tax") * 100)
    return lines(t).select("l_orderkey", "l_linenumber", "l_partkey", m.cost_from_list(F.col("cost"), 1 - F.col("l_discount") * 5, adders).alias("net"))


@carrier(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN 99.5 WHEN cost IS NULL THEN NULL
  ELSE {cents("cost / (1 - margin)")} END AS sell_at FROM ({LINES})""")
def q_derive_sell(t: Tables) -> DataFrame:
    explicit = F.when(F.col("l_linenumber") == 3, 99.5)
    return lines(t).select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(explicit, m.sale_each(F.col("cost"), F.col("margin"))).alias("sell_at"))


@carrier(f"SELECT grp, count(*) AS n_lines, count(cost) AS n_costed, count(extended) AS n_priced FROM ({PRICED}) GROUP BY ALL")
def q_priced_metrics(t: Tables) -> DataFrame:
    return priced(t).groupBy("grp").agg(F.count("*").alias("n_lines"), F.count("cost").alias("n_costed"), F.count("extended").alias("n_priced"))


@carrier(f"""SELECT state, count(*) AS n, CAST({RATE} AS DOUBLE) AS rate, CASE WHEN state IS NULL THEN 'unresolved' WHEN state = 'NONE' THEN 'untaxed'
  WHEN {RATE} > 0 THEN 'taxed' ELSE 'no rate' END AS kind FROM ({BIDS}) GROUP BY ALL""")
def q_tax_state(t: Tables) -> DataFrame:
    code = m.state_code(F.col("state"), {"OHIO": "OH"})
    rate = m.tax_rate(code, RATES)
    kind = F.when(code.isNull(), "unresolved").when(code == "NONE", "untaxed").when(rate > 0, "taxed").otherwise("no rate")
    return bids(t).select(code.alias("state"), rate.alias("rate"), kind.alias("kind")).groupBy("state", "rate", "kind").agg(F.count("*").alias("n"))


@carrier(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, qty, cost, margin, CASE WHEN l_linenumber = 2 THEN 0.5 WHEN l_linenumber = 3 THEN margin END AS own FROM ({LINES}))
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN own IS NULL OR own = margin THEN 'frozen' ELSE 'override' END AS source,
  coalesce(own, margin) AS rate, {cents("cost / (1 - coalesce(own, margin)) * qty")} AS extended FROM x""")
def q_reprice(t: Tables) -> DataFrame:
    own = F.when(F.col("l_linenumber") == 2, 0.5).when(F.col("l_linenumber") == 3, F.col("margin"))
    rate = F.coalesce(own, "margin")
    source = F.when(own.isNull() | (own == F.col("margin")), "frozen").otherwise("override")
    extended = m.extended(F.col("cost"), rate, F.col("qty"))
    return lines(t).select("l_orderkey", "l_linenumber", "l_partkey", source.alias("source"), rate.alias("rate"), extended.alias("extended"))


@carrier("""SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_type <> 'PROMO' THEN CAST(round_even(CAST(CAST(p_retailprice * CAST(0.45 AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)
  ELSE p_retailprice END AS cost FROM part""")
def q_reprice_program(t: Tables) -> DataFrame:
    listed = (F.col("p_partkey") % 5 != 0) & (F.col("p_type") != "PROMO")
    return t.part.select("p_partkey", F.when(listed, m.half_even(F.col("p_retailprice") * 0.45)).otherwise(F.col("p_retailprice")).alias("cost"))


@carrier(f"""SELECT count(*) AS n, count(*) FILTER (WHERE cost IS NULL AND brand NOT LIKE '%Brand#1%' AND grp <> 'R') AS eligible FROM ({LINES})""")
def q_backfill_eligible(t: Tables) -> DataFrame:
    eligible = F.col("cost").isNull() & ~F.col("brand").contains("Brand#1") & ~F.col("grp").eqNullSafe("R")
    return lines(t).agg(F.count("*").alias("n"), F.count_if(eligible).alias("eligible"))


@carrier("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS list_price, CASE WHEN p_partkey % 2 = 0 THEN 0.5 END AS multiplier,
  CASE WHEN p_partkey % 2 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_retailprice * 0.5 ELSE p_retailprice END AS cost FROM part""".replace("THEN 0.5 END", "THEN CAST(0.5 AS DOUBLE) END"))
def q_net_vs_list(t: Tables) -> DataFrame:
    net, price = F.col("p_partkey") % 2 != 0, F.col("p_retailprice")
    stated = F.when(F.col("p_partkey") % 3 == 0, price * 0.5)
    return t.part.select("p_partkey", F.when(~net, price).alias("list_price"), F.when(~net, 0.5).alias("multiplier"), F.when(net, F.coalesce(stated, price)).alias("cost"))


@carrier("""WITH k AS (SELECT unnest([8, 12, 20, 36]) AS k), x AS (SELECT p_partkey, CAST(ceil(p_size * 0.9) AS BIGINT) AS c FROM part), e AS (SELECT p_partkey, c + abs(c % 2) AS e FROM x)
  SELECT p_partkey, CAST(coalesce((SELECT min(k) FROM k WHERE k >= e), 36) AS BIGINT) AS grid FROM e""")
def q_grid_lookup(t: Tables) -> DataFrame:
    keys = F.array(*[F.lit(k).cast("long") for k in (8, 12, 20, 36)])
    return t.part.select("p_partkey", m.grid_key(F.col("p_size") * 0.9, keys).alias("grid"))


@carrier("""WITH a(id, name, v) AS (VALUES (1, 'widget', 5.0), (2, 'cold', 7.5), (3, 'big bolt', 1.0)),
  m AS (SELECT p_partkey, id, v, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN p_name = name THEN 0 ELSE 1 END, id) AS r
    FROM part JOIN a ON p_name = name OR contains(p_name, name) OR contains(name, p_name))
  SELECT part.p_partkey, CAST(id AS BIGINT) AS adder, CAST(v AS DOUBLE) AS amount FROM part LEFT JOIN m ON part.p_partkey = m.p_partkey AND r = 1""")
def q_adders(t: Tables) -> DataFrame:
    """Exact name first, else the first that holds the other's."""
    out_id, out_v = F.lit(None).cast("long"), F.lit(None).cast("double")
    adders = [(1, "widget", 5.0), (2, "cold", 7.5), (3, "big bolt", 1.0)]
    name = F.col("p_name")
    for exact in (False, True):
        for i, text, v in reversed(adders):
            hit = (name == text) if exact else name.contains(text) | F.lit(text).contains(name)
            out_id, out_v = F.when(hit, F.lit(i).cast("long")).otherwise(out_id), F.when(hit, F.lit(v)).otherwise(out_v)
    return t.part.select("p_partkey", out_id.alias("adder"), out_v.alias("amount"))
