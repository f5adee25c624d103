"""Rules and flags: parts as openings, order lines as priced lines, orders as bids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.operators import flags
from tenderflow.plans.base import carrier, places
from tenderflow.sources.tables import Tables

OPENINGS = """SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN 'M' || p_partkey END AS mark, CASE WHEN p_size >= 5 THEN p_size END AS width, CASE WHEN p_partkey % 17 <> 0 THEN p_type END AS kind,
  CASE WHEN p_partkey % 19 <> 0 THEN p_size END AS qty, p_partkey % 6 = 0 AS implied, CAST(p_partkey % 100 AS DOUBLE) / 100 AS confidence, p_partkey % 9 <> 0 AS boxed FROM part"""
LINES = """SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, p_brand, p_name, p_type,
  CASE WHEN l_partkey % 11 <> 0 THEN p_retailprice END AS cost FROM lineitem JOIN part ON l_partkey = p_partkey"""
EXCLUDED = ["#13", "#7", "#21"]


def openings(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t.part.select(
        "p_partkey", F.when(key % 13 != 0, F.concat(F.lit("M"), key.cast("string"))).alias("mark"), F.when(F.col("p_size") >= 5, F.col("p_size")).alias("width"),
        F.when(key % 17 != 0, F.col("p_type")).alias("kind"), F.when(key % 19 != 0, F.col("p_size")).alias("qty"), (key % 6 == 0).alias("implied"), ((key % 100) / 100).alias("confidence"), (key % 9 != 0).alias("boxed"),
    )


def lines(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    cost = F.when(F.col("l_partkey") % 11 != 0, F.col("p_retailprice"))
    return joined.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "p_brand", "p_name", "p_type", cost.alias("cost"))


def flag_sql(source: str, subject: str, rules: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {subject} AS subject, '{name}' AS rule, '{severity}' AS severity FROM ({source}) WHERE {cond}" for name, severity, cond in rules)


OPENING_SQL = flag_sql(OPENINGS, "'opening ' || p_partkey", [
    ("missing_mark", "high", "mark IS NULL"), ("missing_width", "high", "width IS NULL"), ("missing_kind", "high", "kind IS NULL"), ("missing_qty", "high", "qty IS NULL"),
    ("keying_implied", "medium", "implied"), ("low_confidence", "high", "confidence < 0.75"), ("no_box", "medium", "NOT boxed"),
])


@carrier(OPENING_SQL)
def q_opening_flags(t: Tables) -> DataFrame:
    missing = [(f"missing_{c}", "high", F.col(c).isNull()) for c in ("mark", "width", "kind", "qty")]
    rules = [*missing, ("keying_implied", "medium", F.col("implied")), ("low_confidence", "high", F.col("confidence") < 0.75), ("no_box", "medium", ~F.col("boxed"))]
    return flags.raise_flags(openings(t), F.concat(F.lit("opening "), F.col("p_partkey").cast("string")), rules)


LINE_SUBJECT = "'line ' || l_orderkey || '-' || l_linenumber || '-' || l_partkey"
LINE_SQL = flag_sql(LINES, LINE_SUBJECT, [
    ("excluded_vendor", "high", " OR ".join(f"contains(p_brand, '{x}')" for x in EXCLUDED)), ("unfinished_cost", "high", "cost IS NULL OR l_returnflag = 'R'"), ("below_band", "high", "l_discount > 0.085"),
    ("override_without_reason", "medium", "l_linestatus = 'O' AND l_tax < 0.015"), ("substitution", "medium", "l_linestatus = 'F' AND l_quantity > 40"),
])


@carrier(LINE_SQL)
def q_line_flags(t: Tables) -> DataFrame:
    brand = F.col("p_brand")
    excluded = brand.contains(EXCLUDED[0]) | brand.contains(EXCLUDED[1]) | brand.contains(EXCLUDED[2])
    rules = [
        ("excluded_vendor", "high", excluded),
        ("unfinished_cost", "high", F.col("cost").isNull() | (F.col("l_returnflag") == "R")),
        ("below_band", "high", F.col("l_discount") > 0.085),
        ("override_without_reason", "medium", (F.col("l_linestatus") == "O") & (F.col("l_tax") < 0.015)),
        ("substitution", "medium", (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40)),
    ]
    subject = F.concat(F.lit("line "), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]))
    return flags.raise_flags(lines(t), subject, rules)


SCOPES = f"""SELECT o_orderkey, n_name, count(l_partkey) AS n, count(DISTINCT p_type) AS kinds, count(*) FILTER (WHERE contains(p_name, 'cold')) AS outside, count(*) FILTER (WHERE l_tax > 0) AS rated
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN ({LINES}) ON l_orderkey = o_orderkey GROUP BY ALL"""
SCOPE_SQL = flag_sql(SCOPES, "'bid ' || o_orderkey", [
    ("empty_scope", "high", "n = 0"), ("mixed_kinds", "medium", "kinds > 4"), ("out_of_scope_items", "medium", "outside > 0"), ("no_ratings", "high", "n > 0 AND rated = 0"), ("unknown_state", "high", "n_name IS NULL"),
])


@carrier(SCOPE_SQL)
def q_scope_flags(t: Tables) -> DataFrame:
    per_bid = lines(t).groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_distinct("p_type").alias("kinds"), F.count_if(F.col("p_name").contains("cold")).alias("outside"), F.count_if(F.col("l_tax") > 0).alias("rated"))
    place = t.customer.join(t.nation.where("n_nationkey % 5 <> 0"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    scope = t.orders.join(per_bid, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(place, F.col("o_custkey") == F.col("c_custkey"), "left")
    rules = [
        ("empty_scope", "high", F.col("n").isNull()),
        ("mixed_kinds", "medium", F.col("kinds") > 4),
        ("out_of_scope_items", "medium", F.col("outside") > 0),
        ("no_ratings", "high", F.col("rated") == 0),
        ("unknown_state", "high", F.col("n_name").isNull()),
    ]
    return flags.raise_flags(scope, F.concat(F.lit("bid "), F.col("o_orderkey").cast("string")), rules)


@carrier(f"{OPENING_SQL} UNION ALL {LINE_SQL} UNION ALL {SCOPE_SQL}")
def q_flags_all(t: Tables) -> DataFrame:
    return q_opening_flags(t).unionByName(q_line_flags(t)).unionByName(q_scope_flags(t))


@carrier("""SELECT p_partkey, CASE WHEN regexp_matches(x, 'COLD|GEAR') THEN false WHEN contains(x, 'BOLT') THEN false WHEN regexp_matches(x, 'HOT|SMALL|STANDARD') THEN true END AS in_scope,
  CASE WHEN regexp_matches(x, 'COLD|GEAR') THEN 'out of scope' WHEN contains(x, 'BOLT') THEN 'leaf' WHEN regexp_matches(x, 'HOT|SMALL|STANDARD') THEN 'material' ELSE 'undecided' END AS reason
  FROM (SELECT p_partkey, upper(p_name || ' ' || p_type) AS x FROM part)""")
def q_scope_classify(t: Tables) -> DataFrame:
    text = F.upper(F.concat_ws(" ", "p_name", "p_type"))
    verdict, reason = flags.first_verdict([(text.rlike("COLD|GEAR"), False, "out of scope"), (text.contains("BOLT"), False, "leaf"), (text.rlike("HOT|SMALL|STANDARD"), True, "material")], "undecided")
    return t.part.select("p_partkey", verdict.alias("in_scope"), reason.alias("reason"))


@carrier("""SELECT p_brand, count(*) FILTER (WHERE p_partkey % 10 = 0) AS kept, count(*) FILTER (WHERE p_partkey % 10 <> 0 AND v) AS inside, count(*) FILTER (WHERE p_partkey % 10 <> 0 AND NOT v) AS outside,
  count(*) FILTER (WHERE p_partkey % 10 <> 0 AND v IS NULL) AS undecided
  FROM (SELECT p_partkey, p_brand, CASE WHEN regexp_matches(upper(p_name || ' ' || p_type), 'COLD|GEAR|BOLT') THEN false WHEN regexp_matches(upper(p_name || ' ' || p_type), 'HOT|SMALL|STANDARD') THEN true END AS v FROM part) GROUP BY ALL""")
def q_scope_counts(t: Tables) -> DataFrame:
    """Confirmed rows keep their verdict and are only counted."""
    rows = q_scope_classify(t).join(t.part.select("p_partkey", "p_brand"), "p_partkey")
    kept, v = F.col("p_partkey") % 10 == 0, F.col("in_scope")
    return rows.groupBy("p_brand").agg(F.count_if(kept).alias("kept"), F.count_if(~kept & v).alias("inside"), F.count_if(~kept & ~v).alias("outside"), F.count_if(~kept & v.isNull()).alias("undecided"))


CONTRACT = [
    ("no_cost", "high", "cost IS NULL"), ("free_line", "high", "l_discount = 0 AND l_tax = 0"), ("no_group", "high", "l_returnflag IS NULL"), ("page_missing", "medium", "l_linenumber > 6"),
    ("returned_source", "high", "l_returnflag = 'R' AND l_linestatus = 'F'"), ("approval_claimed", "high", "l_linestatus = 'F' AND l_tax > 0.07"), ("bad_quantity", "high", "l_quantity < 1 OR l_quantity > 48"), ("cost_out_of_range", "medium", "cost < 901 OR cost > 1000"),
]


@carrier(flag_sql(LINES, LINE_SUBJECT, CONTRACT))
def q_pricing_contract(t: Tables) -> DataFrame:
    c = F.col
    rules = [
        ("no_cost", "high", c("cost").isNull()),
        ("free_line", "high", (c("l_discount") == 0) & (c("l_tax") == 0)),
        ("no_group", "high", c("l_returnflag").isNull()),
        ("page_missing", "medium", c("l_linenumber") > 6),
        ("returned_source", "high", (c("l_returnflag") == "R") & (c("l_linestatus") == "F")),
        ("approval_claimed", "high", (c("l_linestatus") == "F") & (c("l_tax") > 0.07)),
        ("bad_quantity", "high", ~c("l_quantity").between(1, 48)),
        ("cost_out_of_range", "medium", ~c("cost").between(901, 1000)),
    ]
    subject = F.concat(F.lit("line "), F.concat_ws("-", *[c(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey")]))
    return flags.raise_flags(lines(t), subject, rules)


@carrier(f"""WITH l AS (SELECT l_orderkey, count(*) FILTER (WHERE cost IS NULL) AS unpriced, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) AS n FROM ({LINES}) GROUP BY ALL)
  SELECT o_orderkey, CASE WHEN n IS NULL THEN 'empty' WHEN unpriced > 0 THEN 'unpriced lines' WHEN o_orderstatus = 'P' THEN 'not approved' WHEN returned * 2 > n THEN 'unfinished costs' ELSE 'ready' END AS gate, coalesce(unpriced, 0) AS unpriced
  FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def q_delivery_gate(t: Tables) -> DataFrame:
    """The first reason that holds a bid back."""
    per_bid = lines(t).groupBy("l_orderkey").agg(F.count_if(F.col("cost").isNull()).alias("unpriced"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("n"))
    gate = (
        F.when(F.col("n").isNull(), "empty").when(F.col("unpriced") > 0, "unpriced lines").when(F.col("o_orderstatus") == "P", "not approved")
        .when(F.col("returned") * 2 > F.col("n"), "unfinished costs").otherwise("ready")
    )
    return t.orders.join(per_bid, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", gate.alias("gate"), F.coalesce("unpriced", F.lit(0).cast("long")).alias("unpriced"))


@carrier(f"""SELECT p_brand, {places("CAST(whole AS DOUBLE) / n", 6)} AS complete, {places("CAST(low AS DOUBLE) / nullif(scored, 0)", 6)} AS low_share, whole * 2 < n OR coalesce(low * 2 >= scored AND scored > 0, false) AS review
  FROM (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE mark IS NOT NULL AND width IS NOT NULL AND kind IS NOT NULL AND qty IS NOT NULL) AS whole, count(*) FILTER (WHERE boxed) AS scored, count(*) FILTER (WHERE boxed AND confidence < 0.75) AS low
  FROM ({OPENINGS}) JOIN part USING (p_partkey) GROUP BY ALL)""")
def q_review_verdict(t: Tables) -> DataFrame:
    """Less than half complete, or at least half of the scored ones unsure."""
    rows = openings(t).join(t.part.select("p_partkey", "p_brand"), "p_partkey")
    whole = F.col("mark").isNotNull() & F.col("width").isNotNull() & F.col("kind").isNotNull() & F.col("qty").isNotNull()
    sums = rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(whole).alias("whole"), F.count_if(F.col("boxed")).alias("scored"), F.count_if(F.col("boxed") & (F.col("confidence") < 0.75)).alias("low"))
    complete, low = F.col("whole") / F.col("n"), F.try_divide(F.col("low"), F.col("scored"))
    return sums.select("p_brand", F.round(complete, 6).alias("complete"), F.round(low, 6).alias("low_share"), ((complete < 0.5) | F.coalesce(low >= 0.5, F.lit(False))).alias("review"))


@carrier("""SELECT l_orderkey, count(*) FILTER (WHERE q > 10000) AS absurd_lines, CAST(sum(coalesce(nullif(q, 0), 1)) AS DOUBLE) AS total, sum(coalesce(nullif(q, 0), 1)) > 100000 AS absurd_total
  FROM (SELECT l_orderkey, CASE WHEN l_partkey % 11 <> 0 THEN l_quantity * 300 * (l_partkey % 7) END AS q FROM lineitem) GROUP BY ALL""")
def q_absurd_qty(t: Tables) -> DataFrame:
    """No quantity, or none, counts as one in the total."""
    qty = F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity") * 300 * (F.col("l_partkey") % 7))
    total = F.sum(F.coalesce(F.nullif("q", F.lit(0.0)), F.lit(1.0)))
    return t.lineitem.select("l_orderkey", qty.alias("q")).groupBy("l_orderkey").agg(F.count_if(F.col("q") > 10000).alias("absurd_lines"), total.alias("total"), (total > 100000).alias("absurd_total"))


@carrier("WITH x(excluded) AS (VALUES ('#13'), ('#7'), ('#21')) SELECT p_partkey, p_brand, excluded, 'high' AS severity FROM part JOIN x ON contains(p_brand, excluded)")
def q_excluded_vendor(t: Tables) -> DataFrame:
    """The list of excluded names is configuration, a few rows: it is broadcast."""
    names = t.spark.createDataFrame([(x,) for x in EXCLUDED], "excluded string")
    return t.part.join(F.broadcast(names), F.col("p_brand").contains(F.col("excluded"))).select("p_partkey", "p_brand", "excluded", F.lit("high").alias("severity"))
