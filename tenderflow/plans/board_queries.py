"""Board, lookup and paging queries: orders as bids, customers as people, parts as catalog items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenderflow.functions import money as m
from tenderflow.operators import history
from tenderflow.operators import history as h
from tenderflow.plans.base import carrier, places, total
from tenderflow.sources.tables import Tables

TODAY = "2001-08-01"
STAGES = ["intake", "extract", "review", "price", "sent"]
BOARD_STATUS = {"F": "Closed", "P": "Sent"}
BIDS = """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus, o_orderpriority,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0 THEN 'not_bid' WHEN o_orderstatus = 'F' THEN 'won' WHEN o_orderstatus = 'O' THEN 'lost' END AS outcome,
  ['intake', 'extract', 'review', 'price', 'sent'][1 + o_orderkey % 5] AS stage FROM orders"""


def bids(t: Tables) -> DataFrame:
    outcome = (
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 2 == 0), "not_bid")
        .when(F.col("o_orderstatus") == "F", "won")
        .when(F.col("o_orderstatus") == "O", "lost")
    )
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority", outcome.alias("outcome"), stage.alias("stage"))


def win_rate(outcome: Column) -> Column:
    won, lost = F.count_if(outcome == "won"), F.count_if(outcome == "lost")
    return history.percent(won, won + lost).cast("long")


WON, LOST = "count(*) FILTER (WHERE outcome = 'won')", "count(*) FILTER (WHERE outcome = 'lost')"
RATE = f"CAST({places(f'100 * CAST({WON} AS DOUBLE) / nullif({WON} + {LOST}, 0)', 0)} AS BIGINT) AS win_rate"


@carrier(f"""SELECT b.o_orderkey, c_name AS customer, coalesce(n, 0) AS lines, coalesce(flagged, 0) AS flagged, coalesce(events, 0) AS calls
  FROM ({BIDS}) b LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS flagged FROM lineitem GROUP BY ALL) l ON b.o_orderkey = l_orderkey
  LEFT JOIN (SELECT user_id, count(*) AS events FROM events GROUP BY ALL) e ON o_custkey = user_id""")
def q_board(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("flagged"))
    calls = t.events.groupBy("user_id").agg(F.count("*").alias("calls"))
    people = t.customer.select("c_custkey", F.col("c_name").alias("customer"))
    joined = (
        bids(t)
        .join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(calls, F.col("o_custkey") == F.col("user_id"), "left")
    )
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("lines", "flagged", "calls")]
    return joined.select("o_orderkey", "customer", *zero)


@carrier(f"""SELECT o_orderkey, CASE WHEN outcome = 'not_bid' THEN 'Shelved' WHEN outcome = 'won' THEN 'Closed' WHEN o_orderstatus = 'P' THEN 'Sent'
  WHEN stage = 'extract' THEN 'Extracting' WHEN stage = 'review' THEN 'Review' WHEN stage = 'intake' THEN 'Intake' ELSE 'In progress' END AS board_status FROM ({BIDS})""")
def q_board_status(t: Tables) -> DataFrame:
    status = (
        F.when(F.col("outcome") == "not_bid", "Shelved")
        .when(F.col("outcome") == "won", "Closed")
        .when(F.col("o_orderstatus") == "P", "Sent")
        .when(F.col("stage") == "extract", "Extracting")
        .when(F.col("stage") == "review", "Review")
        .when(F.col("stage") == "intake", "Intake")
        .otherwise("In progress")
    )
    return bids(t).select("o_orderkey", status.alias("board_status"))


@carrier(f"SELECT {WON} AS won, {LOST} AS lost, {RATE} FROM ({BIDS})")
def q_win_rate(t: Tables) -> DataFrame:
    outcome = F.col("outcome")
    return bids(t).agg(F.count_if(outcome == "won").alias("won"), F.count_if(outcome == "lost").alias("lost"), win_rate(outcome).alias("win_rate"))


@carrier(f"""WITH s(stage) AS (VALUES ('intake'), ('extract'), ('review'), ('price'), ('sent'), ('archived')),
  n AS (SELECT s.stage, count(o_orderkey) AS n, coalesce({total("o_totalprice")}, 0) AS value FROM s LEFT JOIN ({BIDS}) b ON s.stage = b.stage GROUP BY ALL)
  SELECT *, {places("CAST(n AS DOUBLE) / max(n) OVER ()", 4)} AS width FROM n""")
def q_pipeline_by_stage(t: Tables) -> DataFrame:
    fixed = t.spark.createDataFrame([(s,) for s in [*STAGES, "archived"]], "stage string")
    counted = bids(t).groupBy("stage").agg(F.count("*").alias("n"), m.exact_sum(F.col("o_totalprice")).alias("value"))
    out = fixed.join(counted, "stage", "left").select("stage", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return out.withColumn("width", F.round(F.col("n") / F.max("n").over(W.partitionBy()), 4))


@carrier(f"SELECT o_custkey, count(*) AS n, {total('o_totalprice')} AS value FROM ({BIDS}) WHERE outcome IS NULL GROUP BY ALL")
def q_estimator_load(t: Tables) -> DataFrame:
    return bids(t).where("outcome IS NULL").groupBy("o_custkey").agg(F.count("*").alias("n"), m.exact_sum(F.col("o_totalprice")).alias("value"))


@carrier(f"SELECT o_custkey, {WON} AS won, {LOST} AS lost, {RATE} FROM ({BIDS}) GROUP BY ALL")
def q_win_by_person(t: Tables) -> DataFrame:
    outcome = F.col("outcome")
    return bids(t).groupBy("o_custkey").agg(F.count_if(outcome == "won").alias("won"), F.count_if(outcome == "lost").alias("lost"), win_rate(outcome).alias("win_rate"))


@carrier(f"""SELECT coalesce(nullif(trim(CASE WHEN c_mktsegment = 'FURNITURE' THEN ' ' ELSE c_mktsegment END), ''), 'Unbranded') AS brand, count(*) AS n, {total("o_totalprice")} AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def q_value_by_brand(t: Tables) -> DataFrame:
    raw = F.when(F.col("c_mktsegment") == "FURNITURE", " ").otherwise(F.col("c_mktsegment"))
    brand = F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit("Unbranded"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(brand.alias("brand")).agg(F.count("*").alias("n"), m.exact_sum(F.col("o_totalprice")).alias("value"))


DUE = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END"


@carrier(f"""SELECT CAST(row_number() OVER (ORDER BY {DUE} NULLS LAST, o_totalprice DESC, o_orderkey DESC) AS BIGINT) AS place, o_orderkey, {DUE} AS due FROM orders WHERE o_orderstatus = 'P'""")
def q_due_order(t: Tables) -> DataFrame:
    due = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("date"))
    rows = t.orders.where("o_orderstatus = 'P'").withColumn("due", due).withColumn("thousands", F.floor(F.col("o_totalprice") / 1000))
    rows = h.numbered(rows, {"due": False, "thousands": True}, [F.desc("o_totalprice"), F.desc("o_orderkey")])
    return rows.select("place", "o_orderkey", "due")


@carrier(f"""WITH x AS (SELECT o_orderkey, date_diff('day', DATE '{TODAY}', CAST(o_orderdate AS DATE)) + 200 AS d FROM orders)
  SELECT o_orderkey, d AS days, CASE WHEN d < 0 THEN 'overdue ' || -d || 'd' WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'tomorrow' ELSE 'in ' || d || 'd' END AS label FROM x""")
def q_due_label(t: Tables) -> DataFrame:
    days = (F.datediff(F.col("o_orderdate").cast("date"), F.lit(TODAY).cast("date")) + 200).cast("long")
    text = days.cast("string")
    label = (
        F.when(days < 0, F.concat(F.lit("overdue "), (-days).cast("string"), F.lit("d")))
        .when(days == 0, "today")
        .when(days == 1, "tomorrow")
        .otherwise(F.concat(F.lit("in "), text, F.lit("d")))
    )
    return t.orders.select("o_orderkey", days.alias("days"), label.alias("label"))


@carrier(f"""SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_shipdate < DATE '{TODAY}' - 730) AS lapsed, count(*) FILTER (WHERE l_quantity IS NULL OR l_orderkey % 7 = 0) AS unpriced,
  count(*) FILTER (WHERE l_returnflag = 'R') AS flagged FROM lineitem GROUP BY ALL""")
def q_readiness(t: Tables) -> DataFrame:
    lapsed = m.lapsed(F.datediff(F.lit(TODAY).cast("date"), F.col("l_shipdate")), 730)
    unpriced = F.col("l_quantity").isNull() | (F.col("l_orderkey") % 7 == 0)
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(lapsed).alias("lapsed"), F.count_if(unpriced).alias("unpriced"), F.count_if(F.col("l_returnflag") == "R").alias("flagged"))


@carrier("SELECT p_partkey, p_name, p_retailprice, count(*) OVER () AS total FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
def q_paged_scan(t: Tables) -> DataFrame:
    found = t.part.where("p_size > 10").select("p_partkey", "p_name", "p_retailprice")
    page = found.orderBy(F.desc("p_retailprice"), "p_partkey").offset(50).limit(25)
    return page.join(F.broadcast(found.agg(F.count("*").alias("total"))))


@carrier("SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey, s_suppkey LIMIT 200")
def q_header_projection(t: Tables) -> DataFrame:
    return t.supplier.drop("s_name", "s_acctbal").orderBy("s_nationkey", "s_suppkey").limit(200).select("s_suppkey", "s_nationkey")


@carrier("""WITH w(pos, k) AS (VALUES (0, 7), (1, 3), (2, 999999999), (3, 11)) SELECT CAST(pos AS INTEGER) AS pos, p_partkey, p_name FROM w JOIN part ON k = p_partkey""")
def q_multiget_ordered(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([(p, k) for p, k in enumerate([7, 3, 999999999, 11])], "pos int, k long")
    return t.part.join(F.broadcast(wanted), F.col("p_partkey") == F.col("k")).select("pos", "p_partkey", "p_name").orderBy("pos")


@carrier("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#99' OR NOT EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#99')")
def q_filter_or_all(t: Tables) -> DataFrame:
    match = F.col("p_brand") == "Brand#99"
    some = t.part.agg(F.coalesce(F.bool_or(match), F.lit(False)).alias("some"))
    return t.part.join(F.broadcast(some), match | ~F.col("some")).select("p_partkey", "p_brand")


@carrier("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) <= 2")
def q_topk_per_key(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").distinct()
    return history.first_per_key(rows, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_partkey")], 2)


@carrier("""WITH l AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) = 1)
  SELECT o_orderkey, l_partkey, l_quantity, p_name FROM orders LEFT JOIN l ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10""")
def q_match_lookup(t: Tables) -> DataFrame:
    last = history.first_per_key(t.lineitem, ["l_orderkey"], [F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_quantity")]).select("l_orderkey", "l_partkey", "l_quantity")
    part = t.part.where("p_size > 10").select("p_partkey", "p_name")
    joined = t.orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select("o_orderkey", "l_partkey", "l_quantity", "p_name")


@carrier("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_anti_join(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@carrier("""SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS roles FROM events GROUP BY ALL HAVING list_has_any(list(event_type), ['purchase', 'signup'])""")
def q_array_overlap(t: Tables) -> DataFrame:
    roles = t.events.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("roles"))
    wanted = F.array(F.lit("purchase"), F.lit("signup"))
    return roles.where(F.arrays_overlap("roles", wanted)).select("user_id", F.array_join("roles", ",").alias("roles"))


@carrier("SELECT p_partkey FROM part WHERE nullif(p_brand, 'Brand#3') IS DISTINCT FROM 'Brand#7'")
def q_null_safe_ne(t: Tables) -> DataFrame:
    return t.part.where(~F.nullif("p_brand", F.lit("Brand#3")).eqNullSafe("Brand#7")).select("p_partkey")


@carrier("SELECT DISTINCT g FROM (SELECT l_returnflag AS g FROM lineitem UNION ALL SELECT o_orderstatus FROM orders UNION ALL SELECT 'X') WHERE g IS NOT NULL")
def q_distinct_groups(t: Tables) -> DataFrame:
    a, b = t.lineitem.select(F.col("l_returnflag").alias("g")), t.orders.select(F.col("o_orderstatus").alias("g"))
    return a.union(b).union(t.spark.createDataFrame([("X",)], "g string")).where("g IS NOT NULL").distinct()


@carrier("""SELECT source, id, name FROM (SELECT 0 AS source, p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE '%cold%' UNION ALL SELECT 1, s_suppkey, s_name FROM supplier WHERE s_name LIKE '%1%')
  ORDER BY source, id LIMIT 40""")
def q_union_priority(t: Tables) -> DataFrame:
    a = t.part.where(F.col("p_name").contains("cold")).select(F.lit(0).alias("source"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    b = t.supplier.where(F.col("s_name").contains("1")).select(F.lit(1).alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.union(b).orderBy("source", "id").limit(40)


SOURCED = "SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN 'ingest' WHEN 1 THEN 'x/CATALOG.md' WHEN 2 THEN '' END AS seed FROM part"


@carrier(f"SELECT p_partkey FROM ({SOURCED}) WHERE coalesce(seed, '') <> 'ingest' AND (regexp_matches(seed, '(?i)catalog\\.md') OR seed IS NULL OR seed = '')")
def q_trusted_rows(t: Tables) -> DataFrame:
    seed = F.when(F.col("p_partkey") % 4 == 0, "ingest").when(F.col("p_partkey") % 4 == 1, "x/CATALOG.md").when(F.col("p_partkey") % 4 == 2, "")
    trusted = ~seed.eqNullSafe("ingest") & (F.lower(seed).contains("catalog.md") | seed.isNull() | (seed == ""))
    return t.part.where(trusted).select("p_partkey")


@carrier("SELECT p_partkey FROM part WHERE replace(p_name, ' ', '_') = 'cold_widget' OR p_name = 'cold widget' OR contains(lower(p_brand), 'brand#1')")
def q_vendor_filter(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.where((F.replace(name, F.lit(" "), F.lit("_")) == "cold_widget") | (name == "cold widget") | F.lower("p_brand").contains("brand#1")).select("p_partkey")


@carrier("SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 1 AND coalesce(CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN false END, false) = false")
def q_scoped_alive(t: Tables) -> DataFrame:
    deleted = F.when(F.col("o_orderkey") % 4 == 0, True).when(F.col("o_orderkey") % 4 == 1, False)
    return t.orders.where((F.col("o_custkey") % 3 == 1) & ~F.coalesce(deleted, F.lit(False))).select("o_orderkey")


@carrier("SELECT doc_id FROM documents WHERE contains(lower(text), 'license.') OR starts_with(lower(text), 'the ')")
def q_search_contains(t: Tables) -> DataFrame:
    text = F.lower("text")
    return t.documents.where(text.contains("license.") | text.startswith("the ")).select("doc_id")


CONF = "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (p_size % 20) / CAST(20 AS DOUBLE) END AS conf, p_partkey % 6 = 0 AS dup, p_partkey % 5 = 0 AS flagged, p_name FROM part"


def confident(t: Tables) -> DataFrame:
    conf = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") % 20 / 20)
    return t.part.select("p_partkey", conf.alias("conf"), (F.col("p_partkey") % 6 == 0).alias("dup"), (F.col("p_partkey") % 5 == 0).alias("flagged"), "p_name")


@carrier(f"SELECT p_partkey, CASE WHEN dup THEN 'duplicate' WHEN flagged OR conf < 0.75 THEN 'needs_look' ELSE 'clear' END AS status FROM ({CONF})")
def q_status_for(t: Tables) -> DataFrame:
    status = F.when(F.col("dup"), "duplicate").when(F.col("flagged") | (F.col("conf") < 0.75), "needs_look").otherwise("clear")
    return confident(t).select("p_partkey", status.alias("status"))


@carrier(f"""SELECT CASE WHEN conf < 0.75 THEN 'red' WHEN flagged OR conf IS NULL THEN 'yellow' WHEN conf >= 0.9 THEN CASE WHEN dup THEN 'red' ELSE 'green' END ELSE 'yellow' END AS level, count(*) AS n FROM ({CONF}) GROUP BY ALL""")
def q_confidence_levels(t: Tables) -> DataFrame:
    conf = F.col("conf")
    green = F.when(F.col("dup"), "red").otherwise("green")
    level = F.when(conf < 0.75, "red").when(F.col("flagged") | conf.isNull(), "yellow").when(conf >= 0.9, green).otherwise("yellow")
    return confident(t).groupBy(level.alias("level")).agg(F.count("*").alias("n"))


AGE = f"date_diff('day', CAST(o_orderdate AS DATE), DATE '{TODAY}') - 100"


@carrier(f"SELECT o_orderkey, CASE WHEN {AGE} < 0 THEN 'future_dated' WHEN {AGE} <= 183 THEN 'fresh' WHEN {AGE} <= 1095 THEN 'unreliable' ELSE 'stale' END AS class FROM orders")
def q_freshness(t: Tables) -> DataFrame:
    age = F.datediff(F.lit(TODAY).cast("date"), F.col("o_orderdate").cast("date")) - 100
    return t.orders.select("o_orderkey", m.freshness(age, 183, 1095).alias("class"))


@carrier(f"SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE {AGE} END > 730, false) AS lapsed FROM orders")
def q_lapsed(t: Tables) -> DataFrame:
    age = F.datediff(F.lit(TODAY).cast("date"), F.col("o_orderdate").cast("date")) - 100
    return t.orders.select("o_orderkey", m.lapsed(F.when(F.col("o_orderkey") % 8 != 0, age), 730).alias("lapsed"))
