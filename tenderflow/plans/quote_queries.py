"""Blocks of a quote, versions compared by mark, steps of state machines, and scope fields filled with their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.operators import history, rollup, transitions
from tenderflow.plans.base import carrier
from tenderflow.plans.merge_queries import INCOMING, STORED, incoming, stored
from tenderflow.sources.tables import Tables

PLACES = {s: i for i, s in enumerate(rollup.SECTIONS, 1)}
TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rollup.SECTIONS.items())
QUOTE_LINES = """SELECT *, (l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq, CASE l_partkey % 6 WHEN 0 THEN '10 28' WHEN 1 THEN ' 08 71 00' WHEN 2 THEN '06 60' WHEN 4 THEN '' WHEN 5 THEN '99' END AS division,
  CASE l_suppkey % 7 WHEN 0 THEN 'accessories' WHEN 1 THEN 'bogus' END AS declared, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'D' || l_linenumber % 2 END AS grp, CASE WHEN l_suppkey % 11 <> 0 THEN l_extendedprice END AS ext FROM lineitem"""


@carrier(f"""WITH s AS (SELECT *, CASE WHEN declared = 'accessories' THEN declared WHEN coalesce(division, '') = '' THEN 'door' WHEN trim(division) LIKE '10%' THEN 'accessories' WHEN trim(division) LIKE '06%' THEN 'frp' WHEN trim(division) LIKE '08%' THEN 'door' ELSE 'other' END AS section FROM ({QUOTE_LINES})),
  g AS (SELECT l_orderkey, section, CASE section {TITLES} END AS title, coalesce(nullif(grp, ''), CASE section {TITLES} END) AS "group", CAST(CAST(arg_min(l_quantity, seq) AS BIGINT) AS VARCHAR) AS opening_size, count(*) AS n_lines, coalesce(sum(CAST(ext AS DECIMAL(18, 2))), 0) AS exact FROM s GROUP BY ALL)
  SELECT l_orderkey, CAST(CASE section {" ".join(f"WHEN '{k}' THEN {i}" for k, i in PLACES.items())} END AS INTEGER) AS place, section, title, "group", opening_size, n_lines, CAST(exact AS DOUBLE) AS subtotal, CAST(sum(exact) OVER (PARTITION BY l_orderkey, section) AS DOUBLE) AS section_total FROM g""")
def q_quote_sections(t: Tables) -> DataFrame:
    part, supp = F.col("l_partkey") % 6, F.col("l_suppkey")
    lines = t.lineitem.select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("seq"), F.when(part == 0, "10 28").when(part == 1, " 08 71 00").when(part == 2, "06 60").when(part == 4, "").when(part == 5, "99").alias("division"),
        F.when(supp % 7 == 0, "accessories").when(supp % 7 == 1, "bogus").alias("group_type"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("D"), (F.col("l_linenumber") % 2).cast("string"))).alias("group"),
        F.col("l_quantity").cast("long").cast("string").alias("opening_size"), F.when(supp % 11 != 0, F.col("l_extendedprice")).alias("ext_price"),
    )
    return rollup.quote_sections(lines, ["l_orderkey"], "seq")


LONG = "an opening whose description runs on past sixty characters, number "
MARK_SQL = f"left(CASE WHEN o_orderkey % 6 = 0 THEN '{LONG}' || o_orderkey ELSE 'M' || o_orderkey END, 60)"
LATEST = "SELECT o_orderkey % 40 AS scope, {mark} AS mark, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(coalesce(o_orderpriority, '~'), o_orderkey) AS p FROM ({rows}) GROUP BY ALL"


@carrier(f"""WITH a AS ({LATEST.format(mark=MARK_SQL, rows=STORED)}), b AS ({LATEST.format(mark=MARK_SQL, rows=INCOMING)}),
  j AS (SELECT coalesce(a.scope, b.scope) AS scope, coalesce(a.mark, b.mark) AS mark, CASE WHEN a.mark IS NULL THEN 'added' WHEN b.mark IS NULL THEN 'removed' WHEN a.s <> b.s OR a.p <> b.p THEN 'changed' END AS change,
    a.s AS s1, b.s AS s2, nullif(a.p, '~') AS p1, nullif(b.p, '~') AS p2 FROM a FULL JOIN b ON a.scope = b.scope AND a.mark = b.mark)
  SELECT scope, mark, change, CASE WHEN change = 'changed' THEN concat_ws(',', CASE WHEN s1 <> s2 THEN 'o_orderstatus' END, CASE WHEN p1 IS DISTINCT FROM p2 THEN 'o_orderpriority' END) END AS fields,
    CASE WHEN change = 'changed' AND s1 <> s2 THEN s1 END AS status_before, CASE WHEN change = 'changed' AND p1 IS DISTINCT FROM p2 THEN p2 END AS priority_after FROM j WHERE change IS NOT NULL""")
def q_marked_diff(t: Tables) -> DataFrame:
    def marked(rows: DataFrame) -> DataFrame:
        key = F.col("o_orderkey")
        return rows.select("o_orderkey", (key % 40).alias("scope"), F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("M"), key.cast("string"))).alias("mark"), F.concat(F.lit(LONG), key.cast("string")).alias("description"), "o_orderstatus", "o_orderpriority")

    found = history.marked_diff(marked(stored(t)), marked(incoming(t)), "scope", ["o_orderstatus", "o_orderpriority"], "o_orderkey")
    return found.select("scope", "mark", "change", F.array_join("fields", ",").alias("fields"), F.try_element_at("before", F.lit("o_orderstatus")).alias("status_before"), F.try_element_at("after", F.lit("o_orderpriority")).alias("priority_after"))


STATES = {"signup": "draft", "view": "priced", "click": "pendingReview", "purchase": "approved", "error": "sent"}
EDGES = ", ".join(f"('{a}', '{b}')" for a, after in transitions.VERSION.items() for b in after)


@carrier(f"""WITH e(a, b) AS (VALUES {EDGES}), s AS (SELECT event_id, user_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())} END AS status, event_id % 3 = 0 AS nobody, event_id % 7 = 0 AS system, ts FROM events),
  p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM s)
  SELECT event_id, was, status, CASE WHEN NOT EXISTS (SELECT 1 FROM e WHERE a = was AND b = status) THEN 'transition' WHEN status = 'approved' AND nobody AND NOT system THEN 'person' END AS fault FROM p WHERE was IS NOT NULL""")
def q_judged_steps(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    steps = t.events.select("event_id", "user_id", "ts", names[F.col("event_type")].alias("status"), F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).otherwise(" ").alias("actor"), (F.col("event_id") % 7 == 0).alias("system"))
    return transitions.judged_steps(steps, "version", "user_id", [F.col("ts"), F.col("event_id")]).select("event_id", "was", "status", "fault")


@carrier("""WITH x AS (SELECT c_custkey, c_custkey % 3 = 0 AS no_name, c_custkey % 4 = 0 AS no_segment, c_custkey % 5 <> 0 AS found_name, c_custkey % 2 = 0 AS has_list, c_custkey % 7 <> 0 AS found_list, c_custkey % 9 <> 0 AS hit, * FROM customer)
  SELECT c_custkey, CASE WHEN no_name THEN CASE WHEN hit AND found_name THEN 'found ' || c_custkey ELSE '' END ELSE c_name END AS name, CASE WHEN NOT no_segment THEN c_mktsegment WHEN hit THEN upper(c_mktsegment) END AS segment,
    CASE WHEN hit AND found_list THEN CASE WHEN has_list THEN 'a,b,c' ELSE 'b,c' END WHEN has_list THEN 'a, b ' END AS alternates,
    concat_ws(',', CASE WHEN hit AND no_name AND found_name THEN 'name' END, CASE WHEN hit AND no_segment THEN 'segment' END, CASE WHEN hit AND found_list THEN 'alternates' END) AS filled,
    CASE WHEN hit AND no_name AND found_name THEN c_custkey % 30 END AS name_page, CASE WHEN hit AND no_segment THEN CAST(7 AS BIGINT) END AS segment_page, CASE WHEN hit AND no_name AND found_name THEN 'f.pdf' END AS name_file FROM x""")
def q_filled_scope(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    kept = t.customer.select("c_custkey", F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(key % 4 != 0, F.col("c_mktsegment")).alias("segment"), F.when(key % 2 == 0, F.array(F.lit("a"), F.lit(" b "))).alias("alternates"))
    sources = F.create_map(F.lit("name"), F.struct((key % 30).alias("page"), F.lit(None).cast("string").alias("file"), F.lit(" seen ").alias("excerpt")))
    found = t.customer.where(key % 9 != 0).select(
        "c_custkey", F.when(key % 5 != 0, F.concat(F.lit("found "), key.cast("string"))).alias("name"), F.upper("c_mktsegment").alias("segment"), F.when(key % 7 != 0, F.array(F.lit("b"), F.lit(" c"), F.lit(""))).alias("alternates"),
        sources.alias("field_sources"), F.lit(7).cast("long").alias("source_page"), F.array(F.lit("f.pdf")).alias("files"),
    )
    rows = history.filled_scope(kept, found, "c_custkey", ["name", "segment"], ["alternates"])
    of = lambda field: F.try_element_at("sources", F.lit(field))
    return rows.select("c_custkey", "name", "segment", F.array_join("alternates", ",").alias("alternates"), F.array_join("filled", ",").alias("filled"), of("name")["page"].alias("name_page"), of("segment")["page"].alias("segment_page"), of("name")["file"].alias("name_file"))
