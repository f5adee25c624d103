"""Schedules, grids and JSON values: parts as schedule rows and price tables, documents as sheets, events as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import json as j
from tenderflow.operators import grids, nested, schedules
from tenderflow.plans.base import carrier
from tenderflow.sources.tables import Tables
from tenderflow.streaming import sessions


def by_rest(key: Column, *values: Column | str | None) -> Column:
    """The value whose place is the rest of key by their number."""
    out = None
    for i, v in enumerate(values):
        value = F.lit(v) if v is None or isinstance(v, str) else v
        out = F.when(key % len(values) == i, value) if out is None else out.when(key % len(values) == i, value)
    return out


@carrier("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '3' WHEN 1 THEN '1 1/2' WHEN 3 THEN '2' END AS qty, CASE p_partkey % 5 WHEN 0 THEN 'EA.' WHEN 1 THEN 'PR.' WHEN 3 THEN 'EA.' END AS unit,
  CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_brand WHEN 2 THEN p_name || ' MIL' WHEN 3 THEN 'WALL STOP 236W' END AS description,
  CASE p_partkey % 5 WHEN 0 THEN 'BB' || p_partkey WHEN 1 THEN CAST(350 + p_partkey % 10 AS VARCHAR) WHEN 3 THEN '236W' END AS part, CASE p_partkey % 5 WHEN 0 THEN 'US26D' WHEN 1 THEN '626' END AS finish,
  CASE p_partkey % 5 WHEN 0 THEN 'Hager' WHEN 1 THEN 'Pemko' WHEN 3 THEN 'IVES' END AS manufacturer, CASE p_partkey % 5 WHEN 0 THEN 'GC' END AS supplied_by,
  CASE p_partkey % 5 WHEN 0 THEN '3 EA. ' || p_name || ' | BB' || p_partkey || ' | US26D | HAGER | GC' WHEN 1 THEN '1 1/2 PR. ' || p_name || ' | ' || (350 + p_partkey % 10) || ' ' || p_brand || ' | 626 | PEMKO'
    WHEN 2 THEN p_name || ' | MIL' WHEN 3 THEN '2 | EA. WALL STOP 236W | IVES' ELSE '' END AS raw_row,
  CASE WHEN p_partkey % 5 IN (2, 4) THEN 'part_missing,manufacturer_missing,qty_missing' ELSE '' END AS flags FROM part""")
def q_classify_cells(t: Tables) -> DataFrame:
    """Rows of a hardware schedule: whole, with a part of three digits, without a maker, with the part in the prose, and empty."""
    key = F.col("p_partkey")
    cells = by_rest(
        key,
        F.array(F.concat(F.lit("3 EA.  "), "p_name"), F.concat(F.lit("BB"), key.cast("string")), F.lit("US26D"), F.lit("Hager"), F.lit("gc")),
        F.array(F.concat(F.lit("1 1/2 PR. "), "p_name"), F.concat_ws(" ", (350 + key % 10).cast("string"), "p_brand"), F.lit("626"), F.lit("PEMKO")),
        F.array(F.col("p_name"), F.lit(" "), F.lit("MIL")),
        F.array(F.lit("2"), F.lit("EA. WALL STOP 236W"), F.lit("IVES")),
        F.lit(None).cast("array<string>"),
    )
    upper = F.transform(cells, lambda x: F.when(x.isin("Hager", "gc"), F.upper(x)).otherwise(x))
    found = schedules.hardware_items(t.part.withColumn("cells", upper))
    return found.select("p_partkey", "qty", "unit", "description", "part", "finish", "manufacturer", "supplied_by", "raw_row", F.array_join("flags", ",").alias("flags"))


def accessories(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    line = by_rest(
        key,
        F.concat(F.lit("4 EA. Grab bar  BOBRICK B-"), (5806 + key % 100).cast("string")),
        F.concat(F.lit("Robe hook, ASI Model No. 0"), (700 + key % 10).cast("string"), F.lit(".")),
        "MIRROR by others", "FINAL HOOK-UPS", "12 SOAP DISPENSER WORLD DRYER", F.concat(F.lit("SHELF, bradley 755-"), F.col("p_size").cast("string")), None,
    )
    return schedules.accessory_lines(t.part.select("p_partkey", "p_type", "p_size", line.alias("line")))


ACCESSORIES = """SELECT p_partkey, p_type, p_size, CASE p_partkey % 7 WHEN 0 THEN 'grab_bar' WHEN 1 THEN 'coat_hook' WHEN 2 THEN 'mirror' WHEN 4 THEN 'soap_dispenser' WHEN 5 THEN 'shelf' END AS product_type,
  CASE p_partkey % 7 WHEN 1 THEN 'robe_hook' END AS alternate, CASE p_partkey % 7 WHEN 0 THEN 'Bobrick' WHEN 1 THEN 'ASI' WHEN 4 THEN 'World Dryer' WHEN 5 THEN 'Bradley' END AS manufacturer,
  CASE p_partkey % 7 WHEN 0 THEN 'B-' || (5806 + p_partkey % 100) WHEN 1 THEN '0' || (700 + p_partkey % 10) WHEN 5 THEN '755-' || p_size END AS specified_model,
  CAST(CASE p_partkey % 7 WHEN 0 THEN 4 WHEN 4 THEN 12 END AS DOUBLE) AS qty, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'product_type_ambiguous,qty_not_stated'
    WHEN 2 THEN 'manufacturer_missing,specified_model_missing,qty_not_stated' WHEN 4 THEN 'specified_model_missing' ELSE 'qty_not_stated' END AS flags,
  CAST(CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 0.7 WHEN 2 THEN 0.55 ELSE 0.85 END AS DOUBLE) AS confidence FROM part WHERE p_partkey % 7 NOT IN (3, 6)"""


@carrier(f"SELECT p_partkey, product_type, alternate, manufacturer, specified_model, qty, flags, confidence FROM ({ACCESSORIES})")
def q_product_types(t: Tables) -> DataFrame:
    return accessories(t).select("p_partkey", "product_type", "alternate", "manufacturer", "specified_model", "qty", F.array_join("flags", ",").alias("flags"), "confidence")


@carrier(f"""WITH k AS (SELECT *, CASE WHEN manufacturer IS NOT NULL AND specified_model IS NOT NULL THEN 'item' ELSE 'mention' END AS kind FROM ({ACCESSORIES}))
  SELECT p_type, kind, product_type, CASE WHEN kind = 'item' THEN specified_model END AS model, min_by(p_partkey, (p_size, p_partkey)) AS p_partkey FROM k
  GROUP BY p_type, kind, product_type, CASE WHEN kind = 'item' THEN manufacturer END, CASE WHEN kind = 'item' THEN specified_model END, CASE WHEN kind = 'mention' THEN p_size END""")
def q_accessory_schedule(t: Tables) -> DataFrame:
    found = schedules.accessory_schedule(accessories(t), "p_type", "p_size", "p_partkey")
    return found.select("p_type", "kind", "product_type", F.when(F.col("kind") == "item", F.col("specified_model")).alias("model"), "p_partkey")


def sheets(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    more = F.when(key % 10 == 1, "\nTextured  FRP by NUDO\nend").when(key % 10 == 2, "\nEmbossed\nFiberglass reinforced polyester\nASI elsewhere").otherwise("")
    return t.documents.select("doc_id", F.floor(key % 30 / 3).alias("bid"), F.concat(F.coalesce("text", F.lit("")), more).alias("sheet"))


@carrier("""SELECT doc_id, CAST(doc_id % 30 // 3 AS BIGINT) AS bid, CASE doc_id % 10 WHEN 1 THEN 'Textured FRP by NUDO' ELSE 'Fiberglass reinforced polyester' END AS excerpt,
  CASE doc_id % 10 WHEN 1 THEN 'textured' ELSE 'embossed' END AS kinds, CASE doc_id % 10 WHEN 1 THEN 'NUDO' END AS maker FROM documents WHERE doc_id % 10 IN (1, 2)""")
def q_line_evidence(t: Tables) -> DataFrame:
    return schedules.panel_pages(sheets(t), "sheet").select("doc_id", "bid", "excerpt", F.array_join("kinds", ",").alias("kinds"), "maker")


@carrier("""WITH g AS (SELECT CAST(doc_id % 30 // 3 AS BIGINT) AS bid, count(*) FILTER (WHERE doc_id % 10 = 1) AS a, count(*) FILTER (WHERE doc_id % 10 = 2) AS b FROM documents GROUP BY ALL)
  SELECT bid, a + b > 0 AS frp_in_scope, CASE WHEN a + b > 0 THEN 'NOT_MEASURED' ELSE 'NOT_FOUND' END AS status, CASE WHEN a > 0 AND b > 0 THEN 'embossed/textured' WHEN a > 0 THEN 'textured' WHEN b > 0 THEN 'embossed' END AS product_type,
  CASE WHEN a > 0 THEN 'Nudo' END AS manufacturer, a + b AS n_pages, CASE WHEN a + b = 0 THEN 1 WHEN a > 0 THEN 4 ELSE 5 END AS n_flags FROM g""")
def q_panel_findings(t: Tables) -> DataFrame:
    found = schedules.panel_findings(sheets(t), "bid", "doc_id", "sheet")
    return found.withColumn("n_flags", F.size("flags")).drop("flags")


@carrier("""WITH p AS (SELECT p_partkey // 20 AS page, p_partkey % 20 AS r, p_size, unnest(range(8)) AS i FROM part),
  c AS (SELECT *, CASE WHEN page % 2 = 0 THEN 6 + 2 * i ELSE 6 + 2 * i + 2 * (i // 3) END AS width, p_size * 7 * (i + 3) % 900 AS price FROM p WHERE page % 5 <> 4 AND r <> 13 AND (p_size + i) % 3 <> 0)
  SELECT page, CAST(10 + r AS INTEGER) AS height, CAST(width AS INTEGER) AS width, CAST(price AS INTEGER) AS price FROM (SELECT *, count(*) OVER (PARTITION BY page, r) AS held FROM c) WHERE held >= 4""")
def q_grid_pivot(t: Tables) -> DataFrame:
    """Twenty parts make a page: its header, a row of prices each, one row that repeats the widths, and a number that is no price.

    Every fifth page climbs in threes and is no grid.
    """
    i, page, row = F.col("i"), F.floor(F.col("p_partkey") / 20), F.col("p_partkey") % 20
    parts = t.part.select(page.alias("page"), row.alias("row"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    width = F.when(F.col("page") % 5 == 4, 6 + 3 * i).when(F.col("page") % 2 == 0, 6 + 2 * i).otherwise(6 + 2 * i + 2 * F.floor(i / 3))
    at = (100 + 40 * i).cast("double")

    def word(text: Column, end: Column, y: Column) -> list[Column]:
        return ["page", (end - 20).alias("x0"), end.alias("x1"), y.cast("double").alias("y0"), text.cast("string").alias("word")]

    down = 20 + 10 * F.col("row")
    echo, kept = F.col("row") == 13, (F.col("p_size") + i) % 3 != 0
    words = parts.where("row = 0").select(*word(width, at - F.when(i == 0, 3.5).otherwise(0.0), F.lit(10)))
    words = words.unionByName(parts.where(echo | kept).select(*word(F.when(echo, width).otherwise(F.col("p_size") * 7 * (i + 3) % 900), at, down)))
    words = words.unionByName(parts.where("i = 0").select(*word(10 + F.col("row"), F.lit(60.0), down)))
    words = words.unionByName(parts.where("i = 0 AND row = 19").select(*word(F.lit(17), F.lit(700.0), down)))
    return grids.price_grid(words)


@carrier("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem), e AS (SELECT o_orderkey, 0 AS part, 0 AS line, 0 AS deep, o_custkey AS id FROM orders
    UNION ALL SELECT l_orderkey, 1, line, 0, l_linenumber FROM l UNION ALL SELECT l_orderkey, 1, line, 1, l_partkey FROM l UNION ALL SELECT l_orderkey, 1, line, 2, l_suppkey FROM l
    UNION ALL SELECT l_orderkey, 2, 0, 0, count(*) FROM l GROUP BY l_orderkey)
  SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY part, line, deep) - 1 AS INTEGER) AS pos, id FROM e""")
def q_harvest(t: Tables) -> DataFrame:
    """Orders as documents: the customer as an item, lines as openings with parts nested in their items, the count in a group."""
    part = F.struct(F.col("l_partkey").alias("id"), F.array(F.struct(F.col("l_suppkey").alias("id"))).alias("items"))
    opening = F.struct(F.col("l_linenumber").alias("line"), F.array(F.struct(F.col("l_linenumber").alias("id"), F.array(part).alias("items"))).alias("items"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(opening)).alias("openings"), F.count("*").alias("n"))
    rows = t.orders.join(lines, "o_orderkey", "left")
    groups = F.when(F.col("n").isNotNull(), F.struct(F.array(F.struct(F.col("n").alias("id"))).alias("items")))
    doc = F.to_json(F.struct(groups.alias("groups"), "openings", F.array(F.struct(F.col("o_custkey").alias("id"))).alias("items"), F.array(F.struct(F.lit(7).alias("id"))).alias("others")))
    found = nested.harvested(rows.select("o_orderkey", doc.alias("doc")), "o_orderkey", "doc")
    return found.select("o_orderkey", "pos", F.get_json_object("item", "$.id").cast("long").alias("id"))


@carrier("SELECT event_id, event_id % 4 > 1 AS whole, CASE WHEN event_id % 4 > 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def q_json_or_null(t: Tables) -> DataFrame:
    text = by_rest(F.col("event_id"), None, F.left("props", F.lit(3)), F.col("props"), F.col("props"))
    rows = t.events.select("event_id", j.json_or_null(text).alias("payload"))
    return rows.select("event_id", F.col("payload").isNotNull().alias("whole"), F.try_variant_get("payload", "$.k", "bigint").alias("k"))


ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 <> 0 THEN strftime({0}, '.%f') ELSE '' END"


@carrier(f"""SELECT event_id AS id, {ISO.format("ts")} AS ts, event_id AS inner_id, {ISO.format("date_trunc('second', ts)")} AS first_at, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events""")
def q_json_safe(t: Tables) -> DataFrame:
    times = F.array(F.struct(F.date_trunc("second", "ts").alias("at")))
    rows = t.events.select(F.col("event_id").alias("_id"), "ts", F.struct(F.col("event_id").alias("_id"), times.alias("times"), F.to_date("ts").alias("day")).alias("more"))
    safe = j.safe_rows(rows)
    return safe.select("id", "ts", F.col("more.id").alias("inner_id"), F.col("more.times")[0]["at"].alias("first_at"), F.col("more.day").alias("day"))


@carrier("""SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN ['doors', 'accessories'] WHEN 1 THEN ['accessories'] ELSE ['doors', 'hardware'] END) AS band,
  CAST(unnest(CASE p_partkey % 4 WHEN 0 THEN [p_size / 100, 0.25] WHEN 1 THEN [0.5] ELSE [0.3, 0.4] END) AS DOUBLE) AS margin FROM part""")
def q_bands(t: Tables) -> DataFrame:
    own = F.concat(F.lit('{"bands": [{"key": "doors", "margin": 0.9}, {"key": "doors", "margin": '), (F.col("p_size") / 100).cast("string"), F.lit('}, {"margin": 0.1}], "accessories_derived": 0.25}'))
    text = by_rest(F.col("p_partkey"), own, '{"bands": [{"key": "accessories", "margin": 0.5}], "accessories_derived": null}', '{"bands": [', None)
    return t.part.select("p_partkey", F.explode(j.margin_bands(text, {"doors": 0.3, "hardware": 0.4})).alias("band", "margin"))


@carrier("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS live FROM events")
def q_live_attempts(t: Tables) -> DataFrame:
    return sessions.live_attempts(t.events, "user_id", "ts").select("event_id", "live")
