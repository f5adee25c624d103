"""Merging, versioning and comparing: two overlapping slices of orders or parts as stored and incoming rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenderflow.operators import history as h
from tenderflow.plans.base import carrier, places
from tenderflow.sources.tables import Tables

STORED = """SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderkey % 5 = 0 AS overridden, o_orderkey % 7 = 0 AS by_hand FROM orders WHERE o_orderkey % 3 <> 0"""
INCOMING = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority,
  o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 4 <> 1"""
LINE_KEY = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
ORDERED = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def stored(t: Tables) -> DataFrame:
    rows = t.orders.where(F.col("o_orderkey") % 3 != 0)
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", (F.col("o_orderkey") % 5 == 0).alias("overridden"), (F.col("o_orderkey") % 7 == 0).alias("by_hand"))


def incoming(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(key % 4 == 0, "X").otherwise(F.col("o_orderstatus"))
    priority = F.when(key % 11 == 0, None).when(key % 13 == 0, "").otherwise(F.col("o_orderpriority"))
    price = F.col("o_totalprice") + F.when(key % 10 == 0, 1).otherwise(0)
    return t.orders.where(key % 4 != 1).select("o_orderkey", status.alias("o_orderstatus"), priority.alias("o_orderpriority"), price.alias("o_totalprice"))


def keyed_lines(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("key", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))


MERGE = f"""SELECT coalesce(s.o_orderkey, i.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN 'insert'
  WHEN i.o_orderkey IS NOT NULL THEN CASE WHEN overridden OR by_hand THEN 'provenance' ELSE 'update' END WHEN by_hand THEN 'keep' ELSE 'delete' END AS action
  FROM ({STORED}) s FULL JOIN ({INCOMING}) i ON s.o_orderkey = i.o_orderkey"""


@carrier(MERGE)
def q_merge_lines(t: Tables) -> DataFrame:
    return h.three_way(stored(t), incoming(t), "o_orderkey")


@carrier(f"SELECT action, count(*) AS n FROM ({MERGE}) GROUP BY ALL")
def q_merge_counts(t: Tables) -> DataFrame:
    return h.three_way(stored(t), incoming(t), "o_orderkey").groupBy("action").agg(F.count("*").alias("n"))


@carrier(f"""SELECT coalesce(s.o_orderkey, i.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NOT NULL AND (i.o_orderkey IS NULL OR overridden OR by_hand) THEN s.o_orderstatus ELSE i.o_orderstatus END AS status
  FROM ({STORED}) s FULL JOIN ({INCOMING}) i ON s.o_orderkey = i.o_orderkey""")
def q_merge_openings(t: Tables) -> DataFrame:
    s, i = stored(t).alias("s"), incoming(t).alias("i")
    joined = s.join(i, F.col("s.o_orderkey") == F.col("i.o_orderkey"), "full_outer")
    mine = F.col("s.o_orderkey").isNotNull() & (F.col("i.o_orderkey").isNull() | F.col("s.overridden") | F.col("s.by_hand"))
    status = F.when(mine, F.col("s.o_orderstatus")).otherwise(F.col("i.o_orderstatus"))
    return joined.select(F.coalesce("s.o_orderkey", "i.o_orderkey").alias("o_orderkey"), status.alias("status"))


@carrier(f"""SELECT coalesce(s.o_orderkey, i.o_orderkey) AS o_orderkey, coalesce(i.o_orderstatus, s.o_orderstatus) AS status, coalesce(s.o_totalprice, i.o_totalprice) AS first_price
  FROM ({STORED}) s FULL JOIN ({INCOMING}) i ON s.o_orderkey = i.o_orderkey""")
def q_merge_upsert(t: Tables) -> DataFrame:
    """Set fields come from the incoming row, insert-only fields stay."""
    s, i = stored(t).alias("s"), incoming(t).alias("i")
    joined = s.join(i, F.col("s.o_orderkey") == F.col("i.o_orderkey"), "full_outer")
    return joined.select(
        F.coalesce("s.o_orderkey", "i.o_orderkey").alias("o_orderkey"),
        F.coalesce("i.o_orderstatus", "s.o_orderstatus").alias("status"),
        F.coalesce("s.o_totalprice", "i.o_totalprice").alias("first_price"),
    )


@carrier(f"""SELECT coalesce(s.o_orderkey, i.o_orderkey) AS o_orderkey, CASE WHEN overridden THEN s.o_orderpriority ELSE coalesce(nullif(i.o_orderpriority, ''), s.o_orderpriority) END AS priority
  FROM ({STORED}) s FULL JOIN ({INCOMING}) i ON s.o_orderkey = i.o_orderkey WHERE i.o_orderkey IS NOT NULL OR by_hand""")
def q_blend(t: Tables) -> DataFrame:
    s, i = stored(t).alias("s"), incoming(t).alias("i")
    joined = s.join(i, F.col("s.o_orderkey") == F.col("i.o_orderkey"), "full_outer").where("i.o_orderkey IS NOT NULL OR s.by_hand")
    blended = F.when(F.col("s.overridden"), F.col("s.o_orderpriority")).otherwise(h.filled(F.col("i.o_orderpriority"), F.col("s.o_orderpriority")))
    return joined.select(F.coalesce("s.o_orderkey", "i.o_orderkey").alias("o_orderkey"), blended.alias("priority"))


@carrier(f"SELECT i.o_orderkey, coalesce(s.o_orderstatus, i.o_orderstatus) AS status, coalesce(s.o_totalprice, i.o_totalprice) AS price FROM ({INCOMING}) i LEFT JOIN ({STORED}) s ON s.o_orderkey = i.o_orderkey")
def q_export_overlay(t: Tables) -> DataFrame:
    joined = incoming(t).alias("i").join(stored(t).alias("s"), F.col("s.o_orderkey") == F.col("i.o_orderkey"), "left")
    return joined.select("i.o_orderkey", F.coalesce("s.o_orderstatus", "i.o_orderstatus").alias("status"), F.coalesce("s.o_totalprice", "i.o_totalprice").alias("price"))


@carrier(f"""SELECT o_orderstatus AS status, o_orderkey FROM ({STORED}) WHERE o_orderstatus NOT IN (SELECT DISTINCT o_orderstatus FROM ({INCOMING}))
  UNION ALL SELECT o_orderstatus, o_orderkey FROM ({INCOMING}) UNION ALL SELECT 'Z', NULL""")
def q_replace_partition(t: Tables) -> DataFrame:
    """Every status present in the incoming rows is replaced whole; a status without items leaves a placeholder."""
    new = incoming(t).select(F.col("o_orderstatus").alias("status"), "o_orderkey")
    old = stored(t).select(F.col("o_orderstatus").alias("status"), "o_orderkey").join(new.select("status").distinct(), "status", "left_anti")
    expected = t.spark.createDataFrame([("X",), ("Z",)], "status string").join(new.select("status").distinct(), "status", "left_anti")
    return old.unionByName(new).unionByName(expected.withColumn("o_orderkey", F.lit(None).cast("long")))


@carrier(f"SELECT o_orderkey, o_orderstatus FROM ({STORED}) UNION ALL SELECT o_orderkey, o_orderstatus FROM ({INCOMING}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({STORED}))")
def q_insert_missing(t: Tables) -> DataFrame:
    old, new = (x(t).select("o_orderkey", "o_orderstatus") for x in (stored, incoming))
    return old.unionByName(new.join(old, "o_orderkey", "left_anti"))


HASH = "sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus)"


@carrier(f"SELECT o_orderkey FROM ({INCOMING}) WHERE {HASH} NOT IN (SELECT {HASH} FROM ({STORED}))")
def q_changed_only(t: Tables) -> DataFrame:
    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("hash", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256))

    return hashed(incoming(t)).join(hashed(stored(t)).select("hash"), "hash", "left_anti").select("o_orderkey")


@carrier("SELECT l_orderkey, bool_and(l_discount <= 0.08 AND l_tax <= 0.07) AS all_match, count(*) AS n FROM lineitem GROUP BY ALL")
def q_all_match(t: Tables) -> DataFrame:
    ok = (F.col("l_discount") <= 0.08) & (F.col("l_tax") <= 0.07)
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_and(ok).alias("all_match"), F.count("*").alias("n"))


@carrier("""WITH d AS (SELECT o_orderkey AS opening, 'price' AS field, 'derived' AS origin FROM orders WHERE o_totalprice > 200000),
  e AS (SELECT o_orderkey AS opening, CASE WHEN o_orderkey % 2 = 0 THEN 'price' ELSE 'note' END AS field, 'agent' AS origin FROM orders WHERE o_orderkey % 3 = 0)
  SELECT * FROM d UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.opening = e.opening AND d.field = e.field)""")
def q_flag_merge(t: Tables) -> DataFrame:
    derived = t.orders.where("o_totalprice > 200000").select(F.col("o_orderkey").alias("opening"), F.lit("price").alias("field"), F.lit("derived").alias("origin"))
    field = F.when(F.col("o_orderkey") % 2 == 0, "price").otherwise("note")
    agent = t.orders.where(F.col("o_orderkey") % 3 == 0).select(F.col("o_orderkey").alias("opening"), field.alias("field"), F.lit("agent").alias("origin"))
    return derived.unionByName(agent.join(derived, ["opening", "field"], "left_anti"))


@carrier("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'fin:' || o_orderstatus ELSE 'finish:' || o_orderstatus END AS raw, o_orderstatus AS finish, CASE WHEN o_orderkey % 5 = 0 THEN 'color=red' END AS notes FROM orders""")
def q_fold_aliases(t: Tables) -> DataFrame:
    """Known spellings of a field fold into it; stray keys go to the notes."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    name = F.when(key % 2 == 0, "fin").otherwise("finish")
    fields = F.map_concat(F.create_map(name, status), F.when(key % 5 == 0, F.create_map(F.lit("color"), F.lit("red"))).otherwise(F.create_map().cast("map<string,string>")))
    rows = t.orders.select("o_orderkey", fields.alias("fields"), F.concat(name, F.lit(":"), status).alias("raw"))
    known = F.coalesce(F.try_element_at("fields", F.lit("finish")), F.try_element_at("fields", F.lit("fin")))
    stray = F.map_filter("fields", lambda k, v: ~k.isin("finish", "fin"))
    notes = F.array_join(F.transform(F.map_entries(stray), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("o_orderkey", "raw", known.alias("finish"), F.nullif(notes, F.lit("")).alias("notes"))


@carrier(f"""SELECT coalesce(s.o_orderkey, i.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN 'added' WHEN i.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN s.o_orderkey IS NOT NULL AND i.o_orderkey IS NOT NULL THEN concat_ws(',', CASE WHEN s.o_orderstatus IS DISTINCT FROM i.o_orderstatus THEN 'o_orderstatus' END,
    CASE WHEN s.o_orderpriority IS DISTINCT FROM i.o_orderpriority THEN 'o_orderpriority' END, CASE WHEN s.o_totalprice IS DISTINCT FROM i.o_totalprice THEN 'o_totalprice' END) END AS fields
  FROM ({STORED}) s FULL JOIN ({INCOMING}) i ON s.o_orderkey = i.o_orderkey
  WHERE s.o_orderkey IS NULL OR i.o_orderkey IS NULL OR s.o_orderstatus IS DISTINCT FROM i.o_orderstatus OR s.o_orderpriority IS DISTINCT FROM i.o_orderpriority OR s.o_totalprice IS DISTINCT FROM i.o_totalprice""")
def q_version_diff(t: Tables) -> DataFrame:
    return h.version_diff(stored(t), incoming(t), "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_totalprice"])


CHAIN = """SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
  lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_by FROM orders"""


def chain(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.row_number().over(w).cast("long").alias("version"), F.lead("o_orderkey").over(w).alias("superseded_by"))


@carrier(CHAIN)
def q_version_chain(t: Tables) -> DataFrame:
    return chain(t)


@carrier(f"SELECT o_custkey, arg_max(o_orderkey, version) AS head, max(version) AS version FROM ({CHAIN}) WHERE superseded_by IS NULL GROUP BY ALL")
def q_version_head(t: Tables) -> DataFrame:
    return chain(t).where("superseded_by IS NULL").groupBy("o_custkey").agg(F.max_by("o_orderkey", "version").alias("head"), F.max("version").alias("version"))


REV = "SELECT o_custkey, min(o_totalprice) AS price, CAST(o_orderdate AS DATE) AS valid_from FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)"
SCD = f"SELECT *, lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS valid_to FROM ({REV})"


def revisions(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("valid_from")).agg(F.min("o_totalprice").alias("price"))
    return h.intervals(rows, ["o_custkey"], "valid_from")


@carrier(SCD)
def q_scd2(t: Tables) -> DataFrame:
    return revisions(t)


ASK = "SELECT c_custkey, CAST(o_orderdate AS DATE) AS asked FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey % 2 = 0 GROUP BY ALL"


def asked(t: Tables) -> DataFrame:
    joined = t.customer.join(t.orders.where(F.col("o_orderkey") % 2 == 0), F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("c_custkey", F.col("o_orderdate").cast("date").alias("asked")).distinct()


@carrier(f"SELECT c_custkey, asked, price FROM ({ASK}) LEFT JOIN ({SCD}) ON c_custkey = o_custkey AND valid_from <= asked AND (valid_to IS NULL OR valid_to > asked)")
def q_in_force(t: Tables) -> DataFrame:
    fits = (F.col("c_custkey") == F.col("o_custkey")) & h.in_force(F.col("valid_from"), F.col("valid_to"), F.col("asked"))
    return asked(t).join(revisions(t), fits, "left").select("c_custkey", "asked", "price")


@carrier(f"""SELECT c_custkey, asked, price, valid_from FROM ({ASK}) LEFT JOIN ({SCD}) ON c_custkey = o_custkey AND valid_from <= asked AND (valid_to IS NULL OR asked <= valid_to)
  QUALIFY row_number() OVER (PARTITION BY c_custkey, asked ORDER BY valid_from) = 1""")
def q_asof_closed(t: Tables) -> DataFrame:
    fits = (F.col("c_custkey") == F.col("o_custkey")) & h.as_of_closed(F.col("valid_from"), F.col("valid_to"), F.col("asked"))
    found = asked(t).join(revisions(t), fits, "left")
    return h.first_per_key(found, ["c_custkey", "asked"], [F.col("valid_from")]).select("c_custkey", "asked", "price", "valid_from")


@carrier(f"""WITH x AS (SELECT {LINE_KEY} AS key, row_number() OVER (PARTITION BY {LINE_KEY} ORDER BY {ORDERED}) AS n FROM lineitem)
  SELECT CASE WHEN n = 1 THEN key ELSE key || '#' || CAST(n AS VARCHAR) END AS line_key FROM x""")
def q_distinct_keys(t: Tables) -> DataFrame:
    return keyed_lines(t).select(h.nth_repeat(F.col("key"), [F.col(c) for c in ORDERED.split(", ")]).alias("line_key"))


@carrier("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n, array_to_string(list(l_partkey ORDER BY l_partkey DESC), ',') AS parts FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def q_duplicate_groups(t: Tables) -> DataFrame:
    grouped = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    parts = F.array_join(F.sort_array(F.collect_list("l_partkey"), asc=False), ",")
    return grouped.agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1")


@carrier("""SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY p_name, p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS survivor FROM part""")
def q_survivor_map(t: Tables) -> DataFrame:
    newest = W.partitionBy("p_name", "p_brand").orderBy(F.desc("p_retailprice"), F.desc("p_partkey"))
    return t.part.select("p_partkey", F.first("p_partkey").over(newest).alias("survivor"))


@carrier("SELECT p_name, p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1")
def q_first_per_key(t: Tables) -> DataFrame:
    return h.first_per_key(t.part, ["p_name", "p_brand"], [F.col("p_partkey")]).select("p_name", "p_brand", "p_partkey")


@carrier("""SELECT p_partkey, left(sha1(lower(concat_ws('|', p_name, p_brand, p_type))), 16) AS short_key,
  sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS full_key FROM part""")
def q_content_key(t: Tables) -> DataFrame:
    short = F.substring(F.sha1(F.lower(F.concat_ws("|", "p_name", "p_brand", "p_type")).cast("binary")), 1, 16)
    canonical = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return t.part.select("p_partkey", short.alias("short_key"), F.sha2(canonical, 256).alias("full_key"))


@carrier("SELECT c_mktsegment, coalesce(max(TRY_CAST(replace(c_name, 'Customer#', '') AS BIGINT)), 0) AS highest FROM customer GROUP BY ALL")
def q_max_sequence(t: Tables) -> DataFrame:
    number = F.expr("try_cast(replace(c_name, 'Customer#', '') AS BIGINT)")
    return t.customer.groupBy("c_mktsegment").agg(F.coalesce(F.max(number), F.lit(0).cast("long")).alias("highest"))


@carrier(f"""WITH j AS (SELECT s.o_orderkey, s.o_orderstatus AS a1, i.o_orderstatus AS b1, s.o_orderpriority AS a2, i.o_orderpriority AS b2 FROM ({STORED}) s JOIN ({INCOMING}) i ON s.o_orderkey = i.o_orderkey)
  SELECT o_orderkey, 'status' AS event, a1 AS proposed, b1 AS corrected FROM j WHERE a1 IS DISTINCT FROM b1 UNION ALL SELECT o_orderkey, 'priority', a2, b2 FROM j WHERE a2 IS DISTINCT FROM b2""")
def q_edit_fanout(t: Tables) -> DataFrame:
    """One event for each changed field that is mapped to an event; others are dropped."""
    joined = stored(t).alias("s").join(incoming(t).alias("i"), "o_orderkey")
    fields = {"o_orderstatus": "status", "o_orderpriority": "priority"}
    events = F.array(*[F.struct(F.lit(e).alias("event"), F.col(f"s.{c}").alias("proposed"), F.col(f"i.{c}").alias("corrected")) for c, e in fields.items()])
    rows = joined.select("o_orderkey", F.explode(events).alias("e")).select("o_orderkey", "e.*")
    return rows.where("NOT (proposed <=> corrected)")


@carrier(f"""SELECT s.o_orderkey, coalesce(nullif(CASE WHEN s.o_orderkey % 2 = 0 THEN '' ELSE s.o_orderpriority END, ''), i.o_orderpriority) AS priority,
  CASE WHEN s.o_orderkey % 2 = 0 AND i.o_orderpriority IS NOT NULL THEN 'incoming' ELSE 'stored' END AS source FROM ({STORED}) s JOIN ({INCOMING}) i ON s.o_orderkey = i.o_orderkey""")
def q_fill_empty(t: Tables) -> DataFrame:
    joined = stored(t).alias("s").join(incoming(t).alias("i"), "o_orderkey")
    own = F.nullif(F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("s.o_orderpriority")), F.lit(""))
    source = F.when(own.isNull() & F.col("i.o_orderpriority").isNotNull(), "incoming").otherwise("stored")
    return joined.select("o_orderkey", F.coalesce(own, "i.o_orderpriority").alias("priority"), source.alias("source"))


@carrier("SELECT count(*) FILTER (WHERE p_size > 25) AS matched, count(*) FILTER (WHERE p_size > 25 AND p_type IS DISTINCT FROM 'LARGE') AS changed FROM part")
def q_update_count(t: Tables) -> DataFrame:
    hit = F.col("p_size") > 25
    return t.part.agg(F.count_if(hit).alias("matched"), F.count_if(hit & ~F.col("p_type").eqNullSafe("LARGE")).alias("changed"))


@carrier("""SELECT p_partkey, array_to_string(list_concat(list_filter(['low', 'scope:' || p_type, p_brand], lambda f: NOT starts_with(f, 'scope')), CASE WHEN p_size > 25 THEN ['scope:big'] ELSE [] END), ',') AS flags FROM part""")
def q_array_flags(t: Tables) -> DataFrame:
    flags = F.array(F.lit("low"), F.concat(F.lit("scope:"), "p_type"), F.col("p_brand"))
    kept = F.filter(flags, lambda f: ~f.startswith("scope"))
    added = F.when(F.col("p_size") > 25, F.array_union(kept, F.array(F.lit("scope:big")))).otherwise(kept)
    return t.part.select("p_partkey", F.array_join(added, ",").alias("flags"))


@carrier("""SELECT p_partkey, array_to_string(['cost', 'list'] || [CASE WHEN p_size > 25 THEN 'net' ELSE 'list' END], ',') AS history, CASE WHEN p_size > 25 THEN 'cost,list,net' ELSE 'cost,list' END AS tags FROM part""")
def q_append_history(t: Tables) -> DataFrame:
    base, new = F.array(F.lit("cost"), F.lit("list")), F.array(F.when(F.col("p_size") > 25, "net").otherwise("list"))
    return t.part.select("p_partkey", F.array_join(F.concat(base, new), ",").alias("history"), F.array_join(F.array_union(base, new), ",").alias("tags"))


@carrier("""SELECT p_partkey, CAST(CASE p_type WHEN 'ECONOMY' THEN 0.4 WHEN 'LARGE' THEN 0.6 END AS DOUBLE) AS found, CASE WHEN p_type NOT IN ('ECONOMY', 'LARGE') THEN 'ECONOMY,LARGE' END AS available FROM part""")
def q_map_lookup(t: Tables) -> DataFrame:
    rates = F.create_map(F.lit("LARGE"), F.lit(0.6), F.lit("ECONOMY"), F.lit(0.4))
    found = F.try_element_at(rates, F.col("p_type"))
    known = F.array_join(F.array_sort(F.map_keys(rates)), ",")
    return t.part.select("p_partkey", found.alias("found"), F.when(found.isNull(), known).alias("available"))


@carrier("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, p_brand || '!' AS brand, NULL::VARCHAR AS dropped FROM part""")
def q_map_overlay(t: Tables) -> DataFrame:
    prior = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("old"), F.lit("x"))
    new = F.create_map(F.lit("brand"), F.concat("p_brand", F.lit("!")))
    kept = F.map_filter(prior, lambda k, v: ~F.map_contains_key(new, k) & (k != "old"))
    merged = F.map_concat(kept, new)
    return t.part.select("p_partkey", merged["size"].alias("size"), merged["brand"].alias("brand"), F.try_element_at(merged, F.lit("old")).alias("dropped"))


@carrier("""SELECT event_id, TRY_CAST(replace(CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN '1,' || (100 + event_id % 900) WHEN event_id % 4 = 2 THEN 'n/a' ELSE CAST(value AS VARCHAR) END, ',', '') AS DOUBLE) AS number FROM events""")
def q_num_coerce(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "").when(k == 1, F.concat(F.lit("1,"), (100 + F.col("event_id") % 900).cast("string"))).when(k == 2, "n/a").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", F.regexp_replace(raw, ",", "").try_cast("double").alias("number"))
