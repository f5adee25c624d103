"""Part matching: specifications made of part columns against catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import parts as p
from tenderflow.operators import history as h
from tenderflow.operators import matching
from tenderflow.plans.base import carrier, places
from tenderflow.sources.tables import Tables

SPEC = "upper(replace(p_brand, '#', '')) || '-' || p_size || 'A-' || (p_size % 10)"
VENDORS = ["BRAND1", "BRAND2", "BRAND3", "BRAND4", "BRAND5"]


def specs(t: Tables) -> DataFrame:
    size = F.col("p_size")
    spec = F.concat(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("-"), size.cast("string"), F.lit("A-"), (size % 10).cast("string"))
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", spec.alias("spec"))


VEN = "'" + "', '".join(VENDORS) + "'"
BODY = f"CASE WHEN split_part(spec, '-', 1) IN ({VEN}) THEN true ELSE false END AS ven, split_part(spec, '-', 1) AS a, split_part(spec, '-', 2) AS b, split_part(spec, '-', 3) AS c"
CANDS = f"""SELECT p_partkey, spec, list_filter(list_distinct(CASE WHEN ven THEN [spec, b || '-' || c, b] ELSE [spec, a || '-' || b, a] END), lambda x: length(x) >= 2 AND regexp_matches(x, '[0-9]')) AS l, ven, a, b, c
  FROM (SELECT *, {BODY} FROM (SELECT p_partkey, {SPEC} AS spec FROM part))"""


@carrier(f"""SELECT p_partkey, spec, CASE WHEN ven THEN concat_ws(',', spec, b || '-' || c, CASE WHEN length(b) >= 2 THEN b END) ELSE concat_ws(',', spec, a || '-' || b, a) END AS candidates FROM ({CANDS})""")
def q_part_candidates(t: Tables) -> DataFrame:
    return specs(t).select("p_partkey", "spec", F.array_join(p.candidates(F.col("spec"), VENDORS), ",").alias("candidates"))


@carrier(f"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower({SPEC} || ', ' || p_name || ' 83\"'), '[-_/,\\s]+', ' ', 'g'), '[^0-9a-z ]+', '', 'g')) AS spec_key FROM part")
def q_spec_key(t: Tables) -> DataFrame:
    return specs(t).select("p_partkey", p.spec_key(F.concat("spec", F.lit(", "), "p_name", F.lit(' 83"'))).alias("spec_key"))


KEYS = "SELECT p_partkey, p_name || ' ' || (p_size % 7) || CASE WHEN p_size % 2 = 0 THEN 'a' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' 42in' ELSE '' END AS k FROM part"
PARTS = "list_sort(list_distinct(list_filter(string_split({0}, ' '), lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '^[0-9]+(in|ins|inch|inches|ft|feet|mm|cm|m)$'))))"
WORDS = "list_distinct(string_split({0}, ' '))"


def sim(a: str, b: str) -> str:
    x, y, u, v = PARTS.format(a), PARTS.format(b), WORDS.format(a), WORDS.format(b)
    return f"""CAST(CASE WHEN {a} = {b} THEN 1.0 WHEN len({x}) > 0 AND {x} = {y} THEN 0.95 WHEN len({x}) > 0 AND len({y}) > 0 AND len(list_intersect({x}, {y})) = 0 THEN 0.0
      ELSE CAST(len(list_intersect({u}, {v})) AS DOUBLE) / len(list_distinct(list_concat({u}, {v}))) END AS DOUBLE)"""


def keyed(t: Tables) -> DataFrame:
    size = F.col("p_size")
    key = F.concat("p_name", F.lit(" "), (size % 7).cast("string"), F.when(size % 2 == 0, "a").otherwise(""), F.when(size % 3 == 0, " 42in").otherwise(""))
    return t.part.select("p_partkey", key.alias("k"))


@carrier(f"SELECT x.p_partkey, y.p_partkey AS other, {places(sim('x.k', 'y.k'), 6)} AS similarity FROM ({KEYS}) x JOIN ({KEYS}) y ON y.p_partkey = x.p_partkey + 1")
def q_similarity(t: Tables) -> DataFrame:
    a, b = keyed(t).alias("x"), keyed(t).alias("y")
    joined = a.join(b, F.col("y.p_partkey") == F.col("x.p_partkey") + 1)
    return joined.select("x.p_partkey", F.col("y.p_partkey").alias("other"), F.round(p.similarity(F.col("x.k"), F.col("y.k")), 6).alias("similarity"))


LEARNED = f"SELECT k, count(*) AS confirms, count(*) FILTER (WHERE p_partkey % 5 = 0) AS rejects, min(p_partkey) AS part FROM ({KEYS}) GROUP BY ALL"


@carrier(f"""WITH l AS ({LEARNED}), q AS (SELECT DISTINCT k FROM ({KEYS})),
  s AS (SELECT q.k AS asked, l.k AS learned, l.part, {sim('q.k', 'l.k')} AS score, confirms FROM q JOIN l ON len(list_intersect({WORDS.format('q.k')}, {WORDS.format('l.k')})) > 0 WHERE confirms > rejects)
  SELECT asked, learned, part, {places("score * (1 + CAST(0.1 AS DOUBLE) * least(confirms, 5))", 6)} AS rank_score FROM s WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY {places("score * (1 + CAST(0.1 AS DOUBLE) * least(confirms, 5))", 6)} DESC, learned) <= 5""")
def q_recall_match(t: Tables) -> DataFrame:
    """Every key against every learned one, by exact likeness of at least 0.75."""
    learned = keyed(t).groupBy("k").agg(F.count("*").alias("confirms"), F.count_if(F.col("p_partkey") % 5 == 0).alias("rejects"), F.min("p_partkey").alias("part"))
    found = matching.similar_keys(keyed(t).select("k").distinct(), learned.where("confirms > rejects"), "k", 0.75)
    ranked = F.round(F.col("score") * (1 + 0.1 * F.least(F.col("confirms"), F.lit(5))), 6)
    return h.first_per_key(found.withColumn("rank_score", ranked), ["asked"], [F.desc("rank_score"), F.col("learned")], 5).select("asked", "learned", "part", "rank_score")


CATALOG = "SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_size || 'A' ELSE p_size || 'A-' || (p_size % 10) || 'X' END AS item FROM part"


@carrier(f"""WITH s AS (SELECT DISTINCT spec, l FROM ({CANDS})), c AS (SELECT spec, unnest(l) AS cand, generate_subscripts(l, 1) AS pos FROM s), k AS ({CATALOG}),
  m AS (SELECT spec, cand, item, 0 AS mode, pos FROM c JOIN k ON cand = item UNION ALL SELECT spec, cand, item, 1, pos FROM c JOIN k ON starts_with(item, cand) WHERE length(cand) >= 3)
  SELECT spec, arg_min(item, (mode, rank_pos, length(item), item)) AS item FROM (SELECT *, CASE WHEN cand = spec THEN 0 ELSE 100 - length(cand) END AS rank_pos FROM m) GROUP BY ALL""")
def q_part_lookup(t: Tables) -> DataFrame:
    """All exact candidates before any prefix; of prefix hits the shortest item, then the first by name."""
    even = F.col("p_partkey") % 2 == 0
    item = F.concat(F.col("p_size").cast("string"), F.when(even, "A").otherwise(F.concat(F.lit("A-"), (F.col("p_size") % 10).cast("string"), F.lit("X"))))
    catalog = t.part.select(item.alias("item")).distinct()
    asked = specs(t).select("spec").distinct().select("spec", F.posexplode(p.candidates(F.col("spec"), VENDORS)).alias("pos", "cand"))
    exact = asked.join(catalog, F.col("cand") == F.col("item")).withColumn("mode", F.lit(0))
    # a prefix of three letters is an equal key on both sides, so the prefix test is an equi-join with a residue
    near = asked.where(F.length("cand") >= 3).withColumn("head", F.left("cand", F.lit(3)))
    near = near.join(catalog.withColumn("head", F.left("item", F.lit(3))), "head").where(F.col("item").startswith(F.col("cand"))).drop("head").withColumn("mode", F.lit(1))
    order = F.struct("mode", "pos", F.length("item"), "item")
    return exact.unionByName(near).groupBy("spec").agg(F.min_by("item", order).alias("item"))


@carrier("""WITH item AS (SELECT p_type AS k, min(p_partkey) AS id FROM part GROUP BY ALL UNION ALL SELECT upper(string_split(p_name, ' ')[2]), min(p_partkey) FROM part GROUP BY ALL),
  probe AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'no ' || p_name END AS raw FROM part)
  SELECT p_partkey, coalesce(a.id, b.id) AS item FROM probe LEFT JOIN item a ON upper(raw) = a.k LEFT JOIN item b ON upper(string_split(raw, ' ')[-1]) = b.k AND length(string_split(raw, ' ')[-1]) >= 3""")
def q_token_fallback_join(t: Tables) -> DataFrame:
    """The whole text first, else its last token of at least three letters."""
    first = F.min("p_partkey").alias("id")
    by_type, by_word = t.part.groupBy(F.col("p_type").alias("k")).agg(first), t.part.groupBy(F.upper(F.get(F.split("p_name", " "), F.lit(1))).alias("k")).agg(first)
    items = by_type.unionByName(by_word)
    raw = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lit("no "), "p_name"))
    last = F.element_at(F.split(raw, " "), -1)
    keys = F.array_compact(F.array(F.upper(raw), F.when(F.length(last) >= 3, F.upper(last))))
    probe = t.part.select("p_partkey", F.posexplode(keys).alias("pos", "k")).join(items, "k", "left")
    return probe.groupBy("p_partkey").agg(F.min_by("id", F.when(F.col("id").isNotNull(), F.col("pos"))).alias("item"))


@carrier("""WITH b AS (SELECT o_orderkey, o_custkey, o_orderpriority AS gc, CAST(floor(o_totalprice / 50000) AS BIGINT) AS size, o_orderdate FROM orders), q AS (SELECT * FROM b WHERE o_orderkey % 50 = 0),
  p AS (SELECT q.o_orderkey, b.o_orderkey AS prior, b.o_orderdate, CAST(3 * (q.o_custkey = b.o_custkey)::INT + 2 * (q.gc = b.gc)::INT + 2 * (q.size = b.size)::INT AS INTEGER) AS points FROM q JOIN b ON q.o_orderkey <> b.o_orderkey AND (q.o_custkey = b.o_custkey OR q.gc = b.gc OR q.size = b.size)),
  n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, prior DESC) <= 50)
  SELECT o_orderkey, prior, points AS score FROM n QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY points DESC, o_orderdate, prior) <= 5""")
def q_prior_similar(t: Tables) -> DataFrame:
    """For every bid whose key is divisible by 50, the closest of the newest 50 that share customer, priority or size."""
    bids = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("gc"), F.floor(F.col("o_totalprice") / 50000).alias("size"), "o_orderdate")
    found = h.prior_similar(bids.where(F.col("o_orderkey") % 50 == 0), bids, "o_orderkey", {"o_custkey": 3, "gc": 2, "size": 2}, "o_orderdate")
    return found.withColumnRenamed("asked", "o_orderkey")


@carrier("""SELECT p_partkey, CASE upper(regexp_replace(trim(p_brand), '\\s+', ' ', 'g')) WHEN 'BRAND#1' THEN 'FIRST' WHEN 'BRAND#2' THEN 'SECOND' ELSE regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') END AS maker FROM part""")
def q_canonical_name(t: Tables) -> DataFrame:
    name = F.upper(F.regexp_replace(F.trim("p_brand"), r"\s+", " "))
    known = F.when(name == "BRAND#1", "FIRST").when(name == "BRAND#2", "SECOND")
    return t.part.select("p_partkey", F.coalesce(known, F.regexp_replace(name, "[^A-Z0-9]", "")).alias("maker"))


@carrier("""SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN CASE WHEN p_size >= 42 THEN 'W-WIDE' ELSE 'W-STD' END WHEN starts_with(upper(p_name), 'COLD') THEN 'C' ELSE NULL END AS cross_item FROM part""")
def q_crosswalk(t: Tables) -> DataFrame:
    name = F.col("p_name")
    wide = F.when(F.col("p_size") >= 42, "W-WIDE").otherwise("W-STD")
    return t.part.select("p_partkey", F.when(name.contains("widget"), wide).when(F.upper(name).startswith("COLD"), "C").alias("cross_item"))


FINISHES = [("US26D", "626"), ("US10B", "613"), ("US19", "619"), ("US15", "619"), ("US32D", "630")]
F_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in FINISHES)


@carrier(f"""WITH f(us, num) AS (VALUES {F_ROWS}), x AS (SELECT p_partkey, ['US26D', '26D', '626', '619', 'ZZ', '10B'][1 + p_size % 6] AS raw FROM part),
  m AS (SELECT p_partkey, raw, count(us) AS n, min(us) AS us, min(num) AS num FROM x LEFT JOIN f ON raw = us OR 'US' || raw = us OR raw = num GROUP BY ALL)
  SELECT p_partkey, raw, CASE WHEN n = 1 THEN us || ' (' || num || ')' END AS finish, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 0 THEN 'finish_unrecognized' END AS flag FROM m""")
def q_finish_resolve(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(FINISHES, "us string, num string")
    spelled = table.select("us", "num", F.explode(F.array("us", F.expr("substr(us, 3)"), "num")).alias("raw"))
    named = spelled.groupBy("raw").agg(F.count_distinct("us").alias("n"), F.min("us").alias("us"), F.min("num").alias("num"))
    raws = F.array(*[F.lit(x) for x in ("US26D", "26D", "626", "619", "ZZ", "10B")])
    asked = t.part.select("p_partkey", F.get(raws, F.col("p_size") % 6).alias("raw"))
    finish = F.when(F.col("n") == 1, F.concat("us", F.lit(" ("), "num", F.lit(")")))
    flag = F.when(F.col("n") > 1, "ambiguous").when(F.col("n").isNull(), "finish_unrecognized")
    return asked.join(F.broadcast(named), "raw", "left").select("p_partkey", "raw", finish.alias("finish"), flag.alias("flag"))


@carrier("""WITH x AS (SELECT p_partkey, ['8" CMU wall', 'glass', 'metal stud', 'CMU', 'gyp board on metal'][1 + p_size % 5] AS wall FROM part)
  SELECT p_partkey, wall, CASE WHEN lower(wall) = 'cmu' OR contains(lower(wall), 'cmu') OR contains(lower(wall), 'masonry') THEN 'masonry' WHEN contains(lower(wall), 'stud') OR contains(lower(wall), 'metal') THEN 'stud' END AS depth_class,
  CASE WHEN wall = 'glass' THEN 'depth_unknown' END AS flag FROM x""")
def q_alias_lookup(t: Tables) -> DataFrame:
    walls = F.array(*[F.lit(x) for x in ('8" CMU wall', "glass", "metal stud", "CMU", "gyp board on metal")])
    aliases = [("masonry", ("cmu", "masonry")), ("stud", ("stud", "metal"))]
    found = F.lit(None).cast("string")
    for name, needles in reversed(aliases):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.lower("wall").contains(needle)
        found = F.when(hit, name).otherwise(found)
    return t.part.select("p_partkey", F.get(walls, F.col("p_size") % 5).alias("wall")).select("p_partkey", "wall", found.alias("depth_class"), F.when(found.isNull(), "depth_unknown").alias("flag"))


WIDTH = """['' || p_size || '"', p_size || ' in', 'A-' || p_size, 'x' || p_size || '-99'][1 + p_partkey % 4]"""


@carrier(f"""WITH x AS (SELECT p_partkey, p_size, p_partkey % 4 AS m, {WIDTH} AS raw FROM part) SELECT p_partkey, raw, CAST(CASE WHEN m IN (0, 1) THEN p_size WHEN m = 2 AND p_size BETWEEN 24 AND 48 THEN p_size END AS INTEGER) AS width FROM x""")
def q_parse_width(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    forms = F.array(F.concat(size, F.lit('"')), F.concat(size, F.lit(" in")), F.concat(F.lit("A-"), size), F.concat(F.lit("x"), size, F.lit("-99")))
    raw = F.get(forms, (F.col("p_partkey") % 4).cast("int"))
    return t.part.select("p_partkey", raw.alias("raw"), p.width_inches(raw).alias("width"))


@carrier("""WITH x AS (SELECT p_partkey, p_size AS s, p_partkey % 4 AS m FROM part) SELECT p_partkey, CASE m WHEN 0 THEN s || '-3/4' WHEN 1 THEN '7/' || (s % 4) WHEN 2 THEN s || '.5' ELSE 'none' END AS label,
  CAST(CASE m WHEN 0 THEN s + 0.75 WHEN 1 THEN CASE WHEN s % 4 = 0 THEN NULL ELSE 7 / CAST(s % 4 AS DOUBLE) END WHEN 2 THEN s + 0.5 END AS DOUBLE) AS depth FROM x""")
def q_parse_fraction(t: Tables) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey") % 4
    label = (
        F.when(k == 0, F.concat(size.cast("string"), F.lit("-3/4")))
        .when(k == 1, F.concat(F.lit("7/"), (size % 4).cast("string")))
        .when(k == 2, F.concat(size.cast("string"), F.lit(".5")))
        .otherwise("none")
    )
    return t.part.select("p_partkey", label.alias("label"), p.fraction(label).alias("depth"))


@carrier("""WITH x AS (SELECT p_partkey, p_size AS s FROM part) SELECT p_partkey, CASE WHEN s % 3 = 0 THEN array_to_string(range(1, 13), ',') WHEN s % 3 = 1 THEN '5,2,2'
  ELSE array_to_string(list_filter([2, 3, 4, CAST(s % 15 AS BIGINT)], lambda p: p >= 1 AND p <= 12), ',') END AS pages FROM x""")
def q_range_spec(t: Tables) -> DataFrame:
    size = F.col("p_size")
    spec = F.when(size % 6 == 0, "all").when(size % 3 == 0, "").when(size % 3 == 1, "5,2,2,").otherwise(F.concat(F.lit("2-4,"), (size % 15).cast("string")))
    return t.part.select("p_partkey", F.array_join(p.page_range(spec, 12), ",").alias("pages"))


OPENING = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 45 END AS need, CASE WHEN o_orderkey % 3 = 0 THEN 'LH' WHEN o_orderkey % 3 = 1 THEN 'RH' END AS hand, CASE WHEN o_orderkey % 2 = 0 THEN 'US26D' END AS fin,
  o_orderstatus AS series, CASE WHEN o_custkey % 3 = 0 THEN 'BRAND#' || (o_custkey % 5 + 1) END AS manufacturer, CASE WHEN o_custkey % 2 = 0 THEN left(o_orderpriority, 1) END AS door_type FROM orders"""
ITEM = """SELECT p_partkey, p_name || '-' || p_partkey AS part, CASE WHEN p_size % 3 = 0 THEN 90 WHEN p_size % 3 = 1 THEN 45 END AS have, CASE p_type WHEN 'ECONOMY' THEN 'LH' WHEN 'LARGE' THEN 'RH' WHEN 'SMALL' THEN 'ANY' END AS ihand,
  CASE WHEN p_brand = 'Brand#1' THEN 'US26D' WHEN p_brand = 'Brand#2' THEN 'US19' END AS ifin, CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'O' END AS iseries, upper(p_brand) AS imanufacturer, CAST(p_size % 6 AS VARCHAR) AS idoor_type FROM part"""
R_C, H_C, F_C = "need IS NOT NULL AND (have IS NULL OR have < need)", "hand IS NOT NULL AND ihand IS NOT NULL AND ihand <> 'ANY' AND hand <> ihand", "fin IS NOT NULL AND ifin IS NOT NULL AND fin <> ifin"
KIND_COLUMNS = "need, hand, fin, series, manufacturer, door_type"
JUDGED = f"""WITH o AS ({OPENING}), k AS (SELECT DISTINCT {KIND_COLUMNS} FROM o), i AS ({ITEM}), j AS (SELECT {KIND_COLUMNS}, part, (need IS NOT NULL)::INT + (hand IS NOT NULL)::INT + (fin IS NOT NULL)::INT AS asked,
    (need IS NOT NULL)::INT + (hand IS NOT NULL AND ihand IS NOT NULL)::INT + (fin IS NOT NULL AND ifin IS NOT NULL)::INT AS agreed,
    coalesce(series = iseries, false)::INT + coalesce(manufacturer = imanufacturer, false)::INT + coalesce(door_type = idoor_type, false)::INT AS soft
    FROM k JOIN i ON NOT coalesce({R_C}, false) AND NOT coalesce({H_C}, false) AND NOT coalesce({F_C}, false)),
  s AS (SELECT {KIND_COLUMNS}, part, {places("CASE WHEN asked = 0 THEN CASE WHEN agreed + soft > 0 THEN 0.55 ELSE 0.40 END WHEN agreed = asked THEN CASE WHEN agreed + soft > asked THEN 0.95 ELSE 0.90 END ELSE CAST(0.40 AS DOUBLE) + CAST(0.35 AS DOUBLE) * (CAST(agreed AS DOUBLE) / asked) END", 4)} AS confidence, agreed + soft AS n_matched FROM j),
  best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY {KIND_COLUMNS} ORDER BY confidence DESC, part) <= 3)"""
SAME_KIND = " AND ".join(f"o.{c.strip()} IS NOT DISTINCT FROM best.{c.strip()}" for c in KIND_COLUMNS.split(","))


def judged_openings(t: Tables) -> DataFrame:
    key, customer, size = F.col("o_orderkey"), F.col("o_custkey"), F.col("p_size")
    openings = t.orders.select(
        "o_orderkey",
        F.when(key % 4 == 0, "90 min").when(key % 4 == 1, "45").when(key % 4 == 2, "  ").alias("fire_rating"),
        F.when(key % 3 == 0, "LH").when(key % 3 == 1, "rh ").alias("handing"),
        F.when(key % 2 == 0, "US26D").alias("finish"),
        F.col("o_orderstatus").alias("series"),
        F.when(customer % 3 == 0, F.concat(F.lit("Brand#"), (customer % 5 + 1).cast("string"))).alias("manufacturer"),
        F.when(customer % 2 == 0, F.left("o_orderpriority", F.lit(1))).alias("door_type"),
    )
    items = t.part.select(
        F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("part"),
        F.when(size % 3 == 0, "90-minute").when(size % 3 == 1, "45 min").alias("fire_rating"),
        F.when(F.col("p_type") == "ECONOMY", "LH").when(F.col("p_type") == "LARGE", "RH").when(F.col("p_type") == "SMALL", "any").alias("handing"),
        F.when(F.col("p_brand") == "Brand#1", "us26d").when(F.col("p_brand") == "Brand#2", "US19").alias("finish"),
        F.when(size % 2 == 0, "F").otherwise("O").alias("series"),
        F.col("p_brand").alias("manufacturer"),
        (size % 6).cast("string").alias("door_type"),
    )
    return matching.match_candidates(openings, items, "o_orderkey")


@carrier(f"{JUDGED} SELECT o_orderkey, part, confidence, CAST(n_matched AS BIGINT) AS n_matched FROM o JOIN best ON {SAME_KIND}")
def q_match_candidates(t: Tables) -> DataFrame:
    """Hard constraints (rating, handing, finish) rule items out; what agrees sets the confidence; the best three stay."""
    found = judged_openings(t).where("part IS NOT NULL")
    return found.select("o_orderkey", "part", F.round("confidence", 4).alias("confidence"), F.size("matched_on").cast("long").alias("n_matched"))


@carrier(f"""{JUDGED} SELECT o_orderkey, count(part) AS n, o.need IS NOT NULL AND count(part) = 0 AND (SELECT count(*) FROM i WHERE have IS NULL OR have < o.need) > 0 AS rating_conflict, o.need IS NULL AS rating_missing,
  coalesce(max(confidence) >= 0.75, false) AS auto_matched, coalesce(max(confidence) < 0.75, true) AS needs_review FROM o LEFT JOIN best ON {SAME_KIND} GROUP BY o_orderkey, o.need""")
def q_match_review(t: Tables) -> DataFrame:
    """Which openings matched by themselves, and which a person must look at."""
    flags = ["rating_conflict", "rating_missing", "auto_matched", "needs_review"]
    return judged_openings(t).groupBy("o_orderkey", *flags).agg(F.count("part").alias("n"))
