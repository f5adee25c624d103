"""Layout, pages and parsing: order lines as positioned words, documents as pages of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.operators import layout, matching, nested
from tenderflow.plans.base import carrier, places
from tenderflow.sources.tables import Tables

WORDS = """SELECT l_orderkey AS page, l_quantity AS x0, l_quantity + round(l_tax * 100) AS x1, round(l_discount * 100) AS y0, round(l_discount * 100) + 4 AS y1, 'P' || l_partkey || '/' || l_linenumber AS word, l_returnflag FROM lineitem"""


def words(t: Tables) -> DataFrame:
    x, y = F.col("l_quantity"), F.round(F.col("l_discount") * 100)
    word = F.concat(F.lit("P"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")))
    return t.lineitem.select(F.col("l_orderkey").alias("page"), x.alias("x0"), (x + F.round(F.col("l_tax") * 100)).alias("x1"), y.alias("y0"), (y + 4).alias("y1"), word.alias("word"), "l_returnflag")


@carrier(f"SELECT page, CAST(floor(y0 / 6) AS BIGINT) AS bucket, count(*) AS n, string_agg(word, ' ' ORDER BY x0, word) AS text FROM ({WORDS}) GROUP BY ALL")
def q_row_bucket(t: Tables) -> DataFrame:
    return layout.row_texts(words(t))


@carrier(f"""WITH w AS (SELECT *, CAST(floor(y0 / 6) AS BIGINT) AS bucket FROM ({WORDS})), g AS (SELECT *, coalesce((x0 - lag(x1) OVER o > 12)::INT, 0) AS opens FROM w WINDOW o AS (PARTITION BY page, bucket ORDER BY x0, word, x1)),
  c AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY page, bucket ORDER BY x0, word, x1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cell FROM g)
  SELECT page, bucket, cell, string_agg(word, ' ' ORDER BY x0, word, x1) AS text, min(x0) AS x0, max(x1) AS x1 FROM c GROUP BY ALL""")
def q_islands(t: Tables) -> DataFrame:
    return layout.cells(words(t))


@carrier("""WITH RECURSIVE s AS (SELECT DISTINCT l_partkey AS page, l_quantity * 20 AS x FROM lineitem), nxt AS (SELECT a.page, a.x, min(b.x) AS nx FROM s a JOIN s b ON a.page = b.page AND b.x >= a.x + 200 GROUP BY ALL),
  k AS (SELECT page, min(x) AS x FROM s GROUP BY page UNION ALL SELECT nxt.page, nxt.nx FROM k JOIN nxt ON k.page = nxt.page AND k.x = nxt.x),
  e AS (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) AS nx, row_number() OVER (PARTITION BY page ORDER BY x) - 1 AS band FROM k)
  SELECT page, CAST(band AS INTEGER) AS band, x AS left_edge, coalesce(nx, x + coalesce(min(nx - x) OVER (PARTITION BY page), 450)) AS right_edge FROM e""")
def q_greedy_bands(t: Tables) -> DataFrame:
    return layout.bands(t.lineitem.select(F.col("l_partkey").alias("page"), (F.col("l_quantity") * 20).alias("x0")))


@carrier("""SELECT event_id, user_id, header FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events)
  WHERE event_type <> 'signup' AND header IS NOT NULL""")
def q_carry_forward(t: Tables) -> DataFrame:
    header = F.when(F.col("event_type") == "signup", F.col("event_id"))
    rows = t.events.withColumn("header", layout.carried(t.events, ["user_id"], ["ts", "event_id"], header))
    return rows.where("event_type <> 'signup' AND header IS NOT NULL").select("event_id", "user_id", "header")


LINED = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents"


@carrier(f"""WITH r AS (SELECT doc_id, pos, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM ({LINED}))
  SELECT doc_id, CAST(count(*) FILTER (WHERE pos = 1 OR total <= 300) AS INTEGER) AS taken, CASE WHEN count(*) > count(*) FILTER (WHERE pos = 1 OR total <= 300) THEN CAST(count(*) FILTER (WHERE pos = 1 OR total <= 300) AS INTEGER) END AS next FROM r GROUP BY doc_id""")
def q_char_budget(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", layout.lines(F.col("text")).alias("lines"))
    rows = rows.withColumn("taken", layout.within_budget(F.col("lines"), 300))
    return rows.select("doc_id", "taken", F.when(F.size("lines") > F.col("taken"), F.col("taken")).alias("next"))


@carrier("""WITH m AS (SELECT a.p_partkey, b.p_partkey AS hit FROM part a JOIN part b ON a.p_name = b.p_name AND (a.p_type = b.p_type)::INT + (a.p_size // 10 = b.p_size // 10)::INT + (a.p_brand = b.p_brand)::INT >= 2 WHERE a.p_partkey % 4 = 0 AND b.p_partkey % 4 <> 0)
  SELECT a.p_partkey, CASE WHEN count(hit) = 1 THEN min(hit) END AS match, CASE WHEN count(hit) = 0 THEN 'not_found' WHEN count(hit) > 1 THEN 'ambiguous' END AS flag FROM part a LEFT JOIN m USING (p_partkey) WHERE a.p_partkey % 4 = 0 GROUP BY ALL""")
def q_unique_match_join(t: Tables) -> DataFrame:
    """Rows with the same mark and at least two of three values; rows without a mark or one of the values match nothing."""
    return matching.unique_matches(t.part.where("p_partkey % 4 = 0"), t.part.where("p_partkey % 4 <> 0"), "p_partkey", "p_name", [F.col("p_type"), F.floor(F.col("p_size") / 10), F.col("p_brand")])


@carrier(f"""WITH w AS ({WORDS}), a AS (SELECT *, row_number() OVER () AS i FROM w WHERE l_returnflag = 'N'), s AS (SELECT a.page, i, max(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0))) FILTER (WHERE a.x1 > a.x0 AND b.x1 > b.x0) AS share, count(b.page) AS n
  FROM a LEFT JOIN w b ON a.page = b.page AND b.l_returnflag <> 'N' GROUP BY ALL)
  SELECT page, count(*) AS blocks, CASE WHEN max(n) > 0 THEN {places("CAST(count(*) FILTER (WHERE share >= 0.5) AS DOUBLE) / count(*)", 4)} END AS ratio FROM s GROUP BY ALL""")
def q_overlap_ratio(t: Tables) -> DataFrame:
    """Share of a page's text blocks of which a box covers at least half; a page without boxes has none to tell."""
    rows = words(t).withColumn("line", F.monotonically_increasing_id())
    blocks = rows.where("l_returnflag = 'N'").select("page", "line", "x0", "y0", "x1", "y1", F.col("word").alias("text"), F.lit("text").alias("type"))
    return layout.verified_pages(blocks, rows.where("l_returnflag <> 'N'"), "page", "line")


HEADS = ["LIST", "NET", "COST", "EACH"]
HEADLINE = "concat_ws(' | ', 'ITEM', " + ", ".join(f"CASE WHEN (p_partkey + {i}) % {i + 2} = 0 THEN '{h}' END" for i, h in enumerate(HEADS)) + ", CASE WHEN p_size > 25 THEN 'LIST' END)"


@carrier(f"""SELECT p_partkey, array_to_string(list_transform(l, lambda x: x[2]), ',') AS columns FROM (SELECT p_partkey, list_sort(list_filter([{", ".join(f"(instr(h, '{x}'), '{x}')" for x in HEADS)}], lambda x: x[1] > 0)) AS l FROM (SELECT p_partkey, {HEADLINE} AS h FROM part)) WHERE len(l) >= 2""")
def q_price_columns(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    head = F.concat_ws(" | ", F.lit("ITEM"), *[F.when((key + i) % (i + 2) == 0, h) for i, h in enumerate(HEADS)], F.when(F.col("p_size") > 25, "LIST"))
    found = F.filter(F.array(*[F.struct(F.instr(F.col("h"), h).alias("at"), F.lit(h).alias("name")) for h in HEADS]), lambda x: x["at"] > 0)
    rows = t.part.select("p_partkey", head.alias("h")).select("p_partkey", F.array_sort(found).alias("found")).where(F.size("found") >= 2)
    return rows.select("p_partkey", F.array_join(F.transform("found", lambda x: x["name"]), ",").alias("columns"))


STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINE_PARTS = "string_split(line, '. ')"


@carrier(f"""WITH l AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, line, len({LINE_PARTS}) AS parts FROM ({LINED})),
  e AS (SELECT doc_id, pos, unnest({LINE_PARTS}) AS text, generate_subscripts({LINE_PARTS}, 1) AS place, 'sub_text' AS type, NULL AS height FROM l WHERE parts > 1
    UNION ALL SELECT doc_id, pos, unnest(string_split(line, ',')), generate_subscripts(string_split(line, ','), 1), 'text', NULL FROM l WHERE parts = 1 AND pos % 3 = 0
    UNION ALL SELECT doc_id, pos, line, 1000000, 'list', 12 FROM l WHERE parts = 1 AND pos % 3 = 0
    UNION ALL SELECT doc_id, pos, line, 1, 'discarded', NULL FROM l WHERE parts = 1 AND pos % 3 = 1
    UNION ALL SELECT doc_id, pos, line, 1, 'text', NULL FROM l WHERE parts = 1 AND pos % 3 = 2)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY type = 'discarded', pos, place) AS INTEGER) AS n, type, {STRIPPED.format("text")} AS text, CAST(height AS DOUBLE) AS height FROM e WHERE {STRIPPED.format("text")} <> '' OR height IS NOT NULL""")
def q_blocks_flatten(t: Tables) -> DataFrame:
    """Lines as blocks of a parsed page: sentences as inner blocks, lists with items and a box, lines of spans, and discarded ones."""
    lines = t.documents.select("doc_id", F.posexplode(layout.lines(F.col("text"))).alias("at", "line")).withColumn("pos", F.col("at") + 1)
    parts = F.split("line", r"\. ")
    one, rest = F.size(parts) == 1, F.col("pos") % 3
    block = F.struct(
        F.when(~one, "text").when(rest == 0, "list").alias("type"),
        F.when(~one, F.transform(parts, lambda x: F.struct(F.lit("Sub Text").alias("type"), x.alias("content")))).alias("blocks"),
        F.when(one & (rest == 0), F.transform(F.split("line", ","), lambda x: F.struct(x.alias("content")))).alias("list_items"),
        F.when(one & (rest < 2), F.col("line")).alias("content"),
        F.when(one & (rest == 0), F.array(F.lit(0), F.lit(8), F.lit(50.5), F.lit(20))).alias("bbox"),
        F.when(one & (rest == 2), F.array(F.struct(F.array(F.struct(F.col("line").alias("content"))).alias("spans")))).alias("lines"),
    )
    rows = lines.select("doc_id", "pos", (one & (rest == 1)).alias("gone"), block.alias("block"))
    kept = [F.sort_array(F.collect_list(F.when(c, F.struct("pos", "block")))) for c in (~F.col("gone"), F.col("gone"))]
    page = rows.groupBy("doc_id").agg(*[F.transform(x, lambda y: y["block"]).alias(n) for x, n in zip(kept, ("para_blocks", "discarded_blocks"), strict=True)])
    found = nested.blocks(page.select("doc_id", F.to_json(F.struct("para_blocks", "discarded_blocks")).alias("page")), "doc_id", "page")
    return found.select("doc_id", "n", "type", "text", (F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1))).alias("height"))


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@carrier(f"SELECT event_id, {K} AS id FROM events UNION ALL SELECT event_id, {K} + 1 FROM events WHERE {K} % 3 = 2")
def q_json_props(t: Tables) -> DataFrame:
    """A bare array, or the first of lines, line_items and openings that is not empty."""
    k = F.get_json_object("props", "$.k").cast("long")
    one, two = F.format_string('{"id": %d}', k), F.format_string('[{"id": %d}, {"id": %d}]', k, k + 1)
    raw = F.when(k % 3 == 0, F.concat(F.lit("["), one, F.lit("]"))).when(k % 3 == 1, F.concat(F.lit('{"lines": ['), one, F.lit("]}"))).otherwise(F.concat(F.lit('{"line_items": [], "openings": '), two, F.lit("}")))
    rows = t.events.select("event_id", raw.alias("raw"))
    kind = "array<struct<id: bigint>>"
    whole = F.from_json("raw", f"lines {kind}, line_items {kind}, openings {kind}")
    filled = [F.when(F.size(whole[c]) > 0, whole[c]) for c in ("lines", "line_items", "openings")]
    found = F.when(F.col("raw").startswith("["), F.from_json("raw", kind)).otherwise(F.coalesce(*filled))
    return rows.select("event_id", F.explode(found).alias("row")).select("event_id", "row.id")


@carrier(f"""SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'UNPARSEABLE' ELSE 'ok' END AS status, CASE WHEN event_id % 10 <> 3 THEN {K} END AS k, CASE WHEN event_id % 10 = 3 THEN left(props, 4) END AS raw FROM events WHERE event_id % 7 <> 0""")
def q_json_quarantine(t: Tables) -> DataFrame:
    """Blank lines are skipped; a malformed one becomes a row with its first 200 characters."""
    line = F.when(F.col("event_id") % 7 == 0, "  ").when(F.col("event_id") % 10 == 3, F.left("props", F.lit(4))).otherwise(F.col("props"))
    rows = t.events.select("event_id", line.alias("line")).where(F.trim("line") != "")
    rows = rows.withColumn("parsed", F.from_json("line", "k bigint, _corrupt_record string", {"mode": "PERMISSIVE"}))
    bad = F.col("parsed._corrupt_record").isNotNull() | F.col("parsed").isNull()
    return rows.select("event_id", F.when(bad, "UNPARSEABLE").otherwise("ok").alias("status"), F.when(~bad, F.col("parsed.k")).alias("k"), F.when(bad, F.left("line", F.lit(200))).alias("raw"))


@carrier("""SELECT p_partkey, section, p_name AS item, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS price FROM (SELECT *, last_value(CASE WHEN p_partkey % 20 = 0 THEN p_brand END IGNORE NULLS) OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS section FROM part) WHERE p_partkey % 20 <> 0""")
def q_pipe_table(t: Tables) -> DataFrame:
    """Sections are headings, items are table rows with bold money cells; a dash is no price."""
    price = F.when(F.col("p_size") % 5 == 0, "-").otherwise(F.concat(F.lit("**$"), F.col("p_retailprice").cast("string"), F.lit("** each")))
    line = F.when(F.col("p_partkey") % 20 == 0, F.concat(F.lit("## "), "p_brand")).otherwise(F.concat(F.lit("| `"), "p_name", F.lit("` | "), price, F.lit(" |")))
    rows = t.part.select("p_partkey", F.floor(F.col("p_partkey") / 100).alias("file"), line.alias("line"))
    heading = F.when(F.col("line").startswith("## "), F.expr("substr(line, 4)"))
    rows = rows.withColumn("section", layout.carried(rows, ["file"], ["p_partkey"], heading)).where(F.col("line").startswith("|"))
    cells = F.transform(F.split("line", r"\|"), lambda x: F.regexp_replace(F.trim(x), r"[*`]", ""))
    money = F.get(F.split(F.regexp_replace(F.get(cells, F.lit(2)), r"[$,]", ""), " "), F.lit(0)).try_cast("double")
    return rows.select("p_partkey", "section", F.get(cells, F.lit(1)).alias("item"), money.alias("price"))


@carrier("SELECT page_id, url, CASE WHEN n_chars % 5 <> 0 THEN n_chars % 5 > 2 END AS verified, len(string_split(text, chr(10))) AS blocks FROM pages JOIN documents ON page_id = doc_id WHERE url IS NOT NULL")
def q_page_signals(t: Tables) -> DataFrame:
    """A null verdict is kept as such: the page was looked at without one."""
    docs = t.documents.select("doc_id", F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") % 5 > 2).alias("verified"), F.size(layout.lines(F.col("text"))).cast("long").alias("blocks"))
    return t.pages.where("url IS NOT NULL").join(docs, F.col("page_id") == F.col("doc_id")).select("page_id", "url", "verified", "blocks")


@carrier(f"""SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE length(line) < 60) AS short_blocks, arg_min(line, pos) FILTER (WHERE length(line) BETWEEN 1 AND 59) AS title FROM ({LINED}) GROUP BY ALL""")
def q_outline(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(layout.lines(F.col("text"))).alias("pos", "line"))
    titled = F.length("line").between(1, 59)
    return lines.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.length("line") < 60).alias("short_blocks"), F.min_by("line", F.when(titled, F.col("pos"))).alias("title"))
