"""Documents as catalogue pages, and parts as drawing sheets with terms, markers and sheet numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.operators import pages
from tenderflow.plans.base import carrier
from tenderflow.sources.tables import Tables

STRIP = r"regexp_replace(x, '^[\s\x1c-\x1f\p{Z}\x{85}]+|[\s\x1c-\x1f\p{Z}\x{85}]+$', '', 'g')"
LINES = rf"list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {STRIP}), lambda x: x <> '')"
PRICE = r"(^|[^\p{L}\p{N}_.])\$?[0-9]{1,3}(,[0-9]{3})*\.[0-9]{2}($|[^\p{L}\p{N}_])"
HEAD = "split_part(upper(token), '/', 1)"
DESCRIBED = rf"""WITH l AS (SELECT doc_id, {LINES} AS body FROM documents),
  k AS (SELECT doc_id, CASE WHEN length(split_part({HEAD}, '-', 1)) >= 3 THEN split_part({HEAD}, '-', 1) ELSE {HEAD} END AS stem FROM (SELECT doc_id, unnest(flatten(list_transform(body, lambda x: regexp_extract_all(x, '{pages.CODE}')))) AS token FROM l)),
  s AS (SELECT doc_id, stem, count(*) AS n FROM k WHERE length(stem) >= 3 AND NOT regexp_matches(stem, '{pages.FINISH}') AND NOT regexp_matches(stem, '{pages.YEAR}') GROUP BY doc_id, stem QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, stem) <= 8),
  c AS (SELECT doc_id, count(*) AS n, string_agg(stem, ',' ORDER BY n DESC, stem) AS codes FROM s GROUP BY doc_id),
  p AS (SELECT l.doc_id, body, coalesce(n, 0) AS n, coalesce(codes, '') AS codes, len(list_filter(body, lambda x: regexp_matches(x, '{PRICE}'))) > 0 AS prices, lower(array_to_string(body[1:40], ' ')) AS start,
    left(coalesce(list_filter(body[1:8], lambda x: length(x) BETWEEN 3 AND 90 AND NOT regexp_matches(x, '{pages.FURNITURE}') AND regexp_matches(x, '\p{{L}}'))[1], ''), 80) AS title,
    list_filter(body[1:4], lambda x: regexp_matches(x, '{pages.BARE_NUMBER}'))[1] AS printed_page FROM l LEFT JOIN c USING (doc_id)),
  d AS (SELECT *, CASE WHEN len(body) = 0 THEN 'diagram' WHEN contains(start, 'table of contents') OR trim(start) = 'index' THEN 'toc' WHEN prices AND n >= 3 THEN 'price_table' WHEN NOT prices AND n >= 5 THEN 'item_numbers' WHEN prices THEN 'price_table' WHEN len(body) > 12 THEN 'prose' ELSE 'unknown' END AS kind FROM p),
  e AS (SELECT *, CAST(CASE kind WHEN 'diagram' THEN 0.2 WHEN 'toc' THEN 0.7 WHEN 'item_numbers' THEN 0.8 WHEN 'prose' THEN 0.5 WHEN 'unknown' THEN 0.3 ELSE CASE WHEN n >= 3 THEN 0.9 ELSE 0.6 END END AS DOUBLE) AS sure FROM d),
  f AS (SELECT *, CASE WHEN title <> '' THEN least(sure, 0.5) ELSE sure END AS confidence FROM e)"""


def described(t: Tables) -> DataFrame:
    return pages.described(t.documents.select("doc_id", "text"))


@carrier(f"{DESCRIBED} SELECT doc_id, kind, CAST(confidence AS DOUBLE) AS confidence FROM f")
def q_page_kind(t: Tables) -> DataFrame:
    return described(t).select("doc_id", "kind", "confidence")


@carrier(f"{DESCRIBED} SELECT doc_id, kind, title, printed_page, codes, prices AS has_prices FROM f")
def q_describe_page(t: Tables) -> DataFrame:
    return described(t).select("doc_id", "kind", "title", "printed_page", F.array_join("code_prefixes", ",").alias("codes"), "has_prices")


@carrier(f"{DESCRIBED} SELECT f.doc_id, CASE WHEN weak AND d.lang IS NOT NULL THEN 'seen ' || d.lang ELSE title END AS title, CAST(CASE WHEN weak AND d.lang IS NOT NULL THEN 0.8 ELSE confidence END AS DOUBLE) AS confidence FROM (SELECT *, confidence < 0.5 OR (title = '' AND kind = 'unknown') AS weak FROM f) f LEFT JOIN documents d ON d.doc_id = f.doc_id")
def q_second_look(t: Tables) -> DataFrame:
    """Pages that the cheap pass did not settle take what a second look found, here their language."""
    second = t.documents.where("lang IS NOT NULL").select("doc_id", F.concat(F.lit("seen "), "lang").alias("title"), F.lit(0.8).alias("confidence"))
    return pages.with_second_look(described(t), second, ["doc_id"]).select("doc_id", "title", "confidence")


WORDS = [(role, w) for role, words in pages.ROLE_WORDS.items() for w in words]
MARKERS = list(dict.fromkeys(m for names in pages.ROLE_MARKERS.values() for m in names)) + ["Toilet Room", "cover", "frp panels", "Door Plan North", "DIVISION 08 AND MORE", "NOTES"]


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pairs(values: dict[str, list[str]]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, names in values.items() for v in names)


SHEETS = f"""SELECT p_partkey, {listed([w for _, w in WORDS])}[1 + p_partkey % {len(WORDS)}] AS term, p_partkey % 3 AS hits, CASE WHEN p_partkey % 5 = 0 THEN {listed(pages.STOREFRONT)}[1 + p_size % {len(pages.STOREFRONT)}] END AS other,
  {listed(MARKERS)}[1 + p_size % {len(MARKERS)}] AS marker, 'A' || p_size % 12 || '.' || p_partkey % 4 AS sheet, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 1000 END AS chars, p_partkey % 2 = 0 AS parsed, p_partkey % 6 = 2 AS checked, p_size % 5 AS blocks, p_partkey % 7 = 0 AS sparse FROM part"""
ROLES = f"""WITH x AS (SELECT *, lower(concat_ws(' ', CASE WHEN hits > 0 THEN term END, other, marker)) AS blob, upper(marker) AS up, coalesce(chars < 500, false) AS poor, regexp_matches(sheet, '{pages.SCHEDULE_SHEET}') AS is_schedule FROM ({SHEETS})),
  w(role, word) AS (VALUES {pairs(pages.ROLE_WORDS)}), m(role, word) AS (VALUES {pairs(pages.ROLE_MARKERS)}), q(role, word) AS (VALUES {pairs(pages.ROLE_PARTS)}),
  r AS (SELECT p_partkey, role FROM x JOIN w ON contains(blob, word) UNION SELECT p_partkey, role FROM x JOIN m ON up = word UNION SELECT p_partkey, role FROM x JOIN q ON contains(up, word)
    UNION SELECT p_partkey, 'hardware' FROM x WHERE is_schedule UNION SELECT p_partkey, 'floor_plan' FROM x WHERE regexp_matches(sheet, '{pages.PLAN_SHEET}') UNION SELECT p_partkey, 'text_poor' FROM x WHERE poor),
  a AS (SELECT * FROM r UNION SELECT p_partkey, 'door_schedule_candidate' FROM x WHERE (is_schedule OR (poor AND regexp_matches(sheet, '{pages.DETAIL_SHEET}') AND NOT regexp_matches(lower(concat_ws(' ', term, other)), '{"|".join(pages.STOREFRONT)}'))) AND NOT EXISTS (SELECT 1 FROM r WHERE r.p_partkey = x.p_partkey AND role = 'door_schedule'))"""
HEAVY = ", ".join(f"('{r}', {i})" for i, r in enumerate(pages.VISUAL_ORDER))


def sheets(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")

    def pick(values: list[str], i: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))

    own = F.create_map(pick([w for _, w in WORDS], key), (key % 3).cast("int"))
    other = F.when(key % 5 == 0, F.create_map(pick(pages.STOREFRONT, size), F.lit(1))).otherwise(F.create_map().cast("map<string, int>"))
    sheet = F.concat(F.lit("A"), (size % 12).cast("string"), F.lit("."), (key % 4).cast("string"))
    rows = t.part.select("p_partkey", F.map_concat(own, other).alias("terms"), F.array(pick(MARKERS, size)).alias("markers"), F.array(sheet).alias("ids"), F.when(key % 13 != 0, key % 1000).alias("chars"), "p_size")
    return rows.withColumn("roles", pages.sheet_roles(F.col("terms"), F.col("markers"), F.col("ids"), F.col("chars")))


@carrier(f"{ROLES} SELECT x.p_partkey, coalesce(string_agg(role, ',' ORDER BY role), '') AS roles FROM x LEFT JOIN a ON a.p_partkey = x.p_partkey GROUP BY x.p_partkey")
def q_page_roles(t: Tables) -> DataFrame:
    return sheets(t).select("p_partkey", F.array_join("roles", ",").alias("roles"))


@carrier(f"""{ROLES}, h(role, place) AS (VALUES {HEAVY}), v AS (SELECT p_partkey, arg_min(role, place) AS heavy FROM a JOIN h USING (role) GROUP BY p_partkey)
  SELECT x.p_partkey, concat_ws(',', CASE WHEN chars < 40 THEN 'no_text_layer' END, CASE WHEN poor THEN 'text_poor' END, CASE WHEN parsed AND NOT checked THEN 'mineru_verified_null' END, CASE WHEN parsed AND blocks = 0 THEN 'mineru_empty_blocks' END,
    CASE WHEN heavy IS NOT NULL AND sparse THEN 'pretakeoff_empty' END, CASE WHEN poor OR sparse THEN heavy END) AS reasons FROM x LEFT JOIN v ON v.p_partkey = x.p_partkey""")
def q_visual_reasons(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    verified = F.when(key % 6 == 2, 0.9)
    reasons = pages.visual_reasons(F.col("roles"), F.col("chars"), F.array_contains("roles", "text_poor"), key % 2 == 0, verified, F.col("p_size") % 5, key % 7 == 0)
    return sheets(t).select("p_partkey", F.array_join(reasons, ",").alias("reasons"))
