"""Search and ranking: documents as pages and sheets, parts as catalog items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import text as x
from tenderflow.operators import layout, search
from tenderflow.plans.base import carrier, places
from tenderflow.sources.tables import Tables

QUERY, TERMS = "the price of hand and re1234", ["HAND", "RE1234"]
PREFIXES = "[A-Z]{2}[0-9]{2,4}"

KIND = """CASE WHEN trim(text) = '' THEN 'diagram' WHEN contains(text, '....') THEN 'toc' WHEN regexp_matches(text, '[$€][0-9]') AND n >= 5 THEN 'price_table' WHEN regexp_matches(text, '[$€][0-9]') THEN 'prices' WHEN regexp_matches(text, '[A-Z]{2,}-?[0-9]') THEN 'item_numbers' WHEN length(text) > 300 THEN 'prose' ELSE 'unknown' END"""
SURE = {"diagram": 0.2, "toc": 0.7, "price_table": 0.9, "prices": 0.6, "item_numbers": 0.8, "prose": 0.5, "unknown": 0.3}
TITLE = "trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1])"
KINDS = f"SELECT doc_id, text, n, {KIND} AS kind FROM (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents)"
SURE_SQL = "CAST(CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SURE.items()) + " END AS DOUBLE)"


def page_kinds(t: Tables) -> DataFrame:
    """A kind and confidence for each page that ranking takes as given; how pages are described is `page_queries`' matter."""
    text = F.col("text")
    prices = text.rlike("[$€][0-9]")
    kind = (
        F.when(F.trim(text) == "", "diagram").when(text.contains("...."), "toc").when(prices & (F.size(layout.lines(text)) >= 5), "price_table").when(prices, "prices")
        .when(text.rlike("[A-Z]{2,}-?[0-9]"), "item_numbers").when(F.length(text) > 300, "prose").otherwise("unknown")
    )
    sure = F.create_map(*[F.lit(x) for pair in SURE.items() for x in pair])
    return t.documents.select("doc_id", kind.alias("kind")).withColumn("confidence", sure[F.col("kind")])


def pages(t: Tables) -> DataFrame:
    lines = layout.lines(F.col("text"))
    title = F.coalesce(F.trim(F.get(F.filter(lines, lambda v: F.trim(v) != ""), F.lit(0))), F.lit(""))
    codes = F.array_distinct(F.regexp_extract_all("text", F.lit(PREFIXES), 0))
    described = t.documents.select("doc_id", title.alias("title"), F.col("text").alias("description"), codes.alias("prefixes"), F.array("lang", "source").alias("keywords"), F.col("text").rlike("[$€][0-9]").alias("has_prices"))
    return described.join(page_kinds(t), "doc_id")


PAGES = f"SELECT doc_id, coalesce({TITLE}, '') AS title, text, list_distinct(regexp_extract_all(text, '{PREFIXES}')) AS prefixes, coalesce(lang, '') || ' ' || coalesce(source, '') AS kw, regexp_matches(text, '[$€][0-9]') AS prices, kind, {SURE_SQL} AS confidence FROM ({KINDS}) JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)"


def _points(term: str) -> str:
    code = any(c.isdigit() for c in term)
    return f"CASE WHEN len(list_filter(prefixes, lambda p: starts_with(upper(p), '{term}') OR starts_with('{term}', upper(p)))) > 0 THEN {5 if code else 2} WHEN contains(upper(title), '{term}') THEN {3 if code else 2} WHEN contains(upper(kw), '{term}') THEN 2.5 WHEN contains(upper(text), '{term}') THEN 0.5 ELSE 0 END"


PHRASE = " ".join(TERMS)
SUM = " + ".join(_points(v) for v in TERMS) + f" + CASE WHEN contains(upper(title), '{PHRASE}') THEN 5 WHEN contains(upper(kw), '{PHRASE}') THEN 3 ELSE 0 END"
SCORED = f"SELECT doc_id, {places('CAST(s + CASE WHEN s > 0 AND prices THEN 1 ELSE 0 END AS DOUBLE) * CASE WHEN kind = ' + chr(39) + 'diagram' + chr(39) + ' THEN CAST(0.4 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * (CAST(0.5 AS DOUBLE) + confidence / 2)', 2)} AS score FROM (SELECT *, {SUM} AS s FROM ({PAGES}))"


@carrier(SCORED)
def q_score_page(t: Tables) -> DataFrame:
    columns = [F.col(c) for c in ("title", "description", "prefixes", "keywords", "has_prices", "kind", "confidence")]
    return pages(t).select("doc_id", search.page_score(search.query_terms(QUERY), *columns).alias("score"))


@carrier(f"SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS place, doc_id, score FROM ({SCORED}) WHERE score > 0 QUALIFY place <= 8")
def q_rank_pages(t: Tables) -> DataFrame:
    return search.ranked(q_score_page(t).where("score > 0"), [F.desc("score"), F.col("doc_id")], 8).select("place", "doc_id", "score")


TIER = "CASE WHEN upper(p_name) = 'SMALL' OR upper(p_type) = 'SMALL' THEN 0 WHEN starts_with(upper(p_name), 'SMALL') OR starts_with(upper(p_type), 'SMALL') THEN 1 ELSE 2 END"


@carrier(f"""SELECT row_number() OVER (ORDER BY {TIER}, (p_size % 4 = 0)::INT, length(p_name), upper(p_name), p_partkey) AS place, p_partkey, CAST({TIER} AS INTEGER) AS tier FROM part
  WHERE contains(upper(p_name), 'SMALL') OR contains(upper(p_type), 'SMALL') QUALIFY place <= 25""")
def q_tiered_search(t: Tables) -> DataFrame:
    items = t.part.withColumn("trusted", F.col("p_size") % 4 != 0)
    return search.tiered(items, " small", "p_name", "p_type", "trusted", "p_partkey", 25).select("place", "p_partkey", "tier")


SHEET_TERMS = ["the", "eine", "aa", "de la"]
COUNTS = [f"CAST((length(lower(text)) - length(replace(lower(text), '{v}', ''))) / {len(v)} AS BIGINT)" for v in SHEET_TERMS]


@carrier(f"""WITH c AS (SELECT doc_id, list_distinct(regexp_extract_all(upper(text), '{search.SHEET}', 1)) AS ids, {', '.join(f'{c} AS n{i}' for i, c in enumerate(COUNTS))}, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS char_count FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, n0 + n1 + n2 + n3 AS score, n0 AS first, n2 AS third, CAST(len(ids) AS INTEGER) AS sheets, char_count FROM c WHERE n0 + n1 + n2 + n3 > 0 OR len(ids) > 0""")
def q_term_counts(t: Tables) -> DataFrame:
    found = search.sheet_map(t.documents.where("text IS NOT NULL").select("doc_id", "text"), SHEET_TERMS)
    first, third = (F.coalesce(F.col("hits")[v], F.lit(0).cast("long")) for v in (SHEET_TERMS[0], SHEET_TERMS[2]))
    return found.select("doc_id", "score", first.alias("first"), third.alias("third"), F.size("sheet_ids").alias("sheets"), "char_count")


@carrier(f"SELECT v.term, coalesce(sum(n), 0)::BIGINT AS total FROM (VALUES ('{SHEET_TERMS[0]}'), ('qxqx')) v(term), LATERAL (SELECT CAST((length(lower(text)) - length(replace(lower(text), v.term, ''))) / length(v.term) AS BIGINT) AS n FROM documents) GROUP BY ALL")
def q_terms_found(t: Tables) -> DataFrame:
    """Totals over all sheets; a term that no sheet holds has 0."""
    terms = [SHEET_TERMS[0], "qxqx"]
    sums = t.documents.agg(*[F.coalesce(F.sum(search.count_of(F.col("text"), v)), F.lit(0)).alias(f"n{i}") for i, v in enumerate(terms)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(v).alias("term"), F.col(f"n{i}").alias("total")) for i, v in enumerate(terms)])).alias("v")).select("v.*")


@carrier("""SELECT doc_id, CAST(i - 1 AS BIGINT) AS place, substr(text, greatest(i - 1 - 80, 0) + 1, i - 1 + 3 + 80 - greatest(i - 1 - 80, 0)) AS context
  FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE contains(lower(text), 'ana')) WHERE substr(lower(text), i, 3) = 'ana'""")
def q_text_hits(t: Tables) -> DataFrame:
    return search.text_hits(t.documents.select("doc_id", "text"), "ana").select("doc_id", "place", "context")


BLOCKS = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM documents"


@carrier(f"""SELECT doc_id, pos, CAST(contains(lower(line), 'hand')::INT + contains(lower(line), 'over')::INT AS INTEGER) AS score, left(line, 500) AS text FROM ({BLOCKS}) WHERE contains(lower(line), 'hand') OR contains(lower(line), 'over')""")
def q_block_search(t: Tables) -> DataFrame:
    blocks = t.documents.select("doc_id", F.posexplode(layout.lines(F.col("text"))).alias("pos", "text"))
    return search.block_hits(blocks, "hand of over").select("doc_id", "pos", "score", "text")


HEAD = "string_split(upper(trim(code)), '/')[1]"
STEM = f"CASE WHEN length(string_split({HEAD}, '-')[1]) >= 3 THEN string_split({HEAD}, '-')[1] ELSE {HEAD} END"


@carrier(f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{search.CODE}')) AS code FROM documents), f AS (SELECT doc_id, {STEM} AS family FROM c)
  SELECT doc_id, family, count(*) AS n FROM f WHERE length(family) >= 3 AND NOT regexp_matches(family, '{search.FINISH}') AND NOT regexp_matches(family, '{search.YEAR}') GROUP BY doc_id, family
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, family) <= 8""")
def q_top_terms(t: Tables) -> DataFrame:
    return search.code_families(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "family", "n")


SHEETS = "SELECT doc_id, source, CASE WHEN contains(text, '@') THEN 'schedule' ELSE 'other' END AS kind, contains(lower(text), 'http') AS sure, regexp_matches(text, '[0-9]{3}') AS maybe, length(text) AS score FROM documents"


def sheets(t: Tables) -> DataFrame:
    text = F.col("text")
    roles = F.array_compact(F.array(F.when(F.lower(text).contains("http"), "door_schedule"), F.when(text.rlike("[0-9]{3}"), "door_schedule_candidate"), F.when(F.length(text) < 100, "text_poor")))
    return t.documents.select("doc_id", "source", F.when(text.contains("@"), "schedule").otherwise("other").alias("kind"), roles.alias("roles"), F.length(text).alias("score"))


@carrier(f"SELECT row_number() OVER (ORDER BY kind <> 'schedule', NOT sure, NOT maybe, score DESC, doc_id) AS place, doc_id FROM ({SHEETS}) QUALIFY place <= 100")
def q_sheet_priority(t: Tables) -> DataFrame:
    order = search.sheet_order(F.col("kind"), F.col("roles"), F.col("score"), F.col("doc_id"))
    return search.ranked(sheets(t), order, 100).select("place", "doc_id")


@carrier(f"""SELECT row_number() OVER (ORDER BY r, doc_id) AS place, doc_id, r AS role_rank, doc_id % 11 = 0 AS forced FROM (SELECT *, CAST(CASE WHEN sure THEN 0 WHEN maybe THEN 1 WHEN score < 100 THEN 7 ELSE 8 END AS INTEGER) AS r FROM ({SHEETS}))
  WHERE score < 200 OR doc_id % 11 = 0 QUALIFY place <= 24""")
def q_capped_targets(t: Tables) -> DataFrame:
    rows = sheets(t).select(F.col("source").alias("path"), F.col("doc_id").alias("source_page"), "roles", F.array().cast("array<string>").alias("reasons"), (F.col("score") < 200).alias("needs"), (F.col("doc_id") % 11 == 0).alias("forced"))
    return search.visual_targets(rows).select("place", F.col("source_page").alias("doc_id"), "role_rank", "forced")


REDACT = "text"
for _pattern in x.SECRETS:
    REDACT = f"regexp_replace({REDACT}, '{_pattern}', '[redacted]', 'g')"
KEYED = "text || CASE doc_id % 4 WHEN 0 THEN ' AKIA' || repeat('Q7', 8) || ' end' WHEN 1 THEN ' sk-' || repeat('a1_', 9) ELSE '' END"


@carrier(f"SELECT doc_id, {REDACT} AS text FROM (SELECT doc_id, {KEYED} AS text FROM documents)")
def q_redact(t: Tables) -> DataFrame:
    end = F.when(F.col("doc_id") % 4 == 0, " AKIA" + "Q7" * 8 + " end").when(F.col("doc_id") % 4 == 1, " sk-" + "a1_" * 9).otherwise("")
    return t.documents.select("doc_id", x.redacted(F.concat("text", end)).alias("text"))


@carrier("SELECT conv_id, turn, left(text, 200) AS kept, CAST(greatest(length(text) - 200, 0) AS BIGINT) AS omitted_chars FROM conversations WHERE role = 'user'")
def q_truncate_text(t: Tables) -> DataFrame:
    kept, omitted = x.kept_head(F.col("text"), 200)
    return t.conversations.where("role = 'user'").select("conv_id", "turn", kept.alias("kept"), omitted.alias("omitted_chars"))


LISTED = "p_type || ' K' || (p_size % 9) || ' ' || repeat('.', p_size * 4) || CASE WHEN p_size % 5 = 0 THEN ' ' ELSE ' MIL ' END || repeat('-', p_size * 3) || '$' || printf('%.2f', p_retailprice) || ' $9.5'"


@carrier(f"""WITH s AS (SELECT p_partkey, {LISTED} AS txt FROM part), w AS (SELECT p_partkey, CASE WHEN instr(txt, 'K3') > 0 THEN substr(txt, instr(txt, 'K3'), 500) END AS win FROM s)
  SELECT p_partkey, CAST(nullif(regexp_extract(CASE WHEN instr(win, 'MIL') > 0 THEN substr(win, instr(win, 'MIL'), 120) END, '\\$([0-9]+\\.[0-9]+)', 1), '') AS DOUBLE) AS price FROM w""")
def q_window_extract(t: Tables) -> DataFrame:
    size = F.col("p_size")
    gap = F.when(size % 5 == 0, " ").otherwise(" MIL ")
    text = F.concat("p_type", F.lit(" K"), (size % 9).cast("string"), F.lit(" "), F.expr("repeat('.', p_size * 4)"), gap, F.expr("repeat('-', p_size * 3)"), F.lit("$"), F.format_string("%.2f", "p_retailprice"), F.lit(" $9.5"))
    return t.part.select("p_partkey", x.price_near(text, F.lit("K3")).alias("price"))


ANCHOR_SQL = "'" + "', '".join(sorted(set(x.ANCHORS))) + "'"


def _english(text: str) -> str:
    words = f"regexp_extract_all({text}, '[A-Za-z]{{2,}}')"
    return f"CASE WHEN len({words}) = 0 THEN 0 ELSE len(list_filter({words}, lambda w: lower(w) IN ({ANCHOR_SQL}))) / sqrt(len({words})) END"


@carrier(f"SELECT doc_id, {places('CAST(' + _english('text') + ' AS DOUBLE)', 6)} AS english FROM documents")
def q_english_score(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(x.english_score(F.col("text")), 6).alias("english"))
