"""What runs leave behind: scores against a reference, patches, feedback, and results that may be used again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.operators import accuracy, learning, patches, reuse
from tenderflow.plans.base import carrier, places
from tenderflow.plans.merge_queries import INCOMING, STORED, incoming, stored
from tenderflow.sources.tables import Tables

SCORED = ["o_orderstatus", "o_orderpriority", "page"]
GOLDEN = f"SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 8 = 1 THEN NULL ELSE o_orderpriority END AS o_orderpriority, CAST(o_orderkey % 50 AS VARCHAR) AS page, o_orderkey % 7 = 0 AS unknown FROM ({STORED})"
ACTUAL = f"SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderkey % 50 + (o_orderkey % 10 = 0)::INT AS VARCHAR) AS page FROM ({INCOMING})"
CELLS = " UNION ALL ".join(f"SELECT g.o_orderkey, '{f}' AS field, upper(nullif(g.{f}, '')) AS wanted, upper(nullif(a.{f}, '')) AS got, a.o_orderkey IS NULL AS gone, {'unknown' if f == 'o_orderpriority' else 'false'} AS unknown FROM g LEFT JOIN a USING (o_orderkey)" for f in SCORED)
VERDICTS = f"""WITH g AS ({GOLDEN}), a AS ({ACTUAL}), c AS ({CELLS}),
  v AS (SELECT *, unknown OR wanted IS NULL AS absent, CASE WHEN gone THEN CASE WHEN wanted IS NOT NULL THEN 'missing' END WHEN unknown OR wanted IS NULL THEN CASE WHEN got IS NULL THEN 'honest' ELSE 'silent' END
    WHEN got = wanted THEN 'covered' WHEN got IS NOT NULL THEN 'silent' ELSE 'open' END AS verdict FROM c)"""


def runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(actual, golden): incoming and stored orders."""
    key = F.col("o_orderkey")
    golden = stored(t).select("o_orderkey", "o_orderstatus", F.when(key % 8 != 1, F.col("o_orderpriority")).alias("o_orderpriority"), (key % 50).alias("page"), F.when(key % 7 == 0, F.array(F.lit("o_orderpriority"))).alias("unknown"))
    return incoming(t).select("o_orderkey", "o_orderstatus", "o_orderpriority", (key % 50 + (key % 10 == 0).cast("int")).alias("page")), golden


@carrier(f"""{VERDICTS}, n AS (SELECT count(*) FILTER (WHERE verdict = 'covered') AS covered, count(*) FILTER (WHERE verdict IN ('covered', 'open', 'missing') OR (verdict = 'silent' AND NOT absent)) AS available,
    count(*) FILTER (WHERE verdict = 'honest') AS honest, count(*) FILTER (WHERE verdict = 'honest' OR (verdict = 'silent' AND absent)) AS absent, count(*) FILTER (WHERE verdict = 'silent') AS silent FROM v)
  SELECT (SELECT count(*) FROM g) AS expected, (SELECT count(*) FROM a) AS found, (SELECT count(*) FROM g ANTI JOIN a USING (o_orderkey)) AS missing, (SELECT count(*) FROM a ANTI JOIN g USING (o_orderkey)) AS extra, covered, available, honest, absent, silent,
    {places("CAST(covered AS DOUBLE) / available", 3)} AS coverage, {places("CAST(honest AS DOUBLE) / absent", 3)} AS honesty FROM n""")
def q_golden_score(t: Tables) -> DataFrame:
    return accuracy.golden_score(*runs(t), "o_orderkey", SCORED)


@carrier(f"{VERDICTS} SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, field, CASE WHEN NOT absent THEN wanted END AS wanted, got FROM v WHERE verdict = 'silent'")
def q_silent_errors(t: Tables) -> DataFrame:
    """What the run asserted against the reference, or where the reference says nothing."""
    rows = accuracy.compared(*runs(t), "o_orderkey", SCORED).where("verdict = 'silent'")
    return rows.select("o_orderkey", "field", F.when(~F.col("absent"), F.col("wanted")).alias("wanted"), "got")


FIELDS = {"error": "bogus", "signup": "confirmed_by", "click": "width", "view": "finish", "purchase": "notes"}
FIELD_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIELDS.items()) + " END"
VALUE_SQL = "json_extract_string(props, '$.k')"
PATCHES = f"""WITH p AS (SELECT event_id AS seq, CASE WHEN event_id % 9 <> 0 THEN 'D' || user_id END AS mark, CASE WHEN event_id % 9 <> 0 THEN {FIELD_SQL} END AS field, CASE WHEN event_id % 31 = 0 THEN 'drop' WHEN event_id % 4 = 0 THEN 'append' ELSE 'set' END AS op,
    {VALUE_SQL} AS value, CASE WHEN event_id % 5 <> 0 THEN event_id % 300 END AS page, CASE WHEN event_id % 6 = 0 THEN ' ' ELSE 'x' || event_id END AS excerpt FROM events),
  r AS (SELECT *, CASE WHEN mark IS NULL THEN 'path' WHEN mark NOT IN (SELECT 'D' || c_custkey FROM customer WHERE c_custkey % 12 <> 0) THEN 'mark' WHEN field = 'confirmed_by' THEN 'protected' WHEN field = 'bogus' THEN 'field'
    WHEN field <> 'notes' AND (page IS NULL OR trim(excerpt) = '') THEN 'evidence' WHEN op = 'drop' THEN 'op' WHEN (field = 'width' AND CAST(value AS DOUBLE) > 80) OR (op = 'append' AND field <> 'notes') THEN 'contract' END AS reason FROM p)"""


def verdicts(t: Tables) -> DataFrame:
    key = F.col("event_id")
    names = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    path = F.when(key % 9 == 0, "openings/1").otherwise(F.concat(F.lit("openings/d"), F.col("user_id").cast("string"), F.lit("/"), names[F.col("event_type")], F.lit("/")))
    op = F.when(key % 31 == 0, "drop").when(key % 4 == 0, "APPEND").when(key % 4 == 1, "set")
    excerpt = F.when(key % 6 == 0, " ").otherwise(F.concat(F.lit("x"), key.cast("string")))
    rows = t.events.select(key.alias("seq"), path.alias("path"), op.alias("op"), F.get_json_object("props", "$.k").alias("value"), F.when(key % 5 != 0, key % 300).alias("source_page"), excerpt.alias("excerpt"))
    marks = t.customer.where("c_custkey % 12 <> 0").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("mark"))
    return patches.judged(rows, marks, ["width", "finish", "notes"], ["notes"], {"width": lambda v: v.try_cast("double") <= 80})


@carrier(f"{PATCHES} SELECT seq, mark, field, reason FROM r")
def q_apply_patches(t: Tables) -> DataFrame:
    return verdicts(t).select("seq", "mark", "field", "reason")


@carrier(f"""{PATCHES}, s AS (SELECT *, max(seq) FILTER (WHERE op = 'set') OVER (PARTITION BY mark, field) AS last_set FROM r WHERE reason IS NULL)
  SELECT mark, field, CASE WHEN field = 'notes' THEN string_agg(value, ',' ORDER BY seq) ELSE arg_max(value, seq) END AS cell, bool_or(last_set IS NOT NULL) AS anew FROM s WHERE last_set IS NULL OR seq >= last_set GROUP BY mark, field""")
def q_patched_cells(t: Tables) -> DataFrame:
    return patches.patched_cells(verdicts(t), ["notes"]).select("mark", "field", F.array_join("values", ",").alias("cell"), "anew")


@carrier(f"""{PATCHES} SELECT mark, coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN reason IN ('protected', 'field', 'contract') THEN 'patch_rejected_' || field WHEN reason = 'evidence' THEN 'patch_unevidenced_' || field END))), ','), '') AS flags,
    left(coalesce(string_agg(field || ' <- p' || page || ': ' || excerpt, '; ' ORDER BY seq) FILTER (WHERE reason IS NULL AND page IS NOT NULL), ''), 2000) AS evidence_note
  FROM r WHERE mark IS NOT NULL AND reason IS DISTINCT FROM 'mark' GROUP BY mark""")
def q_patch_notes(t: Tables) -> DataFrame:
    return patches.patch_notes(verdicts(t)).select("mark", F.array_join("flags", ",").alias("flags"), "evidence_note")


@carrier(f"""WITH e AS (SELECT event_id, ts, CASE WHEN user_id % 10 <> 0 THEN 'u' || user_id END AS spec_key, event_type AS spec, event_type = 'error' AS rejected, CASE WHEN event_type = 'error' THEN 'p' || {VALUE_SQL} WHEN event_id % 6 <> 0 THEN 'c' || {VALUE_SQL} END AS item,
    CASE WHEN event_id % 7 <> 0 THEN event_type END AS reason, CAST(user_id AS VARCHAR) AS who FROM events)
  SELECT spec_key, count(*) FILTER (WHERE NOT rejected) AS confirms, count(*) FILTER (WHERE rejected) AS rejects, coalesce(array_to_string(list_sort(list_distinct(list(reason))), ','), '') AS reasons, arg_max(item, (ts, event_id)) AS last_item, arg_max(spec, (ts, event_id)) AS last_spec,
    max(ts) FILTER (WHERE NOT rejected) AS confirmed_at, arg_max(who, (ts, event_id)) FILTER (WHERE NOT rejected) AS confirmed_by FROM e WHERE spec_key IS NOT NULL AND item IS NOT NULL GROUP BY spec_key""")
def q_learning_fold(t: Tables) -> DataFrame:
    """Every event comes twice, and counts once."""
    key, k = F.col("event_id"), F.get_json_object("props", "$.k")
    events = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", learning.REJECTED).otherwise("matchCorrected").alias("event_type"), F.when(F.col("user_id") % 10 == 0, " ").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("spec_key"),
        F.col("event_type").alias("spec"), F.concat(F.lit("p"), k).alias("proposed_item"), F.when(key % 6 != 0, F.concat(F.lit("c"), k)).alias("corrected_item"), F.when(key % 7 == 0, " ").otherwise(F.col("event_type")).alias("reason"),
        F.col("ts").alias("occurred_at"), F.col("user_id").cast("string").alias("user"),
    )
    found = learning.folded(learning.judged(events.unionByName(events)))
    return found.select("spec_key", "confirms", "rejects", F.array_join("reasons", ",").alias("reasons"), "last_item", "last_spec", "confirmed_at", "confirmed_by")


@carrier("SELECT p_partkey FROM part WHERE p_size / CAST(50 AS DOUBLE) >= 0.75 AND p_type = 'LARGE' AND p_brand <> 'Brand#3'")
def q_cache_reuse(t: Tables) -> DataFrame:
    """Entries found with confidence, against the sheet and catalogue as they are now; those without a watermark prove nothing."""
    entries = t.part.select("p_partkey", (F.col("p_size") / 50).cast("string").alias("confidence"), F.col("p_type").alias("sheet"), F.when(F.col("p_brand") != "Brand#3", "now").alias("watermark"))
    return reuse.reusable(entries, {"sheet": "LARGE", "watermark": "now"}).select("p_partkey")


@carrier("""WITH v AS (SELECT doc_id, source, sha256(text) AS sha256, strlen(text) AS bytes, coalesce(text = lag(text) OVER (PARTITION BY source ORDER BY doc_id), false) AS unchanged FROM documents)
  SELECT doc_id, sha256, bytes, unchanged, CAST(sum((NOT unchanged)::INT) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS version FROM v""")
def q_changed_versions(t: Tables) -> DataFrame:
    """Texts as saves of one path for each source: every save counts, a version only where the content changed."""
    return reuse.saved_versions(t.documents.select("doc_id", "source", "text"), "source", [F.col("doc_id")], "text").select("doc_id", "sha256", "bytes", "unchanged", "version")
