"""Contracts and review flags: order lines as quote lines and as openings, orders as bids. The columns are composed alike in Spark and DuckDB, the rules are written in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.operators import contracts, review
from tenderflow.plans.base import carrier
from tenderflow.sources.tables import Tables

HAND = ["l_returnflag = 'R' AND l_partkey % 3 = 0 AS added_by_hand", "CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'By_Hand' END AS status"]
LINE = [
    "l_orderkey AS bid",
    "CASE WHEN l_linenumber <> 5 THEN CONCAT(l_orderkey, '-', l_linenumber) END AS line_id",
    "CASE l_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CONCAT('HW-', l_partkey % 40) END AS group_name",
    "CASE l_partkey % 5 WHEN 0 THEN 'door' WHEN 1 THEN 'frp' WHEN 2 THEN 'accessories' WHEN 3 THEN 'misc' ELSE 'other' END AS group_type",
    "CASE WHEN l_partkey % 17 <> 0 THEN l_quantity END AS quantity",
    "CASE l_partkey % 8 WHEN 0 THEN 'MANUAL' WHEN 1 THEN 'LIST_X_MULTIPLIER' WHEN 2 THEN 'SPECIAL_NET' WHEN 3 THEN 'CATALOG_BASELINE' WHEN 4 THEN 'P21_LAST_PO' WHEN 5 THEN 'VENDOR_RFQ' WHEN 7 THEN 'DISTRIBUTOR_MANUAL' END AS cost_source",
    "CASE (l_partkey + l_linenumber) % 7 WHEN 0 THEN 'price_book_2026.pdf p67' WHEN 1 THEN 'catalog.md row 4' WHEN 2 THEN 'Special-net item code 88' WHEN 3 THEN 'Estimator approved cost' WHEN 4 THEN '  ' WHEN 5 THEN 'by the catalog' END AS cost_source_detail",
    "CASE WHEN l_partkey % 2 = 0 AND l_linenumber < 3 THEN 'left to the estimator' END AS reason",
    "CASE WHEN l_partkey % 4 <> 0 THEN CONCAT('P', l_partkey) WHEN l_partkey % 8 = 0 THEN ' ' END AS part_number",
    "CASE WHEN l_partkey % 16 <> 0 THEN CONCAT('item ', l_partkey) END AS description",
    "CASE WHEN l_linenumber < 4 THEN l_linenumber END AS source_page",
    "CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN 'call' WHEN l_partkey % 29 = 0 THEN '-5' ELSE '12.5' END AS cost",
    "CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS sale_ea",
    "CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS ext_price",
    "CASE WHEN l_partkey % 3 = 0 THEN 0.5 END AS multiplier",
    "CASE WHEN l_linenumber % 2 = 0 THEN '2026' ELSE ' ' END AS price_book_version",
    "CASE WHEN l_partkey % 10 < 2 THEN 0.5 WHEN l_partkey % 10 = 2 THEN 0.75 END AS confidence",
    "CASE WHEN l_partkey % 6 <> 0 THEN l_discount * 5 END AS margin",
    "l_partkey % 12 = 1 AS margin_overridden",
    "CASE WHEN l_linenumber > 3 THEN 'agreed' ELSE '' END AS margin_override_reason",
    "CASE WHEN l_partkey % 31 = 0 THEN 'equal of another maker' END AS substitution_note",
    "CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE CONCAT('Supplier ', l_suppkey) END AS vendor",
    "CONCAT('Maker ', l_partkey % 50) AS manufacturer",
    *HAND,
]
OPENING = [
    "l_orderkey AS bid",
    "CASE l_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CONCAT('D', l_linenumber) END AS door_number",
    "CASE WHEN l_partkey % 3 <> 0 THEN 'hand dryer' END AS description",
    "l_linenumber - 1 AS source_page",
    "CASE WHEN l_partkey % 2 = 0 THEN '3070' END AS size",
    "CASE WHEN l_partkey % 3 = 0 THEN 36 END AS width",
    "CASE WHEN l_partkey % 5 <> 0 THEN 84 END AS height",
    "CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 ELSE 0.9 END AS confidence",
    "CASE WHEN l_partkey % 11 <> 0 THEN l_partkey % 13 * 5 END AS x1",
    "CASE WHEN l_partkey % 19 <> 0 THEN l_partkey % 17 END AS page_width",
    "CASE l_partkey % 8 WHEN 0 THEN ' TBD' WHEN 1 THEN NULL ELSE 'LH' END AS handing",
    "CASE WHEN l_partkey % 9 <> 0 THEN '626' END AS finish",
    "CASE l_partkey % 10 WHEN 0 THEN 'Not Specified' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE '90 min' END AS fire_rating",
    "CASE WHEN l_partkey % 12 <> 0 THEN 'HW-1' END AS hardware_set",
    "CASE WHEN l_partkey % 13 = 0 THEN 'finish_missing' WHEN l_partkey % 13 = 1 THEN 'seen' END AS flag",
    "CASE l_partkey % 4 WHEN 0 THEN 'see Page 4' WHEN 1 THEN 'looked it up' END AS evidence_note",
    "CASE WHEN l_linestatus = 'F' THEN 'reviewer' END AS confirmed_by",
    *HAND,
]
BID = [
    "o_orderkey AS bid",
    "o_orderkey % 11 = 0 AS no_scope",
    "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 END AS schedule_page",
    "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 8 END AS candidate_page",
    "CASE WHEN o_orderkey % 5 = 0 THEN 3 END AS must_see",
    "CASE WHEN o_orderkey % 10 = 0 THEN 3 ELSE 2 END AS saw",
    "o_orderkey % 2 = 0 AS frp_in_scope",
    "o_orderkey % 3 = 0 AS frp_written",
    "CASE o_orderkey % 7 WHEN 0 THEN 'PENDING_CONSTANTS' WHEN 1 THEN 'NOT_MEASURED' END AS frp_status",
    "o_orderkey % 2 = 1 AS div10_in_scope",
    "o_orderkey % 5 < 3 AS div10_written",
    "CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE 4 END AS div10_items",
    "CASE WHEN o_orderkey % 4 = 1 THEN 'none drawn' END AS div10_reason",
    "CASE WHEN o_orderkey % 13 = 0 THEN 'another brand' END AS brand_mismatch",
    "CASE WHEN o_orderkey % 6 < 5 THEN o_orderkey % 6 < 4 END AS fire_ratings_present",
    "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 < 4 THEN 'OH' END AS state",
    "o_orderkey % 3 <> 0 AS sent",
]
WITH = f"WITH lines AS (SELECT *, TRY_CAST(cost AS DOUBLE) AS amount, added_by_hand OR coalesce(status = 'By_Hand', false) AS hand FROM (SELECT {', '.join(LINE)} FROM lineitem)), " + (
    f"openings AS (SELECT *, added_by_hand OR coalesce(status = 'By_Hand', false) AS hand FROM (SELECT {', '.join(OPENING)} FROM lineitem)), bids AS (SELECT {', '.join(BID)} FROM orders) "
)
LINE_LABEL, OPENING_LABEL = "coalesce(line_id, description, 'line')", "coalesce(nullif(door_number, ''), description, '?')"
LIVE = "(SELECT * FROM {} WHERE bid NOT IN (SELECT bid FROM bids WHERE no_scope))"


def union(source: str, label: str, rules: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT bid, {label} AS subject, '{rule}' AS rule, '{severity}' AS severity FROM {source} WHERE {cond}" for rule, severity, cond in rules)


def lines(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(*LINE)


def openings(t: Tables) -> DataFrame:
    box = F.array(F.lit(20.0), F.lit(10.0), F.col("x1").cast("double"), F.lit(30.0))
    size = F.struct(F.col("page_width").cast("double").alias("width"), F.lit(36.0).alias("height"))
    return t.lineitem.selectExpr(*OPENING).select("*", box.alias("bbox"), size.alias("page_size"), F.array_compact(F.array("flag")).alias("flags")).drop("x1", "page_width", "flag")


def bids(t: Tables) -> DataFrame:
    pages = {"schedule_pages": "schedule_page", "candidate_pages": "candidate_page", "must_look": "must_see", "looked": "saw"}
    papers = F.when(F.col("sent"), F.array(F.lit("quotation.html"), F.lit("review_flags.json"), F.lit("review_summary.html"))).otherwise(F.array(F.lit("quotation_email_draft.md")))
    return t.orders.selectExpr(*BID).select("*", *[F.array_compact(F.array(c)).alias(name) for name, c in pages.items()], papers.alias("papers"))


LINE_SQL = union(LIVE.format("lines"), LINE_LABEL, [
    *[(f"missing_{x}", "problem", f"{x} IS NULL OR CAST({x} AS VARCHAR) = ''") for x in ("line_id", "group_name", "group_type", "quantity", "cost_source")],
    ("unnamed", "problem", "trim(coalesce(part_number, '')) = '' AND description IS NULL"),
    ("no_page", "problem", "source_page IS NULL AND group_type IN ('door', 'frp')"),
    ("untraceable", "problem", "source_page IS NULL AND group_type NOT IN ('door', 'frp') AND trim(coalesce(cost_source_detail, '')) = ''"),
    ("manual_without_reason", "problem", "cost_source = 'MANUAL' AND trim(coalesce(cost_source_detail, reason, '')) = ''"),
    ("cost_from_a_person", "problem", "cost IS NOT NULL AND NOT hand AND coalesce(cost_source, '') NOT IN ('P21_LAST_PO', 'LIST_X_MULTIPLIER', 'SPECIAL_NET', 'CATALOG_BASELINE')"),
    ("approval_claimed", "problem", "NOT hand AND contains(cost_source_detail, 'Estimator approved')"),
    ("list_price_uncited", "problem", "cost_source = 'LIST_X_MULTIPLIER' AND NOT regexp_matches(coalesce(cost_source_detail, ''), '[.](pdf|md)')"),
    ("special_net_uncited", "problem", "cost_source = 'SPECIAL_NET' AND NOT contains(coalesce(cost_source_detail, ''), 'Special-net')"),
    ("baseline_uncited", "problem", "cost_source = 'CATALOG_BASELINE' AND NOT contains(coalesce(cost_source_detail, ''), 'catalog.md')"),
    ("computed_without_cost", "problem", "cost IS NULL AND cost_source IN ('P21_LAST_PO', 'LIST_X_MULTIPLIER', 'SPECIAL_NET', 'CATALOG_BASELINE')"),
    ("manual_with_multiplier", "problem", "cost IS NULL AND cost_source = 'MANUAL' AND multiplier IS NOT NULL AND price_book_version = '2026'"),
    ("unreadable_cost", "problem", "cost IS NOT NULL AND amount IS NULL"),
    ("negative_cost", "problem", "amount < 0"),
    ("cost_without_price", "problem", "amount >= 0 AND (sale_ea IS NULL OR ext_price IS NULL)"),
    ("unusual_group_type", "warning", "group_type = 'misc'"),
    ("catalog_answers", "problem", "cost_source = 'LIST_X_MULTIPLIER' AND contains(cost_source_detail, '.pdf') AND part_number IN (SELECT 'P' || p_partkey FROM part WHERE p_partkey % 5 = 1)"),
])


@carrier(f"""{WITH}, whole AS (SELECT bids.*, n, priced FROM bids LEFT JOIN (SELECT bid, count(*) AS n, count(cost) AS priced FROM lines GROUP BY bid) USING (bid)),
  sets AS (SELECT DISTINCT bid, 'HW-' || l_suppkey % 40 AS hardware_set FROM (SELECT l_orderkey AS bid, l_suppkey FROM lineitem) WHERE bid NOT IN (SELECT bid FROM bids WHERE no_scope))
  {LINE_SQL} UNION ALL {union("whole", "'bid'", [("nothing_to_price", "warning", "no_scope"), ("no_lines", "problem", "NOT no_scope AND n IS NULL"), ("entirely_manual", "warning", "NOT no_scope AND priced = 0")])}
  UNION ALL SELECT bid, hardware_set, 'set_without_line', 'warning' FROM (SELECT bid, hardware_set FROM sets WHERE bid IN (SELECT bid FROM lines) EXCEPT SELECT bid, group_name FROM lines)""".replace(" , whole", ", whole"))
def q_contract_pricing(t: Tables) -> DataFrame:
    """What a priced quote breaks: of each line, of the quote, of sets read and not quoted, and of parts that the catalog answers."""
    key = F.col("p_partkey")
    catalog = t.part.select(F.concat(F.when(key % 5 == 1, "p").otherwise("Q"), key.cast("string")).alias("part"))
    sets = t.lineitem.selectExpr("l_orderkey AS bid", "CONCAT('HW-', l_suppkey % 40) AS hardware_set")
    return contracts.pricing_contract(bids(t), lines(t), sets, catalog)


@carrier(f"""{WITH} {union("(SELECT * FROM openings WHERE NOT hand)", OPENING_LABEL, [
    ("missing_door_number", "problem", "coalesce(door_number, '') = ''"), ("missing_source_page", "problem", "source_page = 0"), ("no_size", "problem", "size IS NULL AND (width IS NULL OR height IS NULL)"),
    ("bad_box", "problem", "coalesce(x1, 0) <= 20"), ("bad_page_size", "problem", "coalesce(page_width, 0) <= 0"),
    *[(f"missing_{x}", "warning", f"{x} IS NULL") for x in ("handing", "finish", "fire_rating", "hardware_set")],
    ("unsure_without_citation", "warning", "(flag = 'finish_missing' OR confidence < 0.75 OR fire_rating IS NULL OR handing IS NULL) AND NOT contains(coalesce(evidence_note, ''), 'Page 4')"),
  ])} UNION ALL {union("openings", OPENING_LABEL, [("no_confidence", "problem", "confidence IS NULL"), ("unidentified", "problem", "hand AND description IS NULL AND coalesce(door_number, '') = ''")])}
  UNION ALL {union("(SELECT *, bid NOT IN (SELECT bid FROM openings) AS bare FROM bids)", "'bid'", [
    ("schedule_missed", "problem", "bare AND schedule_page IS NOT NULL"), ("candidate_unread", "problem", "bare AND schedule_page IS NULL AND candidate_page IS NOT NULL"),
    ("no_openings", "warning", "bare AND schedule_page IS NULL AND candidate_page IS NULL"), ("page_not_looked_at", "problem", "must_see <> saw"),
    ("frp_not_written", "problem", "frp_in_scope AND NOT frp_written"), ("frp_needless", "warning", "frp_written AND NOT frp_in_scope"),
    ("frp_constants_pending", "warning", "frp_written AND frp_status = 'PENDING_CONSTANTS'"), ("frp_not_measured", "warning", "frp_written AND frp_status = 'NOT_MEASURED'"),
    ("div10_not_written", "problem", "div10_in_scope AND NOT div10_written"), ("div10_needless", "warning", "div10_written AND NOT div10_in_scope"),
    ("div10_no_items", "warning", "div10_in_scope AND div10_written AND div10_items = 0 AND div10_reason IS NULL"),
  ])}""")  # fmt: skip
def q_contract_extraction(t: Tables) -> DataFrame:
    """What a take-off breaks: of each opening, of the pages to look at, and of the take-offs beside the schedule."""
    return contracts.extraction_contract(bids(t), openings(t))


@carrier(f"""{WITH}, whole AS (SELECT bids.*, n, priced FROM bids LEFT JOIN (SELECT bid, count(*) AS n, count(*) FILTER (WHERE amount >= 0) AS priced FROM {LIVE.format("lines")} GROUP BY bid) USING (bid))
  {union(LIVE.format("(SELECT * FROM openings WHERE NOT (hand AND coalesce(door_number, '') = ''))"), OPENING_LABEL, [
    *[(f"unresolved_{x}", "problem", f"coalesce(lower(trim({x})), '') IN ('', 'tbd', 'not specified')") for x in ("fire_rating", "handing")], ("unsure_opening", "problem", "coalesce(confidence, 0) < 0.75 AND confirmed_by IS NULL"),
  ])} UNION ALL {union(LIVE.format("lines"), LINE_LABEL, [("unsure_match", "problem", "confidence < 0.75")])} UNION ALL {union("whole", "'bid'", [
    ("identity_mismatch", "warning", "brand_mismatch IS NOT NULL"), ("no_lines", "problem", "NOT no_scope AND n IS NULL"), ("nothing_priced", "problem", "priced = 0"), ("partly_priced", "warning", "priced > 0 AND priced < n"),
    ("no_quotation", "problem", "NOT no_scope AND NOT sent"), ("no_review_flags", "problem", "NOT no_scope AND NOT sent"), ("no_review_summary", "warning", "NOT no_scope AND NOT sent"), ("no_email_draft", "warning", "NOT no_scope AND sent"),
  ])}""")  # fmt: skip
def q_contract_delivery(t: Tables) -> DataFrame:
    """What holds a quote back from a customer."""
    return contracts.delivery_contract(bids(t), openings(t), lines(t))


@carrier(f"""{WITH} {union("lines", "coalesce(nullif(group_name, ''), line_id, 'unknown line')", [
    ("cost", "medium", "cost IS NULL AND cost_source IN ('MANUAL', 'VENDOR_RFQ', 'DISTRIBUTOR_MANUAL')"), ("margin", "medium", "margin < CASE group_type WHEN 'door' THEN 0.3 WHEN 'frp' THEN 0.2 END - 1e-9"),
    ("margin_override", "medium", "margin IS NOT NULL AND margin_overridden AND margin_override_reason = ''"), ("substitution", "medium", "substitution_note IS NOT NULL"),
    ("out_of_scope", "high", "contains(coalesce(nullif(vendor, ''), manufacturer), 'Supplier 7')"), ("out_of_scope", "high", "contains(coalesce(nullif(vendor, ''), manufacturer), 'Maker 4')"),
  ])}""")  # fmt: skip
def q_review_lines(t: Tables) -> DataFrame:
    """Review flags of quote lines."""
    floor = F.when(F.col("group_type") == "door", 0.3).when(F.col("group_type") == "frp", 0.2)
    return review.line_flags(lines(t), floor, t.spark.createDataFrame([("SUPPLIER 7",), ("maker 4",), ("",)], "name string"))


@carrier(f"""{WITH} {union("bids", "'bid'", [
    ("no_scope", "high", "bid NOT IN (SELECT bid FROM openings)"), ("project_identity", "critical", "brand_mismatch IS NOT NULL"), ("fire_rating", "high", "fire_ratings_present = false"), ("sales_tax", "medium", "coalesce(state, '') = ''"),
  ])} UNION ALL SELECT bid, coalesce(description, 'unknown item'), 'out_of_scope', 'low' FROM lines""")  # fmt: skip
def q_review_scope(t: Tables) -> DataFrame:
    """Review flags of a bid as a whole and of items found and not quoted."""
    return review.scope_flags(bids(t), openings(t), lines(t).select("bid", F.col("description").alias("item")))
