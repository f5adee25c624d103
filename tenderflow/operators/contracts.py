"""Contracts of a bid before it goes on: what its openings, quote lines and papers must hold. Frames may lack any column but the bid; it then counts as null.

Every function gives bid, subject, rule, severity, where severity is problem (stops the bid) or warning. A bid marked no_scope has nothing to price or to send.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import parts
from tenderflow.operators.flags import Rules, raise_flags

# Fixed values of the contracts.
LINE_FIELDS = ("line_id", "group_name", "group_type", "quantity", "cost_source")
GROUP_TYPES = ("door", "accessories", "frp", "other")
READABLE_SOURCES = ("P21_LAST_PO", "LIST_X_MULTIPLIER", "SPECIAL_NET", "CATALOG_BASELINE")
CITES_FILE = r"(?i)[\w.-]+\.(?:pdf|xlsx|xls)"
CITES_BASELINE = r"(?i)catalog\.md"
CITES_SPECIAL_NET = r"(?i)special[- ]?net|item[- ]?code|hager_special_nets|get_special_net"
CLAIMS_APPROVAL = r"(?i)(?:estimator|purchasing)[- ]?approved"
CITES_PAGE = r"(?i)page\s*\d+|source_page|pdf-tools|bid-docs|extract_text|get_page"
SOFT_FIELDS = ("handing", "finish", "fire_rating", "hardware_set")
UNRESOLVED = ("", "unknown", "tbd", "not specified", "unspecified")
CONFIDENCE_FLOOR = 0.75


class Fields:
    """Columns of a frame by name and type; null where the frame lacks one."""

    def __init__(self, df: DataFrame):
        self.names = set(df.columns)

    def __call__(self, name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in self.names else F.lit(None).cast(kind)

    def filled(self, name: str) -> Column:
        """Neither null nor an empty string."""
        return F.coalesce(self(name) != "", F.lit(False))

    def said(self, name: str) -> Column:
        """Holds something other than white space."""
        return F.coalesce(self(name).rlike(r"\S"), F.lit(False))

    def true(self, name: str) -> Column:
        return F.coalesce(self(name, "boolean"), F.lit(False))


def by_hand(f: Fields) -> Column:
    """Entered by a person rather than read off a drawing; either mark is enough."""
    return f.true("added_by_hand") | F.coalesce(F.lower(f("status")) == "by_hand", F.lit(False))


def findings(df: DataFrame, subject: Column, rules: Rules) -> DataFrame:
    return raise_flags(df, F.struct(F.col("bid"), subject.alias("subject")), rules).select("subject.bid", "subject.subject", "rule", "severity")


def together(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def in_scope(bids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of bids that are not marked as out of scope.

    An outer join with a mark: Spark would move an anti join below what its callers cut the rows down to, and sort whole rows.
    """
    out = bids.where(Fields(bids).true("no_scope")).select("bid").distinct().withColumn("_out", F.lit(True))
    return rows.join(out, "bid", "left").where("_out IS NULL").drop("_out")


def scoped_findings(bids: DataFrame, df: DataFrame, subject: Column, rules: Rules) -> DataFrame:
    """findings of the rows of bids in scope, judged before the join: only bid, subject and the numbers of the rules that hold are dealt."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(i)) for i, (_, _, cond) in enumerate(rules)]))
    judged = df.select("bid", subject.alias("subject"), hits.alias("hits")).where(F.size("hits") > 0)
    names = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")) for name, severity, _ in rules])
    return in_scope(bids, judged).select("bid", "subject", F.explode("hits").alias("i")).select("bid", "subject", F.get(names, F.col("i")).alias("hit")).select("bid", "subject", "hit.rule", "hit.severity")


def line_rules(f: Fields) -> Rules:
    source, detail = f("cost_source"), F.coalesce(f("cost_source_detail"), F.lit(""))
    cost, amount = f("cost"), f("cost").try_cast("double")
    drawn, paged, hand = F.coalesce(f("group_type").isin("door", "frp"), F.lit(False)), f("source_page").isNotNull(), by_hand(f)
    why = F.when(f.filled("cost_source_detail"), f("cost_source_detail")).otherwise(f("reason"))
    return [
        *[(f"missing_{name}", "problem", ~f.filled(name)) for name in LINE_FIELDS],
        ("unnamed", "problem", ~f.said("part_number") & ~f.said("description")),
        ("no_page", "problem", ~paged & drawn),
        ("untraceable", "problem", ~paged & ~drawn & ~f.said("cost_source_detail")),
        ("manual_without_reason", "problem", (source == "MANUAL") & ~F.coalesce(why.rlike(r"\S"), F.lit(False))),
        ("cost_from_a_person", "problem", cost.isNotNull() & ~hand & ~F.coalesce(source.isin(*READABLE_SOURCES), F.lit(False))),
        ("approval_claimed", "problem", ~hand & detail.rlike(CLAIMS_APPROVAL)),
        ("list_price_uncited", "problem", (source == "LIST_X_MULTIPLIER") & ~detail.rlike(CITES_FILE) & ~detail.rlike(CITES_BASELINE)),
        ("special_net_uncited", "problem", (source == "SPECIAL_NET") & ~detail.rlike(CITES_SPECIAL_NET)),
        ("baseline_uncited", "problem", (source == "CATALOG_BASELINE") & ~detail.rlike(CITES_BASELINE)),
        ("computed_without_cost", "problem", cost.isNull() & source.isin(*READABLE_SOURCES)),
        ("manual_with_multiplier", "problem", cost.isNull() & (source == "MANUAL") & f("multiplier").isNotNull() & f.said("price_book_version")),
        ("unreadable_cost", "problem", cost.isNotNull() & amount.isNull()),
        ("negative_cost", "problem", amount < 0),
        ("cost_without_price", "problem", (amount >= 0) & (f("sale_ea").isNull() | f("ext_price").isNull())),
        ("unusual_group_type", "warning", f.filled("group_type") & ~f("group_type").isin(*GROUP_TYPES)),
    ]


def line_label(f: Fields) -> Column:
    return F.when(f.filled("line_id"), f("line_id")).otherwise(F.substring(F.when(f.filled("description"), f("description")).otherwise("line"), 1, 40))


def answered_by_catalog(lines: DataFrame, catalog: DataFrame, vendors: list[str]) -> DataFrame:
    """Lines priced off the page of a file though the catalog (part) holds one of the ways to write their part, with or without a vendor before it."""
    f = Fields(lines)
    suspects = lines.where((f("cost_source") == "LIST_X_MULTIPLIER") & f.said("part_number") & f("cost_source_detail").rlike(CITES_FILE)).select("bid", line_label(f).alias("subject"), F.trim(f("part_number")).alias("asked"))
    ways = suspects.select("asked").distinct().select("asked", F.explode(parts.candidates(F.col("asked"), vendors)).alias("way"))
    held = ways.join(catalog.select(F.upper("part").alias("held")), F.upper("way") == F.col("held"), "left_semi").select("asked").distinct()
    return findings(suspects.join(held, "asked", "left_semi"), F.col("subject"), [("catalog_answers", "problem", F.lit(True))])


def pricing_contract(bids: DataFrame, lines: DataFrame, sets: DataFrame, catalog: DataFrame, vendors: list[str] | None = None) -> DataFrame:
    """bids (bid, no_scope), quote lines, hardware sets read off the drawings (bid, hardware_set) and the product catalog (part)."""
    none, f = Fields(bids).true("no_scope"), Fields(lines)
    sums = lines.groupBy("bid").agg(F.count("*").alias("n"), F.count(f("cost")).alias("priced"))
    whole = findings(
        bids.join(sums, "bid", "left"),
        F.lit("bid"),
        [("nothing_to_price", "warning", none), ("no_lines", "problem", ~none & F.col("n").isNull()), ("entirely_manual", "warning", ~none & (F.col("priced") == 0))],
    )
    groups = lines.select("bid", f("group_name").alias("hardware_set")).distinct()
    read = in_scope(bids, sets.where(Fields(sets).filled("hardware_set")).select("bid", F.col("hardware_set").cast("string")).distinct())
    read = read.join(sums.select("bid"), "bid", "left_semi")
    unquoted = findings(read.join(groups, ["bid", "hardware_set"], "left_anti"), F.col("hardware_set"), [("set_without_line", "warning", F.lit(True))])
    return together(whole, scoped_findings(bids, lines, line_label(f), line_rules(f)), unquoted, in_scope(bids, answered_by_catalog(lines, catalog, vendors or [])))


def opening_rules(f: Fields) -> Rules:
    hand, sure = by_hand(f), f("confidence", "double")
    box, page = f("bbox", "array<double>"), f("page_size", "struct<width:double,height:double>")
    boxed = (F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull()) & (F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1)))
    paged = (page["width"] > 0) & (page["height"] > 0)
    measured = F.coalesce(f("width", "double") != 0, F.lit(False)) & F.coalesce(f("height", "double") != 0, F.lit(False))
    open_ends = F.coalesce(F.exists(f("flags", "array<string>"), lambda x: x.endswith("_missing")), F.lit(False))
    unsure = open_ends | F.coalesce(sure < CONFIDENCE_FLOOR, F.lit(False)) | f("fire_rating").isNull() | f("handing").isNull()
    drawn: Rules = [
        ("missing_door_number", "problem", ~f.filled("door_number")),
        ("missing_source_page", "problem", F.coalesce(f("source_page", "int"), F.lit(0)) == 0),
        ("no_size", "problem", ~f.filled("size") & ~measured),
        ("bad_box", "problem", ~F.coalesce(boxed, F.lit(False))),
        ("bad_page_size", "problem", ~F.coalesce(paged, F.lit(False))),
        *[(f"missing_{name}", "warning", f(name).isNull()) for name in SOFT_FIELDS],
        ("unsure_without_citation", "warning", unsure & ~F.coalesce(f("evidence_note").rlike(CITES_PAGE), F.lit(False))),
    ]
    return [
        ("unidentified", "problem", hand & ~f.filled("description") & ~f.filled("door_number")),
        ("no_confidence", "problem", sure.isNull()),
        *[(name, severity, ~hand & cond) for name, severity, cond in drawn],
    ]


def opening_label(f: Fields) -> Column:
    return F.when(f.filled("door_number"), f("door_number")).when(f.filled("description"), f("description")).otherwise("?")


def extraction_contract(bids: DataFrame, openings: DataFrame) -> DataFrame:
    """bids: schedule_pages, candidate_pages, must_look, looked (arrays of pages) and, for frp and div10, *_in_scope, *_written, *_status, div10_items, div10_reason."""
    f, b = Fields(openings), Fields(bids)
    has = lambda name: F.coalesce(F.size(b(name, "array<int>")) > 0, F.lit(False))
    seen = openings.select("bid", F.lit(True).alias("has_openings")).distinct()
    empty = F.col("has_openings").isNull()
    unseen = F.array_except(b("must_look", "array<int>"), F.coalesce(b("looked", "array<int>"), F.array().cast("array<int>")))
    frp, frp_done, div10, div10_done = b.true("frp_in_scope"), b.true("frp_written"), b.true("div10_in_scope"), b.true("div10_written")
    rules: Rules = [
        ("schedule_missed", "problem", empty & has("schedule_pages")),
        ("candidate_unread", "problem", empty & ~has("schedule_pages") & has("candidate_pages")),
        ("no_openings", "warning", empty & ~has("schedule_pages") & ~has("candidate_pages")),
        ("page_not_looked_at", "problem", F.size(unseen) > 0),
        ("frp_not_written", "problem", frp & ~frp_done),
        ("frp_needless", "warning", ~frp & frp_done),
        ("frp_constants_pending", "warning", frp_done & (b("frp_status") == "PENDING_CONSTANTS")),
        ("frp_not_measured", "warning", frp_done & (b("frp_status") == "NOT_MEASURED")),
        ("div10_not_written", "problem", div10 & ~div10_done),
        ("div10_needless", "warning", ~div10 & div10_done),
        ("div10_no_items", "warning", div10 & div10_done & (b("div10_items", "int") == 0) & ~b.filled("div10_reason")),
    ]
    return together(findings(bids.join(seen, "bid", "left"), F.lit("bid"), rules), findings(openings, opening_label(f), opening_rules(f)))


def delivery_contract(bids: DataFrame, openings: DataFrame, lines: DataFrame) -> DataFrame:
    """What holds back a quote for a customer, from the rows themselves. bids may hold brand_mismatch and papers, the names of files written (null: not judged)."""
    f, q, b = Fields(openings), Fields(lines), Fields(bids)
    accessory = by_hand(f) & ~f.filled("door_number")
    sure = f("confidence", "double")
    unsure = sure.isNull() | F.isnan(sure) | F.abs(sure).isin(float("inf")) | (sure < CONFIDENCE_FLOOR)
    of_openings: Rules = [(f"unresolved_{name}", "problem", ~accessory & F.coalesce(F.lower(F.trim(f(name))).isin(*UNRESOLVED), F.lit(True))) for name in ("fire_rating", "handing")]
    of_openings.append(("unsure_opening", "problem", ~accessory & unsure & ~f.filled("confirmed_by")))
    match = q("confidence", "double")
    of_lines: Rules = [("unsure_match", "problem", F.isnan(match) | F.abs(match).isin(float("inf")) | (match < CONFIDENCE_FLOOR))]
    cost = q("cost").try_cast("double")
    good = (cost >= 0) & ~F.isnan(cost) & (cost != float("inf"))
    sums = in_scope(bids, lines.groupBy("bid").agg(F.count("*").alias("n"), F.count_if(good).alias("priced")))
    out, papers = b.true("no_scope"), b("papers", "array<string>")
    lacks = lambda name: ~out & ~F.array_contains(papers, name)
    of_bids: Rules = [
        ("identity_mismatch", "warning", b.filled("brand_mismatch")),
        ("no_lines", "problem", ~out & F.col("n").isNull()),
        ("nothing_priced", "problem", F.col("priced") == 0),
        ("partly_priced", "warning", (F.col("priced") > 0) & (F.col("priced") < F.col("n"))),
        ("no_quotation", "problem", lacks("quotation.html")),
        ("no_review_flags", "problem", lacks("review_flags.json")),
        ("no_review_summary", "warning", lacks("review_summary.html")),
        ("no_email_draft", "warning", lacks("quotation_email_draft.md")),
    ]
    return together(findings(bids.join(sums, "bid", "left"), F.lit("bid"), of_bids), scoped_findings(bids, openings, opening_label(f), of_openings), scoped_findings(bids, lines, line_label(q), of_lines))
