"""Contracts and review flags on rows of their own: each rule at its edge, missing columns, hand-added rows, empty frames."""

import pytest
from pyspark.sql import functions as F

from tenderflow.operators import contracts, review

LINE = {"bid": 1, "line_id": "L1", "group_name": "HW-1", "group_type": "door", "quantity": "1", "cost_source": "P21_LAST_PO", "cost_source_detail": "last order", "part_number": "B-212", "source_page": 3, "cost": "9.5",
        "sale_ea": 12.0, "ext_price": 12.0, "multiplier": None, "price_book_version": None, "reason": None, "description": None, "added_by_hand": None, "status": None, "confidence": None}
LINE_TYPE = """bid long, line_id string, group_name string, group_type string, quantity string, cost_source string, cost_source_detail string, part_number string, source_page int, cost string, sale_ea double,
  ext_price double, multiplier double, price_book_version string, reason string, description string, added_by_hand boolean, status string, confidence double"""
OPENING = {"bid": 1, "door_number": "101", "description": None, "source_page": 2, "size": "3070", "width": None, "height": None, "confidence": 0.75, "bbox": [1.0, 1.0, 2.0, 2.0], "page_size": (10.0, 10.0), "handing": "LH",
           "finish": "626", "fire_rating": "NONE", "hardware_set": "1", "flags": [], "evidence_note": None, "added_by_hand": False, "status": None, "confirmed_by": None}
OPENING_TYPE = """bid long, door_number string, description string, source_page int, size string, width double, height double, confidence double, bbox array<double>, page_size struct<width: double, height: double>, handing string,
  finish string, fire_rating string, hardware_set string, flags array<string>, evidence_note string, added_by_hand boolean, status string, confirmed_by string"""


def rows(spark, base, kind, *changes):
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in changes], kind)


def rules(df, subject=None):
    return sorted(r.rule for r in df.collect() if subject is None or r.subject == subject)


def priced(spark, lines, bids=((1, False),), sets=(), catalog=(), vendors=None):
    frame = spark.createDataFrame(list(bids), "bid long, no_scope boolean")
    return contracts.pricing_contract(frame, lines, spark.createDataFrame(list(sets), "bid long, hardware_set string"), spark.createDataFrame([(x,) for x in catalog], "part string"), vendors)


@pytest.mark.parametrize(
    "change,broken",
    [
        ({}, []),
        ({"line_id": ""}, ["missing_line_id"]),
        ({"part_number": " ", "description": "\t"}, ["unnamed"]),
        ({"source_page": None}, ["no_page"]),
        ({"source_page": None, "group_type": "accessories"}, []),
        ({"source_page": None, "group_type": "accessories", "cost_source_detail": " "}, ["untraceable"]),
        ({"cost_source": "MANUAL", "cost": None, "cost_source_detail": "", "reason": "two makers fit"}, []),
        ({"cost_source": "MANUAL", "cost": None, "cost_source_detail": " ", "reason": "two makers fit"}, ["manual_without_reason"]),
        ({"cost_source": "VENDOR_RFQ"}, ["cost_from_a_person"]),
        ({"cost_source": "VENDOR_RFQ", "status": "BY_HAND"}, []),
        ({"cost_source_detail": "purchasing-Approved on Monday"}, ["approval_claimed"]),
        ({"cost_source_detail": "purchasing approved", "added_by_hand": True}, []),
        ({"cost_source": "LIST_X_MULTIPLIER", "cost_source_detail": "the maker's catalog"}, ["list_price_uncited"]),
        ({"cost_source": "LIST_X_MULTIPLIER", "cost_source_detail": "Book_2026.PDF p4"}, []),
        ({"cost_source": "SPECIAL_NET", "cost_source_detail": None}, ["special_net_uncited"]),
        ({"cost_source": "SPECIAL_NET", "cost_source_detail": "Item code 7"}, []),
        ({"cost_source": "CATALOG_BASELINE"}, ["baseline_uncited"]),
        ({"cost": None}, ["computed_without_cost"]),
        ({"cost": None, "cost_source": "MANUAL", "multiplier": 0.4, "price_book_version": "2026"}, ["manual_with_multiplier"]),
        ({"cost": "call us"}, ["unreadable_cost"]),
        ({"cost": "-1", "sale_ea": None}, ["negative_cost"]),
        ({"cost": "0", "sale_ea": None}, ["cost_without_price"]),
        ({"group_type": "misc"}, ["unusual_group_type"]),
    ],
)
def test_priced_line(spark, change, broken):
    found = [r for r in rules(priced(spark, rows(spark, LINE, LINE_TYPE, change))) if r != "entirely_manual"]
    assert found == broken


def test_quote_as_a_whole(spark):
    lines = rows(spark, LINE, LINE_TYPE, {}, {"bid": 2, "cost_source": "MANUAL", "cost": None}, {"bid": 3, "line_id": None})
    sets = [(1, "HW-1"), (1, "HW-2"), (1, "HW-2"), (1, ""), (1, None), (3, "HW-9"), (4, "HW-9")]
    found = priced(spark, lines, [(1, False), (2, None), (3, True), (4, False)], sets)
    assert sorted((r.bid, r.subject, r.rule, r.severity) for r in found.collect()) == [
        (1, "HW-2", "set_without_line", "warning"),
        (2, "bid", "entirely_manual", "warning"),
        (3, "bid", "nothing_to_price", "warning"),
        (4, "bid", "no_lines", "problem"),
    ]
    assert rules(priced(spark, lines.limit(0), [])) == []


def test_catalog_answers(spark):
    paged = {"cost_source": "LIST_X_MULTIPLIER", "cost_source_detail": "book.pdf p9"}
    lines = rows(spark, LINE, LINE_TYPE, *[{**paged, "line_id": p, "part_number": p} for p in ("PEMKO-275A-42", " 275a", "431S", None)], {**paged, "line_id": "x", "cost_source_detail": "catalog.md", "part_number": "275A"})
    found = priced(spark, lines, catalog=["275A", "275A", "999"], vendors=["Pemko"])
    assert sorted(r.subject for r in found.where("rule = 'catalog_answers'").collect()) == [" 275a", "PEMKO-275A-42"]


@pytest.mark.parametrize(
    "change,broken",
    [
        ({}, []),
        ({"door_number": ""}, ["missing_door_number"]),
        ({"source_page": 0}, ["missing_source_page"]),
        ({"size": None, "width": 36.0}, ["no_size"]),
        ({"size": "", "width": 36.0, "height": 84.0}, []),
        ({"confidence": None}, ["no_confidence"]),
        ({"confidence": 0.74}, ["unsure_without_citation"]),
        ({"confidence": 0.74, "evidence_note": "see PAGE 12"}, []),
        ({"bbox": [1.0, 1.0, 1.0, 2.0]}, ["bad_box"]),
        ({"bbox": [1.0, None, 2.0, 2.0]}, ["bad_box"]),
        ({"bbox": [1.0, 1.0, 2.0]}, ["bad_box"]),
        ({"page_size": (0.0, 10.0)}, ["bad_page_size"]),
        ({"page_size": None, "finish": None}, ["bad_page_size", "missing_finish"]),
        ({"handing": None}, ["missing_handing", "unsure_without_citation"]),
        ({"flags": ["x", "size_missing"]}, ["unsure_without_citation"]),
        ({"added_by_hand": True, "door_number": None, "bbox": None, "source_page": None, "handing": None}, ["unidentified"]),
        ({"status": "by_hand", "door_number": None, "description": "hand dryer", "confidence": None}, ["no_confidence"]),
    ],
)
def test_opening(spark, change, broken):
    bids = spark.createDataFrame([(1,)], "bid long")
    assert rules(contracts.extraction_contract(bids, rows(spark, OPENING, OPENING_TYPE, change))) == sorted(broken)


def test_take_off_as_a_whole(spark):
    kind = """bid long, schedule_pages array<int>, candidate_pages array<int>, must_look array<int>, looked array<int>, frp_in_scope boolean, frp_written boolean, frp_status string, div10_in_scope boolean,
      div10_written boolean, div10_items int, div10_reason string"""
    none = (None,) * 7
    bids = spark.createDataFrame(
        [
            (1, [4], None, [4, 5], [5], *none), (2, [4], [6], None, None, *none), (3, [], [6], [], [], *none), (4, None, None, [7], None, *none),
            (5, [1], None, None, None, True, True, "NOT_MEASURED", True, True, 0, ""), (6, [1], None, None, None, True, False, None, True, False, None, None), (7, [1], None, None, None, False, True, "PENDING_CONSTANTS", False, True, 0, None),
        ], kind)
    found = contracts.extraction_contract(bids, rows(spark, OPENING, OPENING_TYPE, *[{"bid": b} for b in (1, 5, 6, 7)]))
    by_bid = {b: sorted(r.rule for r in found.collect() if r.bid == b) for b in range(1, 8)}
    assert by_bid == {
        1: ["page_not_looked_at"], 2: ["schedule_missed"], 3: ["candidate_unread"], 4: ["no_openings", "page_not_looked_at"], 5: ["div10_no_items", "frp_not_measured"],
        6: ["div10_not_written", "frp_not_written"], 7: ["div10_needless", "frp_constants_pending", "frp_needless"],
    }


def test_delivery(spark):
    papers = ["quotation.html", "review_flags.json", "review_summary.html", "quotation_email_draft.md"]
    kind = "bid long, no_scope boolean, brand_mismatch string, papers array<string>"
    bids = spark.createDataFrame([(1, False, None, papers), (2, None, "another", papers[1:3]), (3, True, "another", []), (4, False, "", None), (5, False, None, papers)], kind)
    nan = float("nan")
    openings = rows(
        spark, OPENING, OPENING_TYPE, {}, {"bid": 2, "door_number": "u", "fire_rating": " TBD ", "handing": None}, {"bid": 2, "door_number": "c", "confidence": nan}, {"bid": 2, "door_number": "k", "confidence": 0.1, "confirmed_by": "x"},
        {"bid": 2, "door_number": None, "added_by_hand": True, "confidence": None, "handing": None}, {"bid": 3, "handing": None})
    lines = rows(spark, LINE, LINE_TYPE, {}, {"bid": 2, "confidence": 0.5}, {"bid": 2, "line_id": "m", "cost": None, "confidence": 0.75}, {"bid": 5, "cost": "-2"}, {"bid": 5, "cost": "Infinity"})
    found = contracts.delivery_contract(bids, openings, lines)
    by_bid = {b: sorted((r.subject, r.rule) for r in found.collect() if r.bid == b) for b in range(1, 6)}
    assert by_bid == {
        1: [],
        2: [("L1", "unsure_match"), ("bid", "identity_mismatch"), ("bid", "no_email_draft"), ("bid", "no_quotation"), ("bid", "partly_priced"), ("c", "unsure_opening"), ("u", "unresolved_fire_rating"), ("u", "unresolved_handing")],
        3: [("bid", "identity_mismatch")],
        4: [("bid", "no_lines")],
        5: [("bid", "nothing_priced")],
    }


def test_review_of_lines(spark):
    kind = "bid long, group_name string, vendor string, manufacturer string, cost_source string, cost double, margin double, margin_overridden boolean, margin_override_reason string, substitution_note string"
    lines = spark.createDataFrame(
        [
            (1, "a", None, "Old Maker Inc", "manual", None, 0.3, True, "", None), (1, "b", "New", "Old Maker", "MANUAL", 5.0, 0.25, True, "agreed", "x"), (1, None, "", None, "P21_LAST_PO", None, None, True, None, ""),
        ], kind)
    found = review.line_flags(lines, F.lit(0.3), spark.createDataFrame([("old maker",), ("OLD",), ("",), (None,)], "name string"))
    assert sorted((r.subject, r.rule, r.severity) for r in found.collect()) == [
        ("a", "cost", "medium"), ("a", "margin_override", "medium"), ("a", "out_of_scope", "high"), ("a", "out_of_scope", "high"), ("b", "margin", "medium"), ("b", "substitution", "medium"),
    ]


def test_review_of_scope(spark):
    bids = spark.createDataFrame([(1, "x", False, None), (2, None, None, "OH"), (3, "", True, "")], "bid long, brand_mismatch string, fire_ratings_present boolean, state string")
    found = review.scope_flags(bids, rows(spark, OPENING, OPENING_TYPE, {}, {"bid": 3}), spark.createDataFrame([(2, "blinds"), (2, None)], "bid long, item string"))
    assert sorted((r.bid, r.subject, r.rule) for r in found.collect()) == [
        (1, "bid", "fire_rating"), (1, "bid", "project_identity"), (1, "bid", "sales_tax"), (2, "bid", "no_scope"), (2, "blinds", "out_of_scope"), (2, "unknown item", "out_of_scope"), (3, "bid", "sales_tax"),
    ]


def test_bare_frames(spark):
    """Frames of a bid alone: every column counts as null."""
    bid = spark.createDataFrame([(1,)], "bid long")
    assert "unnamed" in rules(priced(spark, bid)) and "bad_box" in rules(contracts.extraction_contract(bid, bid))
    assert rules(contracts.delivery_contract(bid, bid, bid)) == ["nothing_priced", "unresolved_fire_rating", "unresolved_handing", "unsure_opening"]
    assert rules(contracts.extraction_contract(bid.limit(0), bid.limit(0))) == []


def test_only_findings_are_dealt(spark):
    """Rows are judged before they meet the bids out of scope: no anti join, which Spark would move below the judgement, and no whole row in a join."""
    wide = rows(spark, LINE, LINE_TYPE, {"bid": 1, "confidence": 0.5}, {"bid": 2, "confidence": 0.5})
    openings = rows(spark, OPENING, OPENING_TYPE, {"bid": 1, "handing": "tbd"}, {"bid": 2, "handing": "tbd"})
    bids = spark.createDataFrame([(1, False), (2, True)], "bid long, no_scope boolean")
    held = contracts.delivery_contract(bids, openings, wide)
    assert "LeftAnti" not in held._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.bid, r.rule) for r in held.collect()) == [(1, "unresolved_handing"), (1, "unsure_match")]
    bad = rows(spark, LINE, LINE_TYPE, {"bid": 1, "quantity": ""}, {"bid": 2, "quantity": ""})
    assert [(r.bid, r.rule) for r in priced(spark, bad, [(1, False), (2, True)]).collect() if r.subject != "bid"] == [(1, "missing_quantity")]
