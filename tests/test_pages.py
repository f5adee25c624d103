"""Descriptions of catalogue pages and roles of sheets against plain models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tenderflow.operators import pages


def plain(text, profile):
    lines = [x.strip() for x in (text or "").splitlines() if x.strip()]

    def sourced(rule):
        kind, _, arg = (rule or "").partition(":")
        if kind == "line_index":
            return lines[int(arg)] if int(arg) < len(lines) else None
        if kind == "regex":
            for x in lines:
                if m := re.search(arg, x):
                    return (m.group(1) if m.groups() else m.group(0)).strip()
        return None

    named, printed = sourced(profile.title_source) or "", sourced(profile.printed_source)
    printed = printed or next((x for x in lines[:4] if re.fullmatch(r"\d{1,4}", x)), None)
    body = [x for x in lines if not any(b.lower() in x.lower() for b in profile.boilerplate)]
    if named and body and body[0].lower() == named.lower():
        body = body[1:]
    prices = any(re.search(r"(?<![\w.])\$?\d{1,3}(?:,\d{3})*\.\d{2}(?!\w)", x) for x in body)

    def ranked(values, most):
        return sorted(set(values), key=lambda v: (-values.count(v), v))[:most]

    stems = []
    for x in body:
        for token in re.findall(profile.code_pattern or pages.CODE, x):
            head = token.upper().split("/")[0]
            stem = head.split("-")[0] if len(head.split("-")[0]) >= 3 else head
            if len(stem) >= 3 and not re.match(pages.FINISH, stem) and not re.match(pages.YEAR, stem):
                stems.append(stem)
    codes, found = ranked(stems, 8), []
    for x in body:
        x = re.sub(r"(?i)\(continued\)", "", x).strip(" -:|")
        words = [w for w in re.split("[^A-Za-z]+", x) if len(w) > 2]
        if 4 <= len(x) <= 60 and 2 <= len(words) <= 7 and (x.isupper() or x.istitle()) and not all(w.lower() in pages.NOISE for w in words):
            found.append(" ".join(words).upper())
    keywords, start = ranked(found, 6), " ".join(body[:40]).lower()
    kind, sure = (
        ("diagram", 0.2) if not body else ("toc", 0.7) if "table of contents" in start or start.strip() == "index" else ("price_table", 0.9) if prices and len(codes) >= 3
        else ("item_numbers", 0.8) if len(codes) >= 5 and not prices else ("price_table", 0.6) if prices else ("prose", 0.5) if len(body) > 12 else ("unknown", 0.3)
    )
    title = named
    if not title:
        heads = [next((y[:80] for y in x[:8] if 3 <= len(y) <= 90 and not re.match(pages.FURNITURE, y) and any(c.isalpha() for c in y)), None) for x in (body, lines)]
        title = heads[0] or heads[1] or ""
        if title.strip().upper() in pages.GENERIC and keywords:
            title = keywords[0].title()
        sure = min(sure, 0.5) if title else sure
    columns = {}
    for x in body:
        for needle, label in pages.MONEY_HEADINGS:
            if needle in x.upper() and label not in columns:
                columns[label] = x.upper().find(needle)
    ordered = sorted(columns, key=columns.get) if prices and len(columns) > 1 else []
    subject = title or (body[0][:60] if body else "")
    detail = next((x for x in body[1:8] if x.lower() != subject.lower() and 3 < len(x) < 90), "")
    said = [f"{pages.KINDS[kind]}{f' - {subject}' if subject else ''}."] + ([f"Begins: {detail}."] if detail else []) + (["Covers: " + ", ".join(k.title() for k in keywords[:4]) + "."] if keywords else []) + (["Carries prices."] if prices else [])
    return title, printed, " ".join(said)[:400], codes, keywords, prices, ordered, kind, sure


LINES = ["23", "114", "03/01/2026", "www.vendor.com", "Locks - 3400 Series", "MODEL NUMBER", "Description", "TOILET TISSUE DISPENSERS", "Hand Dryers (continued)", "LIST PRICE | **MAP PRICING", "Dealer  Net Price", "3400 ANSI strike 1-1/4 x 4-7/8  $12.50", "BB1279 hinge 1,234.00 US26D", "B-2888 dispenser", "ECBB1100/4 2026 7.5", "4040XP closer", "Page 3 of 9", "x", "a sentence of prose that is no heading", "mail@x.com", "", "  ", "Index", "Table of Contents", "9566 2630 1828 3400", "Zero & Company", "y" * 95]
PROFILES = [pages.Profile(), pages.Profile("line_index:3", "line_index:0", ("www.vendor.com", "03/01/2026")), pages.Profile(r"regex:^(\w+) - ", r"regex:Page \d+", (), r"[A-Z]+\d+"), pages.Profile("line_index:99", None, ("series",))]


@pytest.mark.parametrize("profile", PROFILES)
def test_described(spark, profile):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "INDEX", *["\n".join(rng.choices(LINES, k=rng.randrange(1, 22))) for _ in range(150)]]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in pages.described(frame, profile=profile).collect():
        found = (r.title, r.printed_page, r.description, r.code_prefixes, r.keywords, r.has_prices, r.price_columns, r.kind, r.confidence)
        assert found == plain(texts[r.k], profile), texts[r.k]


def test_second_look(spark):
    rows = spark.createDataFrame([(1, "unknown", "", 0.3), (2, "prose", "t", 0.5), (3, "diagram", "", 0.2), (4, "unknown", "", 0.9)], "page int, kind string, title string, confidence double")
    second = spark.createDataFrame([(1, "price_table", "new", 0.8), (2, "toc", "no", 0.9), (4, "toc", "yes", 0.7)], "page int, kind string, title string, confidence double")
    assert sorted(map(tuple, pages.with_second_look(rows, second, ["page"]).collect())) == [(1, "price_table", "new", 0.8), (2, "prose", "t", 0.5), (3, "diagram", "", 0.2), (4, "toc", "yes", 0.7)]


@pytest.mark.parametrize(
    "terms,markers,sheets,chars,roles",
    [
        ({"door schedule": 2}, [], [], 900, ["door_schedule"]),
        ({"door schedule": 0, "storefront": 1}, [], ["A4.1"], 100, ["text_poor"]),
        ({}, [], ["A4.1"], 100, ["door_schedule_candidate", "text_poor"]),
        ({}, [], ["A4.1"], None, []),
        ({}, ["Hw Schedule"], ["A4.0"], 900, ["door_schedule", "hardware"]),
        ({}, [], ["a2.3", "A1.1"], 900, ["door_schedule_candidate", "floor_plan", "hardware"]),
        (None, ["TOILET ROOM", "Cover"], None, 10, ["div10", "title"]),
        ({"finish hardware": 1}, ["FRP panel"], [""], 10, ["div08_specs", "finish", "frp", "hardware"]),
    ],
)
def test_sheet_roles(spark, terms, markers, sheets, chars, roles):
    frame = spark.createDataFrame([(terms, markers, sheets, chars)], "t map<string, int>, m array<string>, s array<string>, c int")
    assert frame.select(pages.sheet_roles(*map(F.col, "tmsc")).alias("r")).first().r == roles


@pytest.mark.parametrize(
    "roles,chars,poor,parsed,verified,blocks,sparse,reasons",
    [
        ([], 900, False, False, None, None, False, []),
        (["hardware", "frp"], 30, False, False, None, None, False, ["no_text_layer", "text_poor", "hardware"]),
        (["title"], 100, None, True, None, 0, True, ["text_poor", "mineru_verified_null", "mineru_empty_blocks"]),
        (["FLOOR_PLAN", "door_schedule_candidate"], None, False, True, 0.9, 3, True, ["pretakeoff_empty", "door_schedule_candidate"]),
        (None, None, True, None, None, None, None, ["text_poor"]),
    ],
)
def test_visual_reasons(spark, roles, chars, poor, parsed, verified, blocks, sparse, reasons):
    frame = spark.createDataFrame([(roles, chars, poor, parsed, verified, blocks, sparse)], "a array<string>, b int, c boolean, d boolean, e double, f int, g boolean")
    assert frame.select(pages.visual_reasons(*map(F.col, "abcdefg")).alias("r")).first().r == reasons


def test_a_sheet_is_read_once(spark):
    """However many words, markers and roles are looked for, a row's terms, markers and roles are each put together once."""
    frame = spark.createDataFrame([({"Door Schedule": 1}, ["x"], ["A1.1"], 600)], "t map<string, int>, m array<string>, s array<string>, c int")
    roles = frame.select(pages.sheet_roles(*map(F.col, "tmsc")).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert roles.count("map_filter(") == 1 and roles.count("concat_ws(") == 1
    given = spark.createDataFrame([(["hardware"], 30, True, True, None, 0, True)], "a array<string>, b int, c boolean, d boolean, e double, f int, g boolean")
    reasons = given.select(pages.visual_reasons(*map(F.col, "abcdefg")).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert reasons.count("array_contains(") == 1
