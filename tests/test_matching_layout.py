"""Candidate matching, box containment and capped sessions against plain models."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tenderflow.operators import layout, matching
from tenderflow.streaming import sessions

FIELDS = ["fire_rating", "handing", "finish", "series", "manufacturer", "door_type"]
KINDS = " string, ".join(FIELDS) + " string"


def norm(x):
    return (x or "").strip().upper() or None


def minutes(x):
    digits = "".join(c for c in x or "" if c.isdigit())
    return int(digits) if digits else None


def judge(opening, item, finish):
    """(confidence, agreeing fields) of an item that fits, else the fields it fails on."""
    failed, on = [], []
    need, have = minutes(opening["fire_rating"]), minutes(item["fire_rating"])
    if need is not None:
        (failed if have is None or have < need else on).append("fire_rating")
    for field, same in (("handing", lambda a, b: b in matching.NON_HANDED or a == b), ("finish", lambda a, b: finish.get(a, a) == finish.get(b, b))):
        a, b = norm(opening[field]), norm(item[field])
        if a and b:
            (on if same(a, b) else failed).append(field)
    on += [c for c in matching.SOFT if norm(opening[c]) and norm(opening[c]) == norm(item[c])]
    asked = [c for c in FIELDS[:3] if norm(opening[c])]
    agreed = len([c for c in asked if c in on])
    sure = (0.55 if on else 0.40) if not asked else (0.95 if len(on) > len(asked) else 0.90) if agreed == len(asked) else 0.40 + 0.35 * agreed / len(asked)
    return failed, sure, on


def plain(openings, items, finish):
    out = {}
    for k, o in openings.items():
        judged = [(i["part"], *judge(o, i, finish)) for i in items]
        fit = sorted(((-sure, part or "", sorted(on)) for part, failed, sure, on in judged if not failed))[:3]
        rated = minutes(o["fire_rating"]) is not None
        conflict = rated and not fit and any("fire_rating" in failed for _, failed, _, _ in judged)
        sure = bool(fit) and -fit[0][0] >= 0.75
        out[k] = ([(part, round(-s, 9), on) for s, part, on in fit], conflict, not rated, sure, not sure)
    return out


def found(spark, openings, items, finish):
    o = spark.createDataFrame([(k, *[r[c] for c in FIELDS]) for k, r in openings.items()], f"k long, {KINDS}")
    i = spark.createDataFrame([(r["part"], *[r[c] for c in FIELDS]) for r in items], f"part string, {KINDS}")

    def same(x):
        for a, b in finish.items():
            x = F.when(x == a, b).otherwise(x)
        return x

    out = {}
    for r in matching.match_candidates(o, i, "k", same).orderBy("k", "place").collect():
        rows = out.setdefault(r.k, ([], r.rating_conflict, r.rating_missing, r.auto_matched, r.needs_review))[0]
        if r.place is not None:
            rows.append((r.part, round(r.confidence, 9), sorted(r.matched_on)))
    return out


def some(rng, n, **more):
    pick = {"fire_rating": [None, "", "45", "90 min", "20-minute", "none"], "handing": [None, "LH", "rh ", "any", "REVERSIBLE"], "finish": [None, "US26D", "626", "us19", " "], "series": [None, "a", "B"], "manufacturer": [None, "x", "y"], "door_type": [None, "hm"]}
    return [{c: rng.choice(v) for c, v in pick.items()} | {k: f(i) for k, f in more.items()} for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_match_candidates(spark, seed):
    rng = random.Random(seed)
    items = some(rng, 60 if seed == 1 else 4, part=lambda i: f"p{i:02d}")
    openings = dict(enumerate(some(rng, 120)))
    finish = {"626": "US26D"}
    assert found(spark, openings, items, finish) == plain(openings, items, finish)


def test_ratings(spark):
    """A 90-minute opening takes 90, never 45 or unrated; an unrated one takes all; nothing that fits is a conflict."""
    blank = dict.fromkeys(FIELDS)
    items = [blank | {"part": "low", "fire_rating": "45"}, blank | {"part": "none"}]
    openings = {1: blank | {"fire_rating": "90"}, 2: blank, 3: blank | {"fire_rating": "45 min"}}
    rows = found(spark, openings, items, {})
    assert rows[1] == ([], True, False, False, True)
    assert rows[2] == ([("low", 0.4, []), ("none", 0.4, [])], False, True, False, True)
    assert rows[3] == ([("low", 0.9, ["fire_rating"])], False, False, True, False)
    assert found(spark, openings, [], {})[1] == ([], False, False, False, True)


def test_match_candidates_meet_by_equal_keys(spark):
    o = spark.createDataFrame([(1, *["a"] * 6)], f"k long, {KINDS}")
    plan = matching.match_candidates(o, o.withColumnRenamed("k", "part").withColumn("part", F.col("part").cast("string")), "k")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def boxes(rng, n, wide, most):
    out = []
    for i in range(n):
        x, y = rng.uniform(-20, wide), rng.uniform(-20, wide)
        out.append((i % 2, i, x, y, x + rng.choice([0.0, 3.0, most]), y + rng.uniform(0, most)))
    return out


def test_covered_blocks(spark):
    rng = random.Random(3)
    schema = "page long, id long, x0 double, y0 double, x1 double, y1 double"
    a, b = boxes(rng, 80, 60, 20), boxes(rng, 90, 60, 40) + [(0, 999, -1e4, -1e4, 1e4, -15.0), (1, 998, 5.0, None, 6.0, 7.0)]
    expected = {}
    for page, i, x0, y0, x1, y1 in a:
        if x1 > x0 and y1 > y0:
            shares = [max(0, min(x1, u1) - max(x0, u0)) * max(0, min(y1, v1) - max(y0, v0)) / ((x1 - x0) * (y1 - y0)) for p, _, u0, v0, u1, v1 in b if p == page and v0 is not None and u1 > u0 and v1 > v0]
            expected[page, i] = max([0, *shares])
    rows = layout.covered_blocks(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "page", "id").collect()
    assert {(r.page, r.id): pytest.approx(r.share) for r in rows} == expected


def test_one_page_of_many_boxes(spark):
    """50,000 blocks and as many boxes on one page: in the cells there are a few pairs for each, not all of them."""
    n = 50_000
    rows = spark.range(n).select(F.lit(1).alias("page"), "id", (F.col("id") % 250 * 10.0).alias("x0"), (F.floor(F.col("id") / 250) * 10.0).alias("y0"))
    blocks = rows.select("page", "id", "x0", "y0", (F.col("x0") + 8).alias("x1"), (F.col("y0") + 8).alias("y1"), F.lit("t").alias("text"), F.lit("text").alias("type"))
    over = blocks.withColumn("x0", F.when(F.col("id") % 4 == 0, F.col("x0") + 5).otherwise(F.col("x0")))
    r = layout.verified_pages(blocks, over, "page", "id").first()
    assert (r.blocks, r.ratio) == (n, 0.75)


def test_verified_pages(spark):
    schema = "page long, id long, x0 double, y0 double, x1 double, y1 double, text string, type string"
    blocks = [(1, 1, 0.0, 0.0, 10.0, 10.0, "a", "text"), (1, 2, 0.0, 0.0, 10.0, 10.0, "a", "figure"), (1, 3, 0.0, 0.0, 10.0, 10.0, " ", "text"), (1, 4, 50.0, 0.0, 60.0, 10.0, "b", None), (1, 5, None, 0.0, 1.0, 1.0, "c", "text"), (2, 1, 0.0, 0.0, 1.0, 1.0, "x", "text"), (3, 1, 0.0, 0.0, 1.0, 1.0, "", "text")]
    rows = layout.verified_pages(spark.createDataFrame(blocks, schema), spark.createDataFrame([(1, 0.0, 0.0, 10.0, 5.0)], "page long, x0 double, y0 double, x1 double, y1 double"), "page", "id")
    assert {tuple(r) for r in rows.collect()} == {(1, 2, 0.5), (2, 1, None)}


START = datetime.datetime(2024, 5, 1)


@pytest.mark.parametrize("slot,batch", [(86_400, 10_000), (100, 7)])
def test_sessions_by_walking_each_key(spark, monkeypatch, slot, batch):
    """Any slot, and pieces that go on over batches."""
    rng, events = random.Random(8), []
    for key in "abcdef":
        at = 0.0
        for _ in range(150):
            at += rng.choice([0, 1, 20, 59, 60, 61, 100, 700])
            events.append((key, START + datetime.timedelta(seconds=at)))
    expected, open_ = set(), {}
    due = lambda s: min(s[1] + datetime.timedelta(seconds=60), s[0] + datetime.timedelta(seconds=300))
    for key, ts in sorted(events):
        if key in open_ and ts <= due(open_[key]):
            open_[key] = (open_[key][0], ts, open_[key][2] + 1)
        else:
            if key in open_:
                expected.add((key, open_[key][0], due(open_[key]), open_[key][2]))
            open_[key] = (ts, ts, 1)
    expected |= {(k, s[0], due(s), s[2]) for k, s in open_.items()}
    rng.shuffle(events)
    frame = spark.createDataFrame(events, "key string, ts timestamp").repartition(3)
    monkeypatch.setattr(sessions, "SLOT", slot)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = sessions.capped_sessions(frame).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected
    assert sessions.capped_sessions(frame.limit(0)).count() == 0


def test_unique_matches_of_a_crowd(spark):
    """A mark and values that 20,000 rows of each side share make no pairs; rows that lack a value match nothing."""
    crowd = spark.range(20_000).select(F.col("id").alias("k"), F.lit("m").alias("mark"), F.lit("a").alias("x"), F.lit(1).alias("y"), F.lit("c").alias("z"))
    kinds = "k long, mark string, x string, y int, z string"
    some = [(-1, "n", "a", 1, "c"), (-2, "n", "a", 2, "d"), (-3, "o", "a", 1, None), (-4, None, "a", 1, "c"), (-5, "p", "a", 1, "c")]
    other = [(-11, "n", "a", 1, "q"), (-12, "n", "b", 1, "q"), (-13, "o", "a", 1, "c"), (-14, None, "a", 1, "c"), (-15, "p", "a", 1, "c"), (-16, "o", "a", 1, None)]
    values = [F.col("x"), F.col("y"), F.col("z")]
    found = matching.unique_matches(crowd.union(spark.createDataFrame(some, kinds)), crowd.union(spark.createDataFrame(other, kinds)), "k", "mark", values)
    rows = found.groupBy("match", "flag").agg(F.count("*").alias("n"), F.max("k").alias("k")).collect()
    assert {(r.match, r.flag, r.n, r.k) for r in rows} == {(None, "ambiguous", 20_000, 19_999), (-11, None, 1, -1), (-15, None, 1, -5), (None, "not_found", 3, -2)}
