"""Operators on rows of their own: defined cases of search, parts, roll-ups, repair and sessions."""

import datetime
import json as js

import pytest
from pyspark.sql import functions as F

from pyspark.sql import types as T

from tenderflow.functions import json as j
from tenderflow.functions import parts, text
from tenderflow.operators import grids, history, matching, rollup, schedules, search
from tenderflow.sources.files import json_documents
from tenderflow.streaming import sessions


def one(spark, value, *columns):
    """The value of an expression over a single row of named columns."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns])
    return row.select(value.alias("v")).first().v


@pytest.mark.parametrize("spec,pages", [(None, [1, 2, 3, 4, 5, 6]), ("", [1, 2, 3, 4, 5, 6]), ("ALL ", [1, 2, 3, 4, 5, 6]), ("2,", [2]), ("5,2,2", [5, 2, 2]), ("0,7,3", [3]), ("2-4, 6-9", [2, 3, 4, 6]), ("4-2", []), ("0-2", [1, 2])])
def test_page_range(spark, spec, pages):
    assert one(spark, parts.page_range(F.col("s").cast("string"), 6), ("s", spec)) == pages


@pytest.mark.parametrize(
    "part,vendors,expected",
    [
        ("PEMKO-275A-42", ["pemko"], ["PEMKO-275A-42", "275A-42", "275A"]),
        ("VON DUPRIN 99EO-L", ["Von Duprin"], ["VON DUPRIN 99EO-L", "99EO-L", "99EO"]),
        ("B-212", [], ["B-212"]),
        ("4501-48-26D", [], ["4501-48-26D", "4501-48", "4501"]),
        ("10-645210A-00", [], ["10-645210A-00", "10-645210A", "10"]),
        ("", ["x"], []),
    ],
)
def test_candidates(spark, part, vendors, expected):
    assert one(spark, parts.candidates(F.col("p"), vendors), ("p", part)) == expected


@pytest.mark.parametrize("a,b,least,most", [("ab12 hinge", "hinge ab12", 0.95, 0.95), ("ab12 hinge", "cd34 hinge", 0, 0), ("wide door", "wide door", 1, 1), ("wide steel door", "wide door", 0.66, 0.67), ("", "x", 0, 0)])
def test_similarity(spark, a, b, least, most):
    assert least <= one(spark, parts.similarity(F.col("a"), F.col("b")), ("a", a), ("b", b)) <= most


def test_blended_margin(spark):
    lines = spark.createDataFrame([("a", 60.0, 1.0, 100.0), ("a", 10.0, None, None), ("a", None, 2.0, None), ("b", None, 1.0, None)], "g string, cost double, qty double, extended double")
    rows = {r.g: r for r in rollup.blended_margin(lines, ["g"]).collect()}
    assert (rows["a"].blended, rows["a"].unpriced, rows["a"].spent) == (0.4, 1, 60.0)
    assert rows["b"].blended is None and rows["b"].unpriced == 1


def test_empty_names_fold(spark):
    assert one(spark, rollup.named("a", "b", otherwise="Other"), ("a", ""), ("b", "x")) == "x"
    assert one(spark, rollup.named("a", "b", otherwise="Other"), ("a", ""), ("b", "")) == "Other"


PAGE = {"title": "Hand Dryers", "description": "All 4131 models in steel", "prefixes": ["4131"], "keywords": ["TOILET PARTITIONS"], "has_prices": False, "kind": "prose", "confidence": 1.0}


@pytest.mark.parametrize(
    "query,change,score",
    [
        ("4131CNBL36", {}, 5.0),  # a family that the asked code starts with
        ("41", {}, 5.0),  # a family that starts with what was asked
        ("hand dryer", {}, 2 + 2 + 5),  # both words and the phrase in the title
        ("toilet partitions", {}, 2.5 + 2.5 + 3),
        ("steel", {}, 0.5),
        ("steel", {"has_prices": True}, 1.5),
        ("steel price list", {"confidence": 0.0}, 0.25),
        ("hand dryer", {"kind": "diagram"}, 3.6),
        ("the price", {"has_prices": True}, 0.0),
        ("", {"has_prices": True}, 0.0),
        ("x", {}, 0.0),
    ],
)
def test_page_score(spark, query, change, score):
    page = PAGE | change
    row = spark.createDataFrame([tuple(page.values())], "title string, description string, prefixes array<string>, keywords array<string>, has_prices boolean, kind string, confidence double")
    columns = [F.col(c) for c in page]
    for terms in (search.query_terms(query), search.terms_of(F.lit(query))):
        assert row.select(search.page_score(terms, *columns).alias("v")).first().v == pytest.approx(score)


def test_tiered_search(spark):
    rows = [(1, "275A-X", "m", True), (2, "275A", "m", False), (3, "275a", "m", True), (4, "X-275A", "m", True), (5, "ZZ", "275AB", True), (6, "none", None, True)]
    items = spark.createDataFrame(rows, "k long, part string, model string, trusted boolean")
    assert [r.k for r in search.tiered(items, "275a", "part", "model", "trusted", "k").orderBy("place").collect()] == [3, 2, 5, 1, 4]
    assert search.tiered(items, "  ", "part", "model", "trusted", "k").count() == 0


def test_text_hits_overlap(spark):
    rows = search.text_hits(spark.createDataFrame([(1, "Banana"), (2, None), (3, "")], "k long, text string"), "ana").collect()
    assert [(r.k, r.place, r.context) for r in rows] == [(1, 1, "Banana"), (1, 3, "Banana")]


def test_text_hits_long_text(spark):
    text = "x\U0001f600 " * 300_000 + "\u0130ANANA " + "y" * 100
    rows = search.text_hits(spark.createDataFrame([(1, text)], "k long, text string"), "ana").collect()
    assert [(r.place, r.context) for r in rows] == [(i, text[i - 80 : i + 83]) for i in (900_001, 900_003)]
    assert search.text_hits(spark.createDataFrame([(1, "a")], "k long, text string"), "").count() == 0


def test_sheet_map(spark):
    rows = search.sheet_map(spark.createDataFrame([(1, "Door door DOORS a4.0"), (2, "nothing"), (3, " TAS-1 "), (4, None)], "k long, text string"), ["door", "frame"]).collect()
    assert {r.k: (r.hits, r.score, r.sheet_ids, r.char_count) for r in rows} == {1: ({"door": 3}, 3, ["A4.0"], 20), 3: ({}, 0, ["TAS-1"], 5)}


def test_code_families(spark):
    pages = spark.createDataFrame([(1, "3400-ANSI B-2888 B-2888 US26D 2024 3400")], "k long, text string")
    assert {(r.family, r.n) for r in search.code_families(pages, "k").collect()} == {("3400", 2), ("B-2888", 2)}


def test_visual_targets(spark):
    rows = [("f", i, ["floor_plan"], [], True, False) for i in range(1, 31)] + [("f", 40, [], [], False, True), ("f", 41, ["door_schedule"], [], True, False), ("f", 42, ["hardware"], [], False, False)]
    found = search.visual_targets(spark.createDataFrame(rows, "path string, source_page int, roles array<string>, reasons array<string>, needs boolean, forced boolean")).orderBy("place").collect()
    assert len(found) == 24 and found[0].source_page == 41 and 42 not in {r.source_page for r in found}


def test_glyph_repair(spark):
    plain = "the door schedule and the hardware list show all of the frames in the room"
    broken = "".join(c if c in "\n\t" else chr(ord(c) - 29) for c in plain)
    rows = {r.k: r for r in spark.createDataFrame([(1, broken), (2, plain), (3, "")], "k long, t string").select("k", text.best_shift(F.col("t")).alias("s"), text.control_ratio(F.col("t")).alias("c")).collect()}
    assert (rows[1].s, rows[2].s, rows[3].s) == (29, 0, 0) and rows[1].c > 0.05
    assert one(spark, text.shifted(F.col("t"), 29), ("t", broken)) == plain


def test_redaction_and_price(spark):
    assert one(spark, text.redacted(F.col("t")), ("t", "k sk-ant-" + "a" * 20 + " and AKIA" + "A1" * 8)) == "k [redacted] and [redacted]"
    near = text.price_near(F.col("t"), F.lit("9K"))
    assert one(spark, near, ("t", "x $1.00 9K more MIL $12.50 $13.00")) == 12.5
    assert one(spark, near, ("t", "9K no mark $12.50")) is None
    assert one(spark, near, ("t", "9K MIL" + " " * 130 + "$12.50")) is None


def test_prior_similar(spark):
    rows = [(i, 1 if i < 200 else i, f"g{i}", datetime.date(2024, 1, 1) + datetime.timedelta(days=i)) for i in range(300)] + [(900, 1, "g5", datetime.date(2020, 1, 1)), (901, None, None, datetime.date(2030, 1, 1))]
    bids = spark.createDataFrame(rows, "id long, brand long, gc string, day date")
    found = history.prior_similar(bids.where("id IN (900, 901)"), bids, "id", {"brand": 3, "gc": 2}, "day").orderBy("score", "prior").collect()
    # row 5 would score 5, but it is not among the newest 50
    assert {r.asked for r in found} == {900} and [(r.prior, r.score) for r in found] == [(i, 3) for i in range(150, 155)]


def test_numbered(spark):
    rows = [(i, [None, 1, 2][i % 3], i // 7) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a int, b int")
    found = {r.id: r.place for r in history.numbered(df, {"a": False, "b": True}, [F.col("id")]).collect()}
    expected = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[2], r[0]))
    assert found == {r[0]: k for k, r in enumerate(expected, 1)}


def test_similar_keys_lose_nothing(spark):
    import itertools
    import random

    rng = random.Random(3)
    keys = sorted({" ".join(rng.sample(["door", "wide", "steel", "ab12", "cd34", "left", "hinge", "frame"], rng.randrange(1, 7))) for _ in range(150)})
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    both = spark.createDataFrame(list(itertools.product(keys, keys)), "asked string, learned string").where(parts.similarity(F.col("asked"), F.col("learned")) >= 0.75)
    found = matching.similar_keys(df, df, "k", 0.75).select("asked", "learned")
    assert sorted(found.collect()) == sorted(both.collect())


def test_three_way_with_nothing_incoming(spark):
    stored = spark.createDataFrame([(1, False, False), (2, False, True)], "k long, overridden boolean, by_hand boolean")
    assert {r.action for r in history.three_way(stored, stored.select("k").limit(0), "k").collect()} == {"keep"}
    assert {r.k: r.action for r in history.three_way(stored, stored.select("k").where("k = 3"), "k").collect()} == {1: "keep", 2: "keep"}
    some = spark.createDataFrame([(3,)], "k long")
    assert {r.k: r.action for r in history.three_way(stored, some, "k").collect()} == {1: "delete", 2: "keep", 3: "insert"}


START = datetime.datetime(2024, 5, 1)


def at(*seconds):
    return [START + datetime.timedelta(seconds=s) for s in seconds]


def test_capped_sessions(spark):
    events = [("a", x) for x in at(*range(0, 401, 50))] + [("b", x) for x in at(0, 61, 100)] + [(None, START), ("c", None)]
    rows = sessions.capped_sessions(spark.createDataFrame(events, "key string, ts timestamp")).orderBy("key", "started").collect()
    seconds = [(r.key, (r.started - START).total_seconds(), (r.due - START).total_seconds(), r.n) for r in rows]
    assert seconds == [("a", 0, 300, 7), ("a", 350, 460, 2), ("b", 0, 60, 1), ("b", 61, 160, 2)]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    schema = "key string, ts timestamp"
    batches = [[("a", x) for x in at(*range(0, 201, 50))] + [("b", START)], [("a", x) for x in at(*range(250, 401, 50))], [("b", x) for x in at(61, 100)], [("z", x) for x in at(5000)], [("z", x) for x in at(9000)]]
    query = sessions.streamed_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="600 seconds") if (tmp_path / "in").mkdir() is None else None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = query.writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    streamed = {(r.key, r.started, r.due, r.n) for r in spark.table("sessions").where("key <> 'z'").collect()}
    flat = spark.createDataFrame([r for rows in batches for r in rows], schema).where("key <> 'z'")
    assert streamed == {tuple(r) for r in sessions.capped_sessions(flat).collect()}


def test_abandoned_jobs_and_fencing(spark):
    now = START
    jobs = spark.createDataFrame(
        [(1, "extract", "running", at(-599)[0], 0, 1), (2, "extract", "running", at(-600)[0], 2, 1), (3, "other", "running", at(-180)[0], 3, 4), (4, "other", "running", None, 1, 1), (5, "other", "done", None, 1, 1)],
        "id long, kind string, status string, heartbeat timestamp, attempts int, generation int",
    )
    found = sessions.abandoned(jobs, F.lit(now), ["extract"])
    assert {r.id: (r.action, r.generation) for r in found.collect()} == {2: ("requeue", 2), 3: ("dead", 5), 4: ("requeue", 2)}
    writes = spark.createDataFrame([(2, 1, "late"), (2, 2, "now")], "id long, generation int, what string")
    assert [r.what for r in sessions.fenced(writes, found, "id").collect()] == ["now"]
    assert [one(spark, sessions.retry_delay(F.col("n")), ("n", n)) for n in (0, 1, 2, 3)] == [30, 30, 60, 120]


def test_tail(spark):
    files = spark.createDataFrame([("a", "hello wörld", 6), ("b", "new", 10), ("c", "same", 4)], "path string, content string, offset int")
    assert {r.path: (r.text, r.next) for r in sessions.tail(files, F.col("offset")).collect()} == {"a": ("wörld", 12), "b": ("new", 3), "c": ("", 4)}


@pytest.mark.parametrize(
    "cells,expected",
    [
        (["1 EA. THRESHOLD", "350", "MIL", "HAGER"], {"qty": "1", "unit": "EA.", "part": "350", "finish": "MIL", "manufacturer": "Hager", "description": "THRESHOLD", "flags": []}),
        (["3 EA. HINGE 4 1/2\" x 4 1/2\"", "BB1279", "626", "HAGER", "GC"], {"part": "BB1279", "finish": "626", "supplied_by": "GC", "qty": "3", "flags": []}),
        (["1 EA.", "626", "630", "IVES"], {"part": "626", "finish": "630"}),
        (["1 PAIR", "8501 RIM", "LCN"], {"part": "8501", "unit": "PAIR.", "finish": None, "description": "RIM"}),
        (["EA. CONCAVE WALL STOP 236W,"], {"part": "236W", "manufacturer": None, "qty": None, "flags": ["manufacturer_missing", "qty_missing"]}),
        (["1/2 EA. BAR 3/4"], {"part": None, "qty": "1", "description": "/2   BAR 3/4"}),
        ([None, "", "  "], {"raw_row": "", "description": None, "flags": ["part_missing", "manufacturer_missing", "qty_missing"]}),
        ([], {"raw_row": "", "part": None}),
        (["HAGER", "HAGER"], {"manufacturer": "Hager", "description": "HAGER"}),
    ],
)
def test_hardware_items(spark, cells, expected):
    rows = spark.createDataFrame([(cells,)], "cells array<string>")
    found = schedules.hardware_items(rows).first().asDict()
    assert {k: found[k] for k in expected} == expected
    assert sorted(found) == sorted(["cells", "qty", "unit", "description", "part", "finish", "manufacturer", "supplied_by", "raw_row", "flags"])


@pytest.mark.parametrize(
    "line,kinds,model,flags",
    [
        ("TOILET PAPER DISPENSER BOBRICK B-3974", ["toilet_tissue_dispenser"], "B-3974", ["qty_not_stated"]),
        ("2 EA. hand dryer  Gamco # 0042,", ["hand_dryer"], "0042", []),
        ("SURFACE JUMBO ROLL TOILET DISPENSER | GRAB BARS ASI 9114-0000000", ["toilet_tissue_dispenser", "grab_bar"], "9114-0000000", ["product_type_ambiguous", "qty_not_stated"]),
        ("BASIN MIRROR B-165", ["mirror"], None, ["manufacturer_missing", "specified_model_missing", "qty_not_stated"]),
        ("Towel dispenser and soap dispenser and shelf", ["paper_towel_dispenser", "soap_dispenser", "shelf"], None, ["product_type_ambiguous", "manufacturer_missing", "specified_model_missing", "qty_not_stated"]),
        ("CONTRACTOR MAKING FINAL HOOK-UPS", [], None, None),
        ("", [], None, None),
        (None, [], None, None),
    ],
)
def test_accessory_lines(spark, line, kinds, model, flags):
    found = schedules.accessory_lines(spark.createDataFrame([(line,)], "line string")).collect()
    if not kinds:
        assert found == []
        return
    row = found[0]
    assert [row.product_type, *(row.alternate or "").split("/")] == [*kinds, ""][: max(2, len(kinds))]
    assert (row.specified_model, row.flags, row.confidence) == (model, flags, round(max(0.3, 1 - 0.15 * len(flags)), 2))


def test_panel_findings(spark):
    pages = [("a", 2, "x\nFRP by Nudo"), ("a", 1, "Bobrick shelf\nFRP non-tile, textured"), ("b", 1, "no panels, Nudo"), ("b", 2, None), ("c", 1, "FIBERGLASS\nREINFORCED POLYESTER")]
    rows = {r.g: r for r in schedules.panel_findings(spark.createDataFrame(pages, "g string, p int, t string"), "g", "p", "t").collect()}
    assert (rows["a"].product_type, rows["a"].manufacturer, rows["a"].n_pages) == ("non_tile/textured", "Nudo", 2)
    assert (rows["b"].frp_in_scope, rows["b"].status, rows["b"].flags) == (False, "NOT_FOUND", ["no_frp_on_the_sheets_tagged_for_it"])
    assert (rows["c"].product_type, rows["c"].manufacturer, rows["c"].n_pages) == ("FRP wall panel", None, 1)
    found = schedules.panel_pages(spark.createDataFrame(pages, "g string, p int, t string").where("g = 'c'"), "t").first()
    assert found.excerpt == ""


def grid_words(header, rows, top=10.0):
    """Words of a page: a header and rows of (height, cells), where a cell is None or a number, at right edges 100, 140, ..."""
    out = [(1, 80.0 + 40 * i, 100.0 + 40 * i, top, str(v)) for i, v in enumerate(header)]
    for k, (height, values) in enumerate(rows):
        y = top + 10 * (k + 1)
        out += [(1, 40.0, 60.0, y, str(height))] if height is not None else []
        out += [(1, 80.0 + 40 * i, 100.0 + 40 * i, y, str(v)) for i, v in enumerate(values) if v is not None]
    return out


@pytest.mark.parametrize(
    "header,rows,expected",
    [
        ([6, 8, 10, 12, 14, 16], [(80, [1, 5, 6, 7, 8, 9]), (90, [2, None, None, None, None, None])], {(80, 6): 1, (80, 8): 5, (80, 10): 6, (80, 12): 7, (80, 14): 8, (80, 16): 9}),
        ([6, 8, 10, 12, 14, 16], [(80, [6, 8, 10, 12, 14, 16]), (None, [1, 2, 3, 4, 5, 6])], {}),
        ([6, 8, 10, 12, 14], [(80, [1, 2, 3, 4, 5])], {}),
        ([6, 9, 12, 15, 18, 21], [(80, [1, 2, 3, 4, 5, 6])], {}),
        ([6, 8, 12, 14, 16, 18], [(80, [1, 2, 3, None, None, None]), (80, [7, 7, 7, None, None, None])], {(80, 6): 7, (80, 8): 7, (80, 12): 7}),
        ([4, 8, 12, 16, 20, 24], [(80, [1, 2, 3, 4, 5, 6])], {}),
    ],
)
def test_price_grid(spark, header, rows, expected):
    words = spark.createDataFrame(grid_words(header, rows) + [(1, 0.0, 30.0, 5.0, "WIDTH"), (2, 0.0, 30.0, 5.0, "7")], "page int, x0 double, x1 double, y0 double, word string")
    found = grids.price_grid(words).collect()
    assert {(r.height, r.width): r.price for r in found} == expected and len(found) == len(expected)


def test_json_documents(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"k": [1, 2]}')
    (tmp_path / "bad.json").write_text('{"k": ')
    wanted = spark.createDataFrame([("good.json",), ("bad.json",), ("gone.json",)], "name string")
    found = json_documents(wanted, str(tmp_path)).select("name", F.try_variant_get("payload", "$.k[1]", "int").alias("k"), F.col("payload").isNull().alias("none"))
    assert {tuple(r) for r in found.collect()} == {("good.json", 2, False), ("bad.json", None, True), ("gone.json", None, True)}


def test_json_safe(spark):
    kind = "_id binary, at timestamp_ntz, more struct<_id: int, list: array<timestamp_ntz>>, named map<string, date>"
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 6)
    rows = spark.createDataFrame([(bytearray(b"\x01\xab"), at, (1, [at.replace(microsecond=0), None]), {"_id": at.date()}), (None, None, None, None)], kind)
    safe = j.safe_rows(rows)
    assert isinstance(safe.schema["id"].dataType, T.StringType)
    first, last = safe.collect()
    assert (first.id, first.at, first.more.id, first.more.list, first.named) == ("01ab", "2024-01-02T03:04:05.000006", 1, ["2024-01-02T03:04:05", None], {"id": "2024-01-02"})
    assert tuple(last) == (None, None, None, None)


@pytest.mark.parametrize(
    "text,bands",
    [
        ('{"bands": [{"key": "a", "margin": 0.1}, {"key": "a", "margin": 0.2}], "accessories_derived": 0.3}', {"a": 0.2, "accessories": 0.3}),
        ('{"bands": [{"margin": 0.1}]}', {"d": 0.5}),
        ("{}", {"d": 0.5}),
        ("[", {"d": 0.5}),
        (None, {"d": 0.5}),
        ('{"bands": [{"key": "accessories", "margin": 0.1}], "accessories_derived": 0.3}', {"accessories": 0.3}),
    ],
)
def test_margin_bands(spark, text, bands):
    assert one(spark, j.margin_bands(F.col("t").cast("string"), {"d": 0.5}), ("t", text)) == bands


def test_live_attempts(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [("a", start + datetime.timedelta(seconds=s)) for s in (0, 299, 300, 900)] + [("b", start)]
    frame = spark.createDataFrame(rows, "who string, at timestamp_ntz")
    assert sorted((r.who, r.live) for r in sessions.live_attempts(frame, "who", "at").collect()) == [("a", 1), ("a", 1), ("a", 2), ("a", 2), ("b", 1)]
    counts = {(r.who, r.n) for r in sessions.streamed_attempts(frame.withColumn("at", F.col("at").cast("timestamp")), "who", "at").collect()}
    assert counts == {("a", 2), ("a", 1), ("b", 1)}


def test_prior_similar_meets_no_prior_twice(spark):
    """Pairs carry their score: three joins for three columns and none on the newest rows, which all pairs share; a pair found by several columns counts once."""
    bids = spark.range(400).selectExpr("id", "id % 2 AS a", "'x' AS b", "id % 3 AS c", "id AS day")
    found = history.prior_similar(bids.where("id = 0"), bids, "id", {"a": 3, "b": 2, "c": 1}, "day", newest=6, limit=6)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 3
    assert {(r.prior, r.score) for r in found.collect()} == {(399, 3), (398, 5), (397, 2), (396, 6), (395, 2), (394, 5)}
