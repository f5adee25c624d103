"""Nested JSON against plain walks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tenderflow.operators import nested


def harvest(node):
    out = []
    if isinstance(node, dict):
        if isinstance(node.get("items"), list):
            for x in node["items"]:
                if isinstance(x, dict):
                    out += [x, *harvest(x)]
        for k in nested.NESTED:
            if isinstance(node.get(k), (list, dict)):
                out += harvest(node[k])
    elif isinstance(node, list):
        for x in node:
            out += harvest(x)
    return out


def found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    out = {k: [] for k in range(len(texts))}
    for r in nested.harvested(frame, "k", "t").orderBy("k", "pos").collect():
        assert r.pos == len(out[r.k])
        out[r.k].append(json.loads(r.item))
    return list(out.values())


@pytest.mark.parametrize(
    "value,ids",
    [
        ({"items": [{"id": 1, "items": [{"id": 2}]}, 3], "openings": [{"items": [{"id": 4}]}], "hardware_sets": {"items": [{"id": 5}]}}, [1, 2, 5, 4]),
        ([[{"items": [{"id": 1}]}], {"other": {"items": [{"id": 9}]}}], [1]),
        ({"items": {"id": 1}, "groups": "x"}, []),
        (None, []),
        (7, []),
    ],
)
def test_harvested(spark, value, ids):
    assert [x["id"] for x in found(spark, [json.dumps(value)])[0]] == ids


def test_harvested_by_a_plain_walk(spark):
    rng = random.Random(2)

    def some(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.15:
            return rng.choice([None, 7, "x", True, {}, []])
        if kind < 0.35:
            return [some(depth - 1) for _ in range(rng.randrange(4))]
        return {k: some(depth - 1) for k in rng.sample(["items", "items", "groups", "openings", "hardware_sets", "other", "id"], 3)} | ({"items": [some(depth - 1) for _ in range(3)]} if kind > 0.6 else {})

    values = [some(7) for _ in range(60)]
    deep = {"id": 0}
    for i in range(1, 60):
        deep = {"id": i, "items": [deep]}
    assert found(spark, [*map(json.dumps, values), json.dumps(deep), None, "{", ""]) == [*map(harvest, values), harvest(deep), [], [], []]


def box(raw):
    if not isinstance(raw, list) or len(raw) < 4 or not all(isinstance(x, (int, float)) for x in raw[:4]) or raw[2] <= raw[0] or raw[3] <= raw[1]:
        return None
    return [round(float(x), 2) for x in raw[:4]]


def spans_text(spans):
    return "".join(s.get("content") or s.get("text") or "" for s in spans if isinstance(s, dict))


def line_text(x):
    return x.get("content") or (spans_text(x["spans"]) if isinstance(x.get("spans"), list) else "")


def walk(blocks, discarded=False):
    out = []
    for b in blocks if isinstance(blocks, list) else []:
        if not isinstance(b, dict):
            continue
        if isinstance(b.get("blocks"), list) and b["blocks"]:
            out += walk(b["blocks"], discarded)
            continue
        for k in nested.SUB_BLOCKS:
            if isinstance(b.get(k), list) and b[k] and isinstance(b[k][0], dict):
                out += walk(b[k], discarded)
        lines = [x for x in b["lines"] if isinstance(x, dict)] if isinstance(b.get("lines"), list) else None
        text = b.get("content") or ("\n".join(t for t in map(line_text, lines) if t) if lines is not None else spans_text(b["spans"]) if isinstance(b.get("spans"), list) else "")
        kind = "discarded" if discarded else (b.get("type") or b.get("block_type") or "text").lower().replace(" ", "_")
        html = None
        if kind in ("table", "table_body") or b.get("type") == "table":
            inner = [s for x in lines or [] for s in x.get("spans") or [] if isinstance(s, dict)]
            html = b.get("html") or b.get("table_html") or next((s.get("html") or (s.get("content") if s.get("type") == "table" else None) for s in b.get("spans") or [] if s.get("html") or s.get("type") == "table" and s.get("content")), None) or next((s["html"] for s in inner if s.get("html")), None)
        entries = [(line_text(x), box(x.get("bbox"))) for x in lines or [] if line_text(x) or box(x.get("bbox"))]
        if box(b.get("bbox")) or text.strip() or html:
            out.append(("table" if html else kind, text.strip(), box(b.get("bbox")), entries or None, html, b.get("angle")))
    return out


def page_blocks(page):
    out = walk(page.get("para_blocks") or page.get("preproc_blocks")) + walk(page.get("discarded_blocks"), True)
    return out or walk(page.get("blocks"))


def test_blocks_by_a_plain_walk(spark):
    rng = random.Random(4)

    def span():
        return rng.choice([{"content": "abc "}, {"text": "def"}, {"html": "<t>", "type": "table"}, {"type": "table", "content": "<c>"}, 5, {}])

    def block(depth):
        b = {}
        if rng.random() < 0.6:
            b["type"] = rng.choice(["Text", "table", "Table Body", "", "list"])
        if rng.random() < 0.3:
            b["content"] = rng.choice([" one\n", "", "two"])
        if rng.random() < 0.5:
            b["bbox"] = rng.choice([[0, 0, 10.126, 5], [5, 5, 1, 1], [1, 2], [0, "x", 3, 4], None])
        if rng.random() < 0.4:
            b["lines"] = [rng.choice([{"spans": [span() for _ in range(2)], "bbox": [0, 0, 1, 1]}, {"content": "line"}, 3, {}]) for _ in range(2)]
        if rng.random() < 0.2:
            b["spans"] = [x for x in (span() for _ in range(2)) if isinstance(x, dict)]
        if rng.random() < 0.1:
            b["angle"] = 90.0
        if depth:
            for k in ("blocks", *nested.SUB_BLOCKS):
                if rng.random() < 0.25:
                    b[k] = [block(depth - 1) for _ in range(rng.randrange(3))] + ([7] if rng.random() < 0.2 else [])
        return b

    pages = [{k: [block(3) for _ in range(rng.randrange(4))] for k in rng.sample(["para_blocks", "preproc_blocks", "discarded_blocks", "blocks"], 2)} for _ in range(80)]
    frame = spark.createDataFrame([*enumerate(map(json.dumps, pages)), (900, None), (901, "{"), (902, "[]"), (903, "{}")], "k long, page string")
    out = {}
    for r in nested.blocks(frame, "k", "page").orderBy("k", "n").collect():
        out.setdefault(r.k, []).append((r.type, r.text, r.bbox, [(x.text, x.bbox) for x in r.lines] if r.lines else None, r.html, r.angle))
        assert r.n == len(out[r.k])
    assert out == {k: b for k, p in enumerate(pages) if (b := page_blocks(p))}


def test_window_pages(spark):
    page = {"page_size": [612.004, 792], "para_blocks": [{"content": "x"}]}
    payloads = [
        {"pdf_info": [page, 5, {"page_size_pts": [1, 2]}]}, [page], {"middle_json": {"pages": {"a": page}}}, {"middle_json": json.dumps({"page_info": [page]})},
        {"results": {"f.pdf": {"middle_json": {"pdf_info": [page]}}}}, {"status": "done", "task_id": 1}, 7,
    ]
    frame = spark.createDataFrame([*[(i, json.dumps(p), 10) for i, p in enumerate(payloads)], (99, "{", 1), (98, None, 1)], "k long, p string, start int")
    rows = [(r.k, r.page, r.width, r.height) for r in nested.window_pages(frame, "k", "p", "start").orderBy("k", "page").collect()]
    assert rows == [(0, 10, 612.0, 792.0), (0, 11, 1.0, 2.0), *[(k, 10, 612.0, 792.0) for k in (1, 2, 3, 4)]]
    whole = nested.window_pages(frame.where("k = 1"), "k", "p", "start")
    assert [r.text for r in nested.blocks(whole, "page", "payload").collect()] == ["x"]


def test_walks_deal_no_levels(spark):
    """Items and blocks are walked within their rows: no recursive query, and items need no shuffle at all; 880 levels deep."""
    deep = '{"id": 0, "items": [' * 440 + "]}" * 440
    docs = spark.createDataFrame([(1, deep), (2, '{"openings": [[{"items": [{"id": 1}, 2, {"id": 3}]}]]}')], "k long, doc string")
    items, blocks = nested.harvested(docs, "k", "doc"), nested.blocks(docs, "k", "doc")
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (items, blocks)]
    assert "UnionLoop" not in plans[0] + plans[1] and "Window" not in plans[0]
    assert {r.k: r.n for r in items.groupBy("k").agg(F.count("*").alias("n")).collect()} == {1: 439, 2: 2}
    page = '{"para_blocks": [' + '{"blocks": [' * 300 + '{"content": "x"}' + "]}" * 300 + "]}"
    assert [(r.n, r.text) for r in nested.blocks(spark.createDataFrame([(1, page)], "k long, doc string"), "k", "doc").collect()] == [(1, "x")]
