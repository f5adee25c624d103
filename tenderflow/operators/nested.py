"""Nested JSON walked level by level: items at any depth, and the blocks of parsed pages.

Both walks go through a document's variant inside its own row, a step for each level, so no level is dealt or stored, nothing
runs row by row in Python and no depth is fixed beforehand (Spark's parser refuses documents nested deeper than 1,000
levels, which count as malformed). The order of a depth-first walk is that of the paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Keys below which items may be nested, after the items of a node itself; keys of a page's blocks.
NESTED = ["hardware_sets", "openings", "groups"]
SUB_BLOCKS = ["list_items", "code_body"]
#: Steps of a walk, in turns that are left out once nothing is left to walk; together more than the levels that Spark's parser takes.
STEPS = [10, 40, 160, 800]
BOX = "array<double>"


def _array(x: Column) -> Column:
    return F.try_variant_get(x, "$", "array<variant>")


def _object(x: Column) -> Column:
    return F.try_variant_get(x, "$", "map<string, variant>")


def _node(path: Column, kind: Column | str, node: Column) -> Column:
    return F.struct(path.alias("path"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), node.alias("node"))


def _none(kind: str = "struct<path: array<int>, kind: string, node: variant>") -> Column:
    return F.array().cast(f"array<{kind}>")


def _walk(roots: Column, children: Callable[[Column], Column], keep: Callable[[Column], Column], made: Callable[[Column], Column], kind: str) -> Column:
    """What `made` makes (of type kind) of the nodes that `keep` keeps, of a walk from roots to children, each an array of nodes (path, kind, node)."""

    def step(acc: Column, _: Column) -> Column:
        todo = acc["todo"]
        done = F.concat(acc["done"], F.transform(F.filter(todo, keep), made))
        return F.when(F.size(todo) == 0, acc).otherwise(F.struct(F.flatten(F.transform(todo, children)).alias("todo"), done.alias("done")))

    def more(steps: int) -> Callable[[Column], Column]:
        turns = F.array_repeat(F.lit(0), steps)
        return lambda acc: F.aggregate(F.when(F.size(acc["todo"]) > 0, turns).otherwise(F.array().cast("array<int>")), acc, step)

    walk = F.array(F.struct(roots.alias("todo"), _none(kind).alias("done")))
    for steps in STEPS:
        walk = F.transform(walk, more(steps))
    return F.get(walk, F.lit(0))["done"]


def harvested(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, item (JSON): the members of `items` that are objects, of a document and of what is nested in them, in depth-first order.

    An item comes before what is nested in it. Lists are walked through; other keys are not. Null, malformed and item-free
    documents give no rows.
    """
    source = docs.select(F.col(key).alias("key"), F.try_parse_json(text).alias("node")).where("node IS NOT NULL")

    def children(w: Column) -> Column:
        members = F.transform(_array(w["node"]), lambda v, i: _node(F.array_append(w["path"], i), F.when(w["kind"] == "items", "item").otherwise("node"), v))
        members = F.filter(members, lambda m: _object(m["node"]).isNotNull() | ((m["kind"] == "node") & _array(m["node"]).isNotNull()))
        named = [_node(F.array_append(w["path"], F.lit(i)), "node" if i else "items", F.try_variant_get(w["node"], f"$.{k}", "variant")) for i, k in enumerate(["items", *NESTED])]
        named = F.filter(F.array(*named), lambda m: _array(m["node"]).isNotNull() | ((m["kind"] == "node") & _object(m["node"]).isNotNull()))
        return F.coalesce(members, named)

    roots = F.array(_node(F.array().cast("array<int>"), "node", F.col("node")))
    items = _walk(roots, children, lambda w: w["kind"] == "item", lambda w: F.struct(w["path"].alias("path"), F.to_json(w["node"]).alias("item")), "struct<path: array<int>, item: string>")
    rows = source.select("key", F.posexplode(F.array_sort(items)).alias("pos", "found"))
    return rows.select(F.col("key").alias(key), "pos", F.col("found.item").alias("item"))


def _text(node: Column, name: str) -> Column:
    """A member as text, null where it is missing or empty."""
    return F.nullif(F.try_variant_get(node, f"$.{name}", "string"), F.lit(""))


def _objects(node: Column, name: str) -> Column:
    """The members of a list that are objects; null where there is no list."""
    return F.filter(F.try_variant_get(node, f"$.{name}", "array<variant>"), lambda x: F.try_variant_get(x, "$", "map<string, variant>").isNotNull())


def _spans(node: Column) -> Column:
    return F.array_join(F.transform(_objects(node, "spans"), lambda s: F.coalesce(_text(s, "content"), _text(s, "text"), F.lit(""))), "")


def _line(line: Column) -> Column:
    return F.coalesce(_text(line, "content"), _spans(line), F.lit(""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _box(node: Column) -> Column:
    """Four numbers rounded to cents of a point; null unless the second corner lies right of and below the first."""
    raw = F.try_variant_get(node, "$.bbox", "array<variant>")
    box = F.transform(F.slice(raw, 1, 4), lambda x: F.round(F.try_variant_get(x, "$", "double"), 2))
    exact = F.transform(F.slice(raw, 1, 4), lambda x: F.try_variant_get(x, "$", "double"))
    good = (F.size(raw) >= 4) & ~F.exists(exact, lambda x: x.isNull()) & (F.get(exact, F.lit(2)) > F.get(exact, F.lit(0))) & (F.get(exact, F.lit(3)) > F.get(exact, F.lit(1)))
    return F.when(good, box)


def _first_html(spans: Column) -> Column:
    one = F.transform(spans, lambda s: F.coalesce(_text(s, "html"), F.when(F.try_variant_get(s, "$.type", "string") == "table", _text(s, "content"))))
    return F.get(F.array_compact(one), F.lit(0))


def blocks(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """key, n, type, text, bbox, lines, html and angle of the leaf blocks of pages (payload: a page as JSON text), n from 1 in order.

    A block with blocks of its own gives way to them. Blocks under list_items and code_body come before their parent, which is
    kept beside them. Kept are blocks with a box, text or table HTML. A page's blocks are its para_blocks, or where these are
    missing or empty its preproc_blocks, and then its discarded_blocks as type discarded; only where none of these gives
    anything its `blocks`. Null and malformed pages, and pages without blocks, give no rows.
    """
    parsed = pages.select(F.col(key).alias("key"), F.try_parse_json(payload).alias("page")).where("page IS NOT NULL")
    lists = {c: F.try_variant_get("page", f"$.{c}", "array<variant>") for c in ("para_blocks", "preproc_blocks")}
    body = F.when(F.size(lists["para_blocks"]) > 0, F.try_variant_get("page", "$.para_blocks", "variant")).otherwise(F.try_variant_get("page", "$.preproc_blocks", "variant"))
    parts = [body, *[F.try_variant_get("page", f"$.{c}", "variant") for c in ("discarded_blocks", "blocks")]]
    roots = F.filter(F.array(*[_node(F.array(F.lit(i)), "list", x) for i, x in enumerate(parts)]), lambda w: _array(w["node"]).isNotNull())

    def inner(node: Column) -> Column:
        return F.coalesce(F.size(F.try_variant_get(node, "$.blocks", "array<variant>")) > 0, F.lit(False))

    def children(w: Column) -> Column:
        members = F.transform(_array(w["node"]), lambda v, i: _node(F.array_append(w["path"], i), "block", v))
        members = F.filter(members, lambda m: _object(m["node"]).isNotNull())
        subs = F.array(*[_node(F.array_append(w["path"], F.lit(i)), "list", F.try_variant_get(w["node"], f"$.{k}", "variant")) for i, k in enumerate(SUB_BLOCKS)])
        subs = F.filter(subs, lambda m: _object(F.get(_array(m["node"]), F.lit(0))).isNotNull())
        own = F.array(_node(F.array_append(w["path"], F.lit(0)), "list", F.try_variant_get(w["node"], "$.blocks", "variant")))
        return F.when(w["kind"] == "list", members).when(inner(w["node"]), own).otherwise(subs)

    leaves = _walk(roots, children, lambda w: (w["kind"] == "block") & ~inner(w["node"]), lambda w: F.struct(w["path"].alias("path"), w["node"].alias("node")), "struct<path: array<int>, node: variant>")
    own = parsed.select("key", F.inline(leaves))
    node = F.col("node")
    lines = _objects(node, "lines")
    joined = F.array_join(F.filter(F.transform(lines, _line), lambda x: x != ""), "\n")
    text = _strip(F.coalesce(_text(node, "content"), F.when(lines.isNotNull(), joined), _spans(node), F.lit("")))
    discarded = F.col("path")[0] == 1
    kind = F.when(discarded, "discarded").otherwise(F.replace(F.lower(F.coalesce(_text(node, "type"), _text(node, "block_type"), F.lit("text"))), F.lit(" "), F.lit("_")))
    table = kind.isin("table", "table_body") | F.coalesce(F.try_variant_get(node, "$.type", "string") == "table", F.lit(False))
    deep = F.get(F.array_compact(F.transform(F.flatten(F.array_compact(F.transform(lines, lambda x: _objects(x, "spans")))), lambda s: _text(s, "html"))), F.lit(0))
    html = F.when(table, F.coalesce(_text(node, "html"), _text(node, "table_html"), _text(node, "table_body"), _first_html(_objects(node, "spans")), deep))
    entries = F.filter(F.transform(lines, lambda x: F.struct(_line(x).alias("text"), _box(x).alias("bbox"))), lambda e: (e["text"] != "") | e["bbox"].isNotNull())
    angle = F.try_variant_get(node, "$.angle", "double")
    rows = own.select("key", F.array_append("path", F.lit(2)).alias("path"), F.when(html.isNotNull(), "table").otherwise(kind).alias("type"), text.alias("text"), _box(node).alias("bbox"), F.when(F.size(entries) > 0, entries).alias("lines"), html.alias("html"), angle.alias("angle"))
    rows = rows.where("bbox IS NOT NULL OR text <> '' OR html IS NOT NULL")
    rows = rows.withColumn("part", F.col("path")[0]).withColumn("first", F.min("part").over(W.partitionBy("key"))).where("part < 2 OR first = 2")
    n = F.row_number().over(W.partitionBy("key").orderBy("path"))
    return rows.select(F.col("key").alias(key), n.alias("n"), "type", "text", "bbox", "lines", "html", "angle")


def window_pages(windows: DataFrame, key: str, payload: str, start: str) -> DataFrame:
    """key, page, width, height and payload (JSON) of each page of parsed windows (payload: JSON text, start: the first page's number).

    The pages are a list itself, or those of pdf_info, pages or page_info, inside middle_json (an object, or its text) or in the
    first of the results where the payload has none of these. Members that are no objects are no pages.
    """
    names = ["pdf_info", "pages", "page_info"]

    def listed(x: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), *[F.coalesce(F.try_variant_get(x, f"$.{n}", "array<variant>"), F.map_values(F.try_variant_get(x, f"$.{n}", "map<string, variant>"))) for n in names])

    def inside(x: Column) -> Column:
        return F.coalesce(listed(x), listed(F.try_variant_get(x, "$.middle_json", "variant")), listed(F.try_parse_json(F.try_variant_get(x, "$.middle_json", "string"))))

    raw = F.try_parse_json(payload)
    entry = F.get(F.map_values(F.try_variant_get(raw, "$.results", "map<string, variant>")), F.lit(0))
    found = F.filter(F.coalesce(inside(raw), inside(entry)), lambda x: F.try_variant_get(x, "$", "map<string, variant>").isNotNull())
    rows = windows.select(F.col(key), F.col(start).alias("start"), F.posexplode(found).alias("pos", "node"))

    def side(i: int) -> Column:
        return F.coalesce(*[F.try_variant_get("node", f"$.{c}[{i}]", "double") for c in ("page_size", "page_size_pts")])

    return rows.select(key, (F.col("start") + F.col("pos")).alias("page"), F.round(side(0), 2).alias("width"), F.round(side(1), 2).alias("height"), F.to_json("node").alias("payload"))
