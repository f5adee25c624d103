"""Catalogue pages described from their text, and drawing sheets by role: column expressions over the lines of a page."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of prices, part numbers, finishes, years, bare page numbers and page furniture.
PRICE = r"(?U)(?<![\w.])\$?\d{1,3}(?:,\d{3})*\.\d{2}(?![\w])"
CODE = r"\b(?:[A-Z]{1,4}-?\d{2,5}[A-Z0-9/-]*|\d{4,5}[A-Z][A-Z0-9/-]*|\d{4,5})\b"
FINISH, YEAR, BARE_NUMBER = r"^US\d{1,2}[A-Z]?$", r"^(?:19|20)\d{2}$", r"^\d{1,4}$"
FURNITURE = r"(?i)^(?:\d{1,4}|[\d/.\-]{6,}|(?:https?://)?www\..*|.*@.*|page \d+.*)$"
# Column labels that are no titles, words that name no product, and headings of money columns.
GENERIC = ["MODEL NUMBER", "CATEGORY", "DESCRIPTION", "PRICE EACH", "ITEM", "ITEM NUMBER", "PRODUCT", "PRODUCT NAME", "SHIPPING", "PART NUMBER", "LIST PRICE", "NET PRICE", "PAGE", "QTY", "QUANTITY"]
NOISE = ["model", "number", "category", "price", "each", "shipping", "continued", "description", "item", "product", "name", "page", "total", "list", "net", "cu.ft", "wt-lbs", "finish", "size", "qty"]
MONEY_HEADINGS = [("MINIMUM ADVERTISED", "MAP"), ("MAP", "MAP"), ("LIST PRICE", "LIST"), ("NET PRICE", "NET"), ("DEALER", "DEALER")]
KINDS = {"price_table": "Price table", "item_numbers": "Item-number listing", "toc": "Contents", "prose": "Reference text", "diagram": "No text layer - diagram or scan", "unknown": "Page"}
LINE_ENDS, SPACE = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


@dataclass(frozen=True)
class Profile:
    """Where a catalogue's pages have their title and number ("line_index:3" or "regex:..."), what they repeat, and how its part numbers look."""

    title_source: str | None = None
    printed_source: str | None = None
    boilerplate: tuple[str, ...] = ()
    code_pattern: str | None = None


def text_lines(text: Column) -> Column:
    """Lines that are not empty, stripped; none of a null text."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_ENDS, -1), lambda x: F.regexp_replace(x, SPACE, ""))
    return F.filter(lines, lambda x: x != "")


def _sourced(source: str | None, lines: Column) -> Column:
    """What a rule of a profile finds on a page, null where it does not resolve."""
    kind, _, argument = (source or "").partition(":")
    if kind == "line_index" and re.fullmatch(r"\s*\+?\d+\s*", argument):
        return F.get(lines, F.lit(int(argument)))
    if kind == "regex":
        try:
            group = min(1, re.compile(argument, re.MULTILINE).groups)
        except re.error:
            return F.lit(None).cast("string")
        hit = F.get(F.filter(lines, lambda x: x.rlike(f"(?m){argument}")), F.lit(0))
        return F.regexp_replace(F.regexp_extract(hit, f"(?m){argument}", group), SPACE, "")
    return F.lit(None).cast("string")


def _ranked(values: Column, most: int) -> Column:
    """The values by how often they come, equal ones in order."""
    counted = F.transform(F.array_distinct(values), lambda x: F.struct((-F.size(F.filter(values, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.slice(F.transform(F.array_sort(counted), lambda s: s["x"]), 1, most)


def _families(body: Column, pattern: str) -> Column:
    def stem(token: Column) -> Column:
        head = F.split_part(F.upper(F.trim(token)), F.lit("/"), F.lit(1))
        first = F.split_part(head, F.lit("-"), F.lit(1))
        return F.when(F.length(first) >= 3, first).otherwise(head)

    group = min(1, re.compile(pattern).groups)
    stems = F.transform(F.flatten(F.transform(body, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(group)))), stem)
    return _ranked(F.filter(stems, lambda s: (F.length(s) >= 3) & ~s.rlike(FINISH) & ~s.rlike(YEAR)), 8)


def _keywords(body: Column) -> Column:
    """Heading-like lines from anywhere on the page: two to seven words set apart by case, not all of them column labels."""

    def words(x: Column) -> Column:
        return F.filter(F.split(x, r"[^A-Za-z]+"), lambda w: F.length(w) > 2)

    plain = F.transform(body, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)\(continued\)", ""), r"^[ \-:|]+|[ \-:|]+$", ""))
    title = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}")
    capitals = lambda x: (x == F.upper(x)) & (x != F.lower(x))
    good = F.filter(plain, lambda x: F.length(x).between(4, 60) & F.size(words(x)).between(2, 7) & (capitals(x) | title(x)) & F.exists(words(x), lambda w: ~F.lower(w).isin(NOISE)))
    return _ranked(F.transform(good, lambda x: F.upper(F.array_join(words(x), " "))), 6)


def _heading(lines: Column) -> Column:
    fits = F.filter(F.slice(lines, 1, 8), lambda x: F.length(x).between(3, 90) & ~x.rlike(FURNITURE) & x.rlike(r"\p{L}"))
    return F.left(F.get(fits, F.lit(0)), F.lit(80))


def _labelled(name: str) -> Callable[[Column], Column]:
    return lambda s: s["label"] == name


def _without(needle: str) -> Callable[[Column], Column]:
    return lambda x: ~F.contains(F.lower(x), F.lit(needle))


def _money_columns(body: Column) -> Column:
    """The money columns from left to right where a page prints more than one: where the first line that has it puts it."""
    found = F.flatten(F.transform(body, lambda x, i: F.filter(F.array(*[F.struct(F.lit(label).alias("label"), i.alias("line"), F.lit(k).alias("k"), F.instr(F.upper(x), needle).alias("at")) for k, (needle, label) in enumerate(MONEY_HEADINGS)]), lambda s: s["at"] > 0)))
    labels = list(dict.fromkeys(label for _, label in MONEY_HEADINGS))
    first = F.array_compact(F.array(*[F.get(F.filter(found, _labelled(name)), F.lit(0)) for name in labels]))
    ordered = F.array_sort(F.transform(first, lambda s: F.struct(s["at"].alias("at"), s["line"].alias("line"), s["k"].alias("k"), s["label"].alias("label"))))
    return F.when(F.size(ordered) > 1, F.transform(ordered, lambda s: s["label"])).otherwise(F.array().cast("array<string>"))


def described(pages: DataFrame, text: str = "text", profile: Profile = Profile()) -> DataFrame:
    """pages with title, printed_page, description, code_prefixes, keywords, has_prices, price_columns, kind and confidence.

    The title is what the profile finds; else the first line that reads like a heading, which caps the confidence at one half
    (a column label gives way to the first keyword). The printed page is the profile's, else a bare number in the first four
    lines. Kinds, in this order: diagram (no text), toc, price_table (prices and three part families), item_numbers (five
    families and no price), price_table (prices), prose (over a dozen lines), unknown. A null text is a page without text.
    """
    needles = [b.strip().lower() for b in profile.boilerplate if b.strip()]
    try:
        pattern = profile.code_pattern if profile.code_pattern and re.compile(profile.code_pattern) else CODE
    except re.error:
        pattern = CODE
    rows = pages.withColumn("_lines", text_lines(F.col(text)))
    lines = F.col("_lines")
    bare = F.get(F.filter(F.slice(lines, 1, 4), lambda x: x.rlike(BARE_NUMBER)), F.lit(0))
    rows = rows.withColumn("_named", F.coalesce(_sourced(profile.title_source, lines), F.lit(""))).withColumn("printed_page", F.coalesce(_sourced(profile.printed_source, lines), bare))
    body = lines
    for needle in needles:
        body = F.filter(body, _without(needle))
    rows = rows.withColumn("_body", body)
    named, body = F.col("_named"), F.col("_body")
    again = (named != "") & (F.lower(F.get(body, F.lit(0))) == F.lower(F.trim(named)))
    rows = rows.withColumn("_body", F.when(again, F.slice(body, 2, F.greatest(F.size(body), F.lit(1)))).otherwise(body))
    rows = rows.withColumn("has_prices", F.exists(body, lambda x: x.rlike(PRICE))).withColumn("keywords", _keywords(body)).withColumn("code_prefixes", _families(body, pattern))
    rows = rows.withColumn("price_columns", F.when(F.col("has_prices"), _money_columns(body)).otherwise(F.array().cast("array<string>")))
    n, prices, start = F.size("code_prefixes"), F.col("has_prices"), F.lower(F.array_join(F.slice(body, 1, 40), " "))
    steps = [(F.size(body) == 0, "diagram", 0.2), (start.contains("table of contents") | (F.trim(start) == "index"), "toc", 0.7), (prices & (n >= 3), "price_table", 0.9), (~prices & (n >= 5), "item_numbers", 0.8), (prices, "price_table", 0.6), (F.size(body) > 12, "prose", 0.5)]
    kind, sure = F.lit("unknown"), F.lit(0.3)
    for test, name, value in reversed(steps):
        kind, sure = F.when(test, name).otherwise(kind), F.when(test, value).otherwise(sure)
    heading = F.coalesce(_heading(body), _heading(lines), F.lit(""))
    first_word = F.get("keywords", F.lit(0))
    heading = F.when(F.upper(F.trim(heading)).isin(GENERIC) & first_word.isNotNull(), F.initcap(F.lower(first_word))).otherwise(heading)
    rows = rows.withColumn("kind", kind).withColumn("title", F.when(named != "", named).otherwise(heading))
    rows = rows.withColumn("confidence", F.when((named == "") & (F.col("title") != ""), F.least(sure, F.lit(0.5))).otherwise(sure))
    subject = F.coalesce(F.nullif("title", F.lit("")), F.left(F.get(body, F.lit(0)), F.lit(60)), F.lit(""))
    detail = F.get(F.filter(F.slice(body, 2, 7), lambda x: (F.lower(x) != F.lower(subject)) & F.length(x).between(4, 89)), F.lit(0))
    what = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("kind")]
    covers = F.array_join(F.transform(F.slice("keywords", 1, 4), lambda k: F.initcap(F.lower(k))), ", ")
    said = F.concat_ws(" ", F.concat(what, F.when(subject != "", F.concat(F.lit(" - "), subject)).otherwise(""), F.lit(".")), F.when(detail.isNotNull(), F.concat(F.lit("Begins: "), detail, F.lit("."))), F.when(F.size("keywords") > 0, F.concat(F.lit("Covers: "), covers, F.lit("."))), F.when(prices, "Carries prices."))
    return rows.withColumn("description", F.left(said, F.lit(400))).drop("_lines", "_named", "_body")


def needs_second_look(kind: Column, title: Column, confidence: Column) -> Column:
    """Pages that the cheap pass did not settle."""
    return (confidence < 0.5) | ((F.coalesce(title, F.lit("")) == "") & (kind == "unknown"))


def with_second_look(pages: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """pages (described) where those that need it are replaced by what a second look (on, unique, and some of the columns) found."""
    columns = [c for c in second.columns if c not in on]
    look = second.select(*on, F.struct(*columns).alias("_second"))
    weak = needs_second_look(F.col("kind"), F.col("title"), F.col("confidence")) & F.col("_second").isNotNull()
    joined = pages.join(look, on, "left")
    return joined.select(*[F.when(weak, F.col(f"_second.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in pages.columns])


# Words and markers by role of a drawing sheet, sheet numbers, and thresholds of characters.
ROLE_WORDS = {
    "title": ["title block", "cover sheet", "drawing index", "project no", "architect"],
    "door_schedule": ["door schedule", "door type", "opening schedule", "frame schedule"],
    "hardware": ["hardware", "hw set", "hardware set", "lockset", "hardware groups"],
    "div08_specs": ["division 08", "doors and frames", "hollow metal", "finish hardware", "wood doors"],
    "floor_plan": ["floor plan", "enlarged plan", "door plan", "first floor", "second floor"],
    "div10": ["toilet partition", "toilet accessories", "restroom accessories", "hand dryer", "washroom", "division 10"],
    "frp": ["frp", "fiberglass", "wall panel", "j-channel", "cove base"],
    "finish": ["finish schedule", "room finish", "finish"],
}
ROLE_MARKERS = {
    "door_schedule": ["DOOR SCHEDULE", "DOOR TYPE SCHEDULE", "FRAME SCHEDULE", "OPENING SCHEDULE", "DOOR AND FRAME SCHEDULE", "DOOR & FRAME SCHEDULE", "DOOR HARDWARE SCHEDULE", "HW SCHEDULE"],
    "hardware": ["HARDWARE GROUPS", "HARDWARE SCHEDULE", "FINISH HARDWARE", "DOOR HARDWARE SCHEDULE", "HW SCHEDULE"],
    "finish": ["FINISH SCHEDULE", "ROOM FINISH SCHEDULE"],
}
ROLE_PARTS = {
    "frp": ["FRP", "FIBERGLASS", "WALL PANEL"],
    "title": ["TITLE", "COVER", "INDEX"],
    "floor_plan": ["FLOOR PLAN", "ENLARGED PLAN", "DOOR PLAN"],
    "div10": ["TOILET", "PARTITION", "ACCESSOR", "HAND DRYER", "DIVISION 10"],
    "div08_specs": ["DIVISION 08", "DOORS AND FRAMES"],
}
SCHEDULE_SHEET, DETAIL_SHEET, PLAN_SHEET = r"(?i)^A(?:2\.\d+|3\.0|4\.0|5\.0|7\.\d+|8\.0|9\.\d+|10\.0)$", r"(?i)^A\d+\.[1-9]\d*$", r"(?i)^A1\.\d+$"
STOREFRONT = ["storefront", "curtain wall", "window schedule", "window type", "glazing elev", "exterior elevation detail", "aluminum storefront"]
POOR, NO_LAYER = 500, 40
VISUAL_ORDER = ["door_schedule", "door_schedule_candidate", "hardware", "frp", "div10", "div08_specs", "floor_plan"]


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _holds(words: list[str]) -> Callable[[Column], Column]:
    return lambda x: _any(x, words)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sheet_roles(terms: Column, markers: Column, sheets: Column, chars: Column) -> Column:
    """The roles of a sheet, sorted, from hits of terms (map to counts), markers, sheet numbers and its number of characters.

    A schedule's sheet number makes a candidate where nothing names a schedule, and hardware, whose legend shares the sheet. On
    a sheet with little text other numbers of details do too, unless its terms speak of storefronts.
    """
    terms = F.coalesce(terms, F.create_map().cast("map<string, int>"))
    markers, sheets = (F.coalesce(x, F.array().cast("array<string>")) for x in (markers, sheets))
    ids = F.filter(sheets, lambda s: s.isNotNull() & (s != ""))
    hit = F.map_keys(F.map_filter(terms, lambda _, n: F.coalesce(n, F.lit(0)) != 0))
    poor = F.coalesce(chars < POOR, F.lit(False))
    given = F.struct(F.lower(F.concat_ws(" ", hit, markers)).alias("blob"), F.transform(markers, F.upper).alias("upper"), ids.alias("ids"), poor.alias("poor"), F.lower(F.array_join(F.map_keys(terms), " ")).alias("terms"))

    def named(x: Column) -> Column:
        has = {role: _any(x["blob"], words) for role, words in ROLE_WORDS.items()}
        for role, names in ROLE_MARKERS.items():
            has[role] = has[role] | F.arrays_overlap(x["upper"], F.array(*map(F.lit, names)))
        for role, parts in ROLE_PARTS.items():
            has[role] = has[role] | F.exists(x["upper"], _holds(parts))
        schedule = F.exists(x["ids"], lambda s: s.rlike(SCHEDULE_SHEET))
        detail = F.exists(x["ids"], lambda s: s.rlike(DETAIL_SHEET) & ~s.rlike(SCHEDULE_SHEET)) & x["poor"] & ~_any(x["terms"], STOREFRONT)
        has["floor_plan"] = has["floor_plan"] | F.exists(x["ids"], lambda s: s.rlike(PLAN_SHEET))
        has["text_poor"] = x["poor"] & (F.size(x["ids"]) > 0)
        return F.struct(*[F.coalesce(held, F.lit(False)).alias(role) for role, held in has.items()], schedule.alias("schedule"), (schedule | detail).alias("candidate"))

    def listed(x: Column) -> Column:
        has = {role: x[role] for role in [*ROLE_WORDS, "text_poor"]}
        has["door_schedule_candidate"] = x["candidate"] & ~x["door_schedule"]
        has["hardware"] = x["hardware"] | x["schedule"]
        return F.array_compact(F.array(*[F.when(has[role], role) for role in sorted(has)]))

    return _with(_with(given, named), listed)


def visual_reasons(roles: Column, chars: Column, text_poor: Column, parsed: Column, verified: Column, blocks: Column, sparse: Column) -> Column:
    """Why a sheet must be looked at, in order; empty where its text is enough.

    parsed says whether a parser has seen the page; then a null `verified` and no blocks are reasons. A role of value adds itself,
    the first in order, where the text is poor or missing or the take-off is sparse.
    """
    roles = F.transform(F.coalesce(roles, F.array().cast("array<string>")), F.lower)
    no_layer = F.coalesce(chars < NO_LAYER, F.lit(False))
    poor = F.coalesce(text_poor, F.lit(False)) | F.coalesce(chars < POOR, F.lit(False))
    sparse, parsed = F.coalesce(sparse, F.lit(False)), F.coalesce(parsed, F.lit(False))
    first = _with(roles, lambda held: F.get(F.filter(F.array(*map(F.lit, VISUAL_ORDER)), lambda r: F.array_contains(held, r)), F.lit(0)))

    def reasons(value: Column) -> Column:
        weighty = value.isNotNull()
        found = [(no_layer, F.lit("no_text_layer")), (poor, F.lit("text_poor")), (parsed & verified.isNull(), F.lit("mineru_verified_null")), (parsed & F.coalesce(blocks == 0, F.lit(False)), F.lit("mineru_empty_blocks")), (weighty & sparse, F.lit("pretakeoff_empty")), (weighty & (poor | no_layer | sparse), value)]
        return F.array_compact(F.array(*[F.when(test, name) for test, name in found]))

    return _with(first, reasons)
