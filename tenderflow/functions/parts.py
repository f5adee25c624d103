"""Part numbers and specifications as text: tokens, candidates, keys and their likeness."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern of a measurement written without a space.
MEASUREMENT = "^[0-9]+(in|ins|inch|inches|ft|feet|mm|cm|m)$"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"[\s\-_/,]+"), lambda x: x != "")


def spec_key(text: Column) -> Column:
    """Lower case, letters and digits of each token, single spaces."""
    return F.array_join(F.filter(F.transform(tokens(F.lower(text)), lambda x: F.regexp_replace(x, "[^0-9a-z]+", "")), lambda x: x != ""), " ")


def specific(candidate: Column) -> Column:
    return (F.length(candidate) >= 2) & candidate.rlike("[0-9]")


def vendor_names(vendors: list[str]) -> list[str]:
    """Lower-case tokens of the vendors' names, and the names whole, so that a name of two words is known as such and by each word."""
    split = [[x.lower() for x in re.split(r"[\s\-_/,]+", v.strip()) if x] for v in vendors]
    return sorted({x for names in split for x in names} | {" ".join(names) for names in split if names})


def candidates(part: Column, vendors: list[str]) -> Column:
    """The part itself, then without a leading vendor (two words before one), then each shorter run of its leading tokens; only those that say something."""
    parts = tokens(part)
    known = F.array(*[F.lit(v) for v in vendor_names(vendors)]).cast("array<string>")

    def led(n: int) -> Column:
        return (F.size(parts) > n) & F.array_contains(known, F.lower(F.array_join(F.slice(parts, 1, n), " ")))

    skip = F.when(led(2), 2).when(led(1), 1).otherwise(0)
    body = F.slice(parts, skip + 1, F.size(parts))
    widths = F.reverse(F.sequence(F.lit(1), F.greatest(F.size(body) - F.when(skip > 0, 0).otherwise(1), F.lit(1))))
    shorter = F.transform(widths, lambda n: F.array_join(F.slice(body, 1, n), "-"))
    return F.filter(F.array_distinct(F.concat(F.array(F.trim(part)), shorter)), specific)


def part_tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda x: x.rlike("[a-z]") & x.rlike("[0-9]") & ~x.rlike(MEASUREMENT)))


def similarity(left: Column, right: Column) -> Column:
    """1 for equal keys, 0.95 for the same part numbers, 0 for different ones, else the share of common tokens."""
    a, b = part_tokens(left), part_tokens(right)
    x, y = F.array_distinct(F.split(left, " ")), F.array_distinct(F.split(right, " "))
    share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return (
        F.when((left == "") | (right == ""), 0.0)
        .when(left == right, 1.0)
        .when((F.size(a) > 0) & (F.array_sort(a) == F.array_sort(b)), 0.95)
        .when((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), 0.0)
        .otherwise(share)
    )


def minutes(rating: Column) -> Column:
    """All digits of the text as a number; null without any."""
    return F.nullif(F.regexp_replace(rating, "[^0-9]", ""), F.lit("")).cast("int")


def norm(text: Column) -> Column:
    """Trimmed and in capitals; null where nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(text, r"^\s+|\s+$", "")), F.lit(""))


def rating_minutes(text: Column) -> Column:
    """All digits of a rating as a number: 90, "90 min" and "90-minute" are 90; null without any."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("long")


def rating_conflict(needed: Column, offered: Column) -> Column:
    """A rated opening needs at least its rating; an unrated one takes anything."""
    return needed.isNotNull() & (offered.isNull() | (offered < needed))


def match_confidence(asked: Column, agreed: Column, matched: Column, failed: Column) -> Column:
    return (
        F.when(failed > 0, 0.0)
        .when(asked == 0, F.when(matched > 0, 0.55).otherwise(0.40))
        .when(agreed == asked, F.when(matched > asked, 0.95).otherwise(0.90))
        .otherwise(0.40 + 0.35 * (agreed / asked))
    )


def fraction(label: Column) -> Column:
    """5-3/4, 7/8 or 2.5 as a number; null for anything else, nothing above zero, or a zero denominator."""
    whole = F.nullif(F.regexp_extract(label, r"^(?:([0-9]+)[- ])?([0-9]+)/([0-9]+)$", 1), F.lit("")).cast("double")
    top = F.nullif(F.regexp_extract(label, r"^(?:([0-9]+)[- ])?([0-9]+)/([0-9]+)$", 2), F.lit("")).cast("double")
    under = F.nullif(F.regexp_extract(label, r"^(?:([0-9]+)[- ])?([0-9]+)/([0-9]+)$", 3), F.lit("")).cast("double")
    value = F.coalesce(F.coalesce(whole, F.lit(0.0)) + F.try_divide(top, under), label.try_cast("double"))
    return F.when(value > 0, value)


def width_inches(text: Column) -> Column:
    """42", 42 in, else a trailing -NN from 24 to 48."""
    quoted = F.nullif(F.regexp_extract(text, r'([0-9]+)\s*(?:"|in\b)', 1), F.lit("")).cast("int")
    tail = F.nullif(F.regexp_extract(text, r"-([0-9]{2})(?:$|[^0-9])", 1), F.lit("")).cast("int")
    return F.coalesce(quoted, F.when(tail.between(24, 48), tail))


def page_range(spec: Column, last: int) -> Column:
    """1-3,7 as page numbers from 1 to last, in the order and as often as given; null, empty and all stand for every page.

    Empty pieces and pages out of range are left out, as are pieces that are no numbers.
    """

    def run(piece: Column) -> Column:
        ends = F.split(F.trim(piece), "-", 2)
        first, final = F.get(ends, F.lit(0)).try_cast("int"), F.element_at(ends, -1).try_cast("int")
        low, high = F.greatest(first, F.lit(1)), F.least(final, F.lit(last))
        return F.when(first.isNotNull() & final.isNotNull() & (high >= low), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    every = F.coalesce(F.lower(F.trim(spec)), F.lit(""))
    listed = F.flatten(F.transform(F.split(spec, ","), run))
    return F.when(every.isin("", "all"), F.sequence(F.lit(1), F.lit(last))).otherwise(listed)
