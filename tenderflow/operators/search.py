"""Search over pages, items and blocks: scores as column expressions, ranks with explicit tie-breakers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Words that every page holds and that therefore tell none apart.
STOPWORDS = """a an and or the for of with to in on at by from price prices list cost
each item items product products series type size finish""".split()
# Fixed patterns of a part code, of a finish and of a year, and of a sheet's own number.
CODE = r"\b(?:[A-Z]{1,4}-?\d{2,5}[A-Z0-9/-]*|\d{4,5}[A-Z][A-Z0-9/-]*|\d{4,5})\b"
FINISH, YEAR = r"^US\d{1,2}[A-Z]?$", r"^(?:19|20)\d{2}$"
SHEET = r"\b([A-Z]{1,3}\d{0,2}\.\d{1,2}|[A-Z]{2,6}-\d{1,2}|TAS-\d)\b"


def terms_of(query: Column) -> Column:
    """Upper-case terms of a query of at least two characters, in order, repeats included."""
    return F.filter(F.split(F.upper(query), "[^A-Za-z0-9/-]+"), lambda x: F.length(x) > 1)


def query_terms(query: str) -> Column:
    """The same of a query that is known when the plan is built."""
    return F.array(*[F.lit(x) for x in re.split("[^A-Za-z0-9/-]+", query.upper()) if len(x) > 1]).cast("array<string>")


def telling(terms: Column) -> Column:
    return F.filter(terms, lambda x: ~F.lower(x).isin(STOPWORDS))


def page_score(terms: Column, title: Column, description: Column, prefixes: Column, keywords: Column, has_prices: Column, kind: Column, confidence: Column) -> Column:
    """How well a page answers the terms; the weights are fixed values.

    Each term counts once, by the first that holds: a code family that starts with it or that it starts with, the
    title, the keywords, the description. A term with a digit weighs more as a code or title. The whole phrase in title or keywords,
    and prices on a page that scores at all, add to it; diagrams and doubtful pages are scaled down.
    """
    top, body, words = F.upper(title), F.upper(description), F.upper(F.array_join(keywords, " "))
    families = F.transform(prefixes, F.upper)
    told = telling(terms)

    def points(term: Column) -> Column:
        code = term.rlike("[0-9]")
        family = F.exists(families, lambda x: x.startswith(term) | term.startswith(x))
        return (
            F.when(family, F.when(code, 5.0).otherwise(2.0))
            .when(top.contains(term), F.when(code, 3.0).otherwise(2.0))
            .when(words.contains(term), 2.5)
            .when(body.contains(term), 0.5)
            .otherwise(0.0)
        )

    phrase = F.array_join(told, " ")
    bonus = F.when(phrase == "", 0.0).when(top.contains(phrase), 5.0).when(words.contains(phrase), 3.0).otherwise(0.0)
    found = F.aggregate(told, F.lit(0.0), lambda total, term: total + points(term)) + bonus
    found = found + F.when((found > 0) & has_prices, 1.0).otherwise(0.0)
    return F.round(found * F.when(kind == "diagram", 0.4).otherwise(1.0) * (0.5 + confidence / 2), 2)


def ranked(hits: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in an order, with their place: a top-k, so that no task sorts more than the winners of the others."""
    best = hits.orderBy(*order).limit(limit)
    return best.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))


def item_tier(needle: str, part: Column, model: Column) -> Column:
    """0 where part or model is the needle, 1 where one starts with it, 2 otherwise; case does not matter."""
    upper = needle.strip().upper()
    names = [F.upper(F.coalesce(x, F.lit(""))) for x in (part, model)]
    same = (names[0] == upper) | (names[1] == upper)
    return F.when(same, 0).when(names[0].startswith(upper) | names[1].startswith(upper), 1).otherwise(2)


def tiered(items: DataFrame, needle: str, part: str, model: str, trusted: str, key: str, limit: int = 8) -> DataFrame:
    """The best items whose part or model holds the needle: by tier, trusted first, the shorter part, the alphabet, then the key.

    An empty needle finds nothing.
    """
    upper = needle.strip().upper()
    hold = (F.upper(F.col(part)).contains(upper) | F.upper(F.col(model)).contains(upper)) if upper else F.lit(False)
    found = items.where(hold).withColumn("tier", item_tier(needle, F.col(part), F.col(model)))
    order = [F.col("tier"), F.when(F.col(trusted), 0).otherwise(1), F.length(part), F.upper(F.col(part)), F.col(key)]
    return ranked(found, order, max(1, min(limit, 25)))


def count_of(text: Column, term: str) -> Column:
    """Occurrences of a term that do not overlap, case aside."""
    low = F.lower(text)
    return F.coalesce(((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)).cast("long"), F.lit(0))


def sheet_map(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Adds hits (term to count, of those found), score, sheet_ids and char_count; pages with neither hits nor sheet ids go."""
    text = F.coalesce("text", F.lit(""))
    counts = F.map_from_arrays(F.array(*[F.lit(x) for x in terms]), F.array(*[count_of(text, x) for x in terms]))
    out = pages.withColumn("hits", F.map_filter(counts, lambda _, n: n > 0))
    out = out.withColumn("score", F.aggregate(F.map_values("hits"), F.lit(0).cast("long"), lambda a, n: a + n))
    out = out.withColumn("sheet_ids", F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(SHEET), 1)))
    return out.withColumn("char_count", F.length(F.regexp_replace(text, r"^\s+|\s+$", "")).cast("long")).where("score > 0 OR size(sheet_ids) > 0")


def _found(text: str, low: str, needle: str, half: int) -> list[tuple[int, str]]:
    out, at = [], low.find(needle)
    while at >= 0:
        out.append((at, text[max(at - half, 0) : at + len(needle) + half]))
        at = low.find(needle, at + 1)
    return out


def text_hits(pages: DataFrame, needle: str, context: int = 160) -> DataFrame:
    """Every place (from 0) of the needle in text, overlapping ones too, case aside, with the text around it; an empty needle has none.

    One pass over a text, however long: substr counts characters from the start, so a test of each place would be quadratic.
    """
    wanted, half = needle.lower(), max(context // 2, 40)
    # the one character whose lower case is two, which would shift the places after it
    low = F.lower(F.replace("text", F.lit("\u0130"), F.lit("i")))
    held = pages.where(low.contains(wanted) if wanted else F.lit(False))
    hits = F.udf(lambda text, lowered: _found(text, lowered, wanted, half), "array<struct<place: bigint, context: string>>")
    return held.withColumn("hit", F.explode(hits("text", low))).select(*pages.columns, "hit.place", "hit.context")


def block_hits(blocks: DataFrame, query: str, keep: int = 500) -> DataFrame:
    """Blocks (text) that hold the phrase or one of its words of more than two characters, text cut at `keep`.

    score is the number of different words found.
    """
    words = list(dict.fromkeys(x for x in query.lower().split() if len(x) > 2))
    low = F.lower("text")
    score = sum((low.contains(x).cast("int") for x in words), F.lit(0))
    return blocks.withColumn("score", score).where((F.col("score") > 0) | low.contains(query.lower())).withColumn("text", F.left("text", F.lit(keep)))


def stem(code: Column) -> Column:
    """The family of a code: before the first slash, and before the first hyphen if that leaves three characters."""
    head = F.substring_index(F.upper(F.trim(code)), "/", 1)
    first = F.substring_index(head, "-", 1)
    return F.when(F.length(first) >= 3, first).otherwise(head)


def code_families(pages: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """(key, family, n, place): the most frequent code families of each page, equal ones by name."""
    codes = pages.select(key, F.explode(F.regexp_extract_all("text", F.lit(CODE), 0)).alias("code"))
    families = codes.select(key, stem(F.col("code")).alias("family")).where(F.length("family") >= 3)
    families = families.where(~F.col("family").rlike(FINISH) & ~F.col("family").rlike(YEAR))
    counts = families.groupBy(key, "family").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "family"))
    return counts.withColumn("place", place).where(F.col("place") <= limit)


def sheet_order(kind: Column, roles: Column, score: Column, page: Column) -> list[Column]:
    """Schedules first, then pages with the role, then candidates of it, then by score and page."""
    return [F.when(kind == "schedule", 0).otherwise(1), F.when(F.array_contains(roles, "door_schedule"), 0).otherwise(1), F.when(F.array_contains(roles, "door_schedule_candidate"), 0).otherwise(1), F.desc(score), page]


#: Roles for which a page is looked at, the most urgent first.
VISUAL_ROLES = ["door_schedule", "door_schedule_candidate", "hardware", "frp", "div10", "div08_specs", "floor_plan", "text_poor"]


def visual_targets(pages: DataFrame, cap: int = 24) -> DataFrame:
    """Pages (path, source_page, roles, reasons, needs, forced) to be looked at, by role, need and page, at most `cap`.

    Forced pages take part whether or not they need it, and get the reason pretakeoff_empty.
    """
    reasons = F.when(F.col("forced"), F.array_union("reasons", F.array(F.lit("pretakeoff_empty")))).otherwise(F.col("reasons"))
    rows = pages.where("needs OR forced").withColumn("reasons", reasons)
    either = F.array_union("roles", "reasons")
    rank = F.coalesce(*[F.when(F.array_contains(either, r), i) for i, r in enumerate(VISUAL_ROLES)], F.lit(len(VISUAL_ROLES)))
    order = [F.col("role_rank"), F.col("source_page"), F.col("path")]
    return ranked(rows.withColumn("role_rank", rank), order, cap)
