"""Versions, revisions, merges and differences of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def nth_repeat(key: Column, order: list[Column]) -> Column:
    """The key itself the first time, key#n for its nth repeat."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return F.when(n == 1, key).otherwise(F.concat(key, F.lit("#"), n.cast("string")))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int = 1) -> DataFrame:
    """The first rows of each key in order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def prior_similar(asked: DataFrame, rows: DataFrame, key: str, weights: dict[str, int], when: str, newest: int = 50, limit: int = 5) -> DataFrame:
    """(asked, prior, score): of the `newest` other rows that share a weighted column with an asked row, the best by the weights of all they share.

    Equal scores go to the older row, then the smaller key. Null shares nothing. Only the newest rows of each value can be
    among the newest of all, so no value's rows are paired beyond these.
    """
    late = [F.desc(when), F.desc(key)]
    own = asked.select(F.col(key).alias("asked"), *[F.col(c).alias(f"own_{c}") for c in weights])
    score = sum(F.when(F.col(f"own_{c}") == F.col(c), w).otherwise(0) for c, w in weights.items())
    found = None
    for c in weights:
        # what a pair needs goes with it: a join on prior afterwards would meet the few newest rows of all over and over
        kept = first_per_key(rows.where(F.col(c).isNotNull()), [c], late, newest + 1).select(F.col(key).alias("prior"), F.col(when).alias("when"), *weights)
        pairs = own.join(kept, F.col(f"own_{c}") == F.col(c)).where("asked <> prior").select("asked", "prior", "when", score.alias("score"))
        found = pairs if found is None else found.union(pairs)
    # a pair found by several columns has one rank, so the cut needs no distinct pairs and these are made of what it leaves
    rank = F.dense_rank().over(W.partitionBy("asked").orderBy(F.desc("when"), F.desc("prior")))
    both = found.withColumn("_rank", rank).where(F.col("_rank") <= newest).drop("_rank").dropDuplicates(["asked", "prior"])
    return first_per_key(both, ["asked"], [F.desc("score"), F.col("when"), F.col("prior")], limit).select("asked", "prior", "score")


def numbered(df: DataFrame, coarse: dict[str, bool], fine: list[Column], name: str = "place") -> DataFrame:
    """Adds the place of each row in the order of the coarse columns (descending where true, nulls last), then fine.

    Rows are counted by their coarse values, the counts are added up, and each value's rows are numbered by themselves: no task holds all rows.
    One task adds up a count for each distinct combination of coarse values, so these should be few beside the rows (dates, statuses).
    """
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in coarse.items()]
    sizes = df.groupBy(*coarse).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n"))
    before = before.select(*[F.col(c).alias(f"_{c}") for c in coarse], "_before")
    rows = df.withColumn("_at", F.row_number().over(W.partitionBy(*coarse).orderBy(*fine)))
    joined = rows.join(before, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in coarse])
    return joined.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_before", "_at", *[f"_{c}" for c in coarse])


def version_diff(old: DataFrame, new: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """key, change (added, removed, changed) and the watched fields that differ as text."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").cast("string").eqNullSafe(F.col(f"b.{c}").cast("string")), F.lit(c)) for c in watched]))
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(F.size(differs) > 0, "changed")
    out = joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"), F.when(change == "changed", F.array_join(differs, ",")).alias("fields"))
    return out.where("change IS NOT NULL")


def three_way(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """key and action of a merge: insert, update, provenance (protected rows), delete, or keep.

    stored has the booleans overridden and by_hand. An empty incoming table deletes nothing.
    """
    s, i = stored.alias("s"), incoming.select(key).alias("i")
    joined = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    empty = incoming.agg(F.count("*") == 0).scalar()
    action = (
        F.when(F.col(f"s.{key}").isNull(), "insert")
        .when(F.col(f"i.{key}").isNotNull(), F.when(F.col("s.overridden") | F.col("s.by_hand"), "provenance").otherwise("update"))
        .when(F.col("s.by_hand") | empty, "keep")
        .otherwise("delete")
    )
    return joined.select(F.coalesce(f"s.{key}", f"i.{key}").alias(key), action.alias("action"))


def filled(new: Column, old: Column) -> Column:
    """The new value unless it is null or empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def intervals(revisions: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Adds valid_to: the start of the next revision of the key, null for the one in force."""
    return revisions.withColumn("valid_to", F.lead(start).over(W.partitionBy(*keys).orderBy(start)))


def in_force(start: Column, end: Column, when: Column) -> Column:
    """Half-open."""
    return (start <= when) & (end.isNull() | (end > when))


def as_of_closed(start: Column, end: Column, when: Column) -> Column:
    """Closed at both ends; at a boundary the older revision wins when the oldest match is taken."""
    return (start <= when) & (end.isNull() | (when <= end))


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.nullif(whole, F.lit(0)), 0)


#: Characters of a mark or description that tell two rows apart.
MARK = 60


def marked_diff(old: DataFrame, new: DataFrame, scope: str, watched: list[str], order: str) -> DataFrame:
    """scope, mark, change (added, removed, changed), fields, before and after of two versions of rows (scope, mark, description, order, watched).

    Rows are told apart by their mark, or their description where that is empty, cut to MARK characters; of rows that agree in
    that the last by order counts. Watched fields are compared as text; before and after hold those that differ.
    """

    def last(rows: DataFrame, name: str) -> DataFrame:
        mark = F.left(F.coalesce(F.nullif(F.col("mark").cast("string"), F.lit("")), F.col("description").cast("string"), F.lit("")), F.lit(MARK))
        cells = F.struct(*[F.col(c).cast("string").alias(c) for c in watched])
        return rows.groupBy(F.col(scope), mark.alias("key")).agg(F.max_by(cells, order).alias(name))

    joined = last(old, "a").join(last(new, "b"), [scope, "key"], "full_outer")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in watched]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(fields) > 0, "changed")
    rows = joined.withColumn("change", change).withColumn("fields", F.when(change == "changed", fields)).where("change IS NOT NULL")

    def shown(side: str) -> Column:
        every = F.create_map(*[x for c in watched for x in (F.lit(c), F.col(f"{side}.{c}"))])
        return F.when(F.col("change") == "changed", F.map_filter(every, lambda k, _: F.array_contains("fields", k)))

    return rows.select(scope, F.col("key").alias("mark"), "change", "fields", shown("a").alias("before"), shown("b").alias("after"))


#: Characters of an excerpt that its provenance keeps.
EXCERPT = 240


def filled_scope(stored: DataFrame, found: DataFrame, key: str, fields: list[str], lists: list[str]) -> DataFrame:
    """stored with its empty fields filled from found, and filled (names) and sources (field to page, file and excerpt) of what was.

    A stored value wins; null and "" are empty, in found as well. The fields in lists are arrays, to which names are added that
    they do not have, in order, trimmed and without blanks. found (key unique) also has field_sources (map of structs page,
    file, excerpt), source_page and files (array), which stand in where a field names no page or file of its own.
    """
    some = found.select(key, F.struct(*[c for c in found.columns if c != key]).alias("f"))
    rows = stored.join(some, key, "left")
    none = F.array().cast("array<string>")

    def names(x: Column) -> Column:
        return F.filter(F.transform(F.coalesce(x, none), lambda v: F.trim(v)), lambda v: v != "")

    values, filled = {}, []
    for c in fields:
        own, new = F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"f.{c}"), F.lit(""))
        values[c] = F.coalesce(own, new, F.col(c))
        filled.append(F.when(own.isNull() & new.isNotNull(), c))
    for c in lists:
        merged = F.array_union(names(F.col(c)), names(F.col(f"f.{c}")))
        more = F.size(F.array_except(names(F.col(f"f.{c}")), names(F.col(c)))) > 0
        values[c] = F.when(more, merged).otherwise(F.col(c))
        filled.append(F.when(more, c))
    rows = rows.withColumn("filled", F.array_compact(F.array(*filled)))
    source = lambda c: F.try_element_at("f.field_sources", c)
    page, file = lambda c: F.coalesce(source(c)["page"], F.col("f.source_page")), lambda c: F.coalesce(source(c)["file"], F.get("f.files", F.lit(0)))
    entry = lambda c: F.struct(page(c).alias("page"), file(c).alias("file"), F.left(F.trim(source(c)["excerpt"]), F.lit(EXCERPT)).alias("excerpt"))
    sources = F.map_from_arrays(F.col("filled"), F.transform("filled", entry))
    return rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in stored.columns], "filled", sources.alias("sources"))
