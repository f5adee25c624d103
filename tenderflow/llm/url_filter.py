"""URL filter: rules first, else a character language-model ratio. DataFrame functions only.

URLs that a rule decides teach two smoothed variable-order Markov models over folded characters of the whole URL
(after the "://" where there is one, query and fragment included), one for accepted and one for rejected URLs. A URL's
value is the sum of log(P_accepted / P_rejected) over its characters, each taken at the longest context in which the
character was seen, divided by the number of characters. The threshold is calibrated on decided URLs that taught
nothing, one in HELD_OUT by their hash: the point as many standard deviations from the one class's mean as from the
other's. Where these lack a class, the taught URLs take their place.

The model's size has a proven bound: characters fold to 29 (a-z, one for digits, ./-, others) plus start and end
marks, and contexts hold at most three, so there are under 33**4 entries whatever the input.

Defined cases: null URLs and those without "://" have empty host and path and fit no rule; null ones are judged by the
end mark alone, others by all their characters. Extra columns are ignored. Without taught URLs of both classes every undecided URL is allowed. Repeated rows keep their own
result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenderflow.llm.storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 3
SYMBOLS = 32
HELD_OUT = 5
START, END = "^", "$"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and ruled (its verdict), the longest rule that fits host and path, null where none does."""
    host, path = F.col("host"), F.col("path")
    rule = ruled = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith(f".{text[:at]}")) & path.startswith(text[at:])
        rule, ruled = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return df.withColumn("rule", rule).withColumn("ruled", ruled)


def folded(url: Column) -> Column:
    text = F.translate(F.coalesce(F.regexp_replace(url, r"(?s)^.*?://", ""), F.lit("")), UPPER, LOWER)
    text = F.regexp_replace(text, "[0-9]+", "0")
    return F.regexp_replace(text, r"[^a-z0./-]", "*")


def grams(strings: DataFrame) -> DataFrame:
    """One row for each character and the end mark of s, with the three characters before it: g has four letters."""
    padded = F.concat(F.lit(START * ORDER), "s", F.lit(END))
    at = F.explode(F.sequence(F.lit(1), F.length("s") + 1))
    return strings.withColumn("padded", padded).select("*", at.alias("at")).withColumn("g", F.expr(f"substr(padded, at, {ORDER + 1})")).drop("padded", "at")


def train(urls: DataFrame) -> list[DataFrame]:
    """From (s, ruled): for each order 0..3 a table (k, ratio) of contexts with a character."""
    allow, block = F.count_if(F.col("ruled") == "allow"), F.count_if(F.col("ruled") == "block")
    counts = written(grams(urls).groupBy("g").agg(allow.alias("a"), block.alias("b")), "url-grams")
    tables: list[DataFrame] = []
    below = None
    for order in range(ORDER + 1):
        key = F.expr(f"right(g, {order + 1})")
        level = counts.groupBy(key.alias("k")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        level = level.withColumn("context", F.expr(f"left(k, {order})"))
        over = W.partitionBy("context")
        for x in "ab":
            level = level.withColumn(f"n{x}", F.sum(x).over(over)).withColumn(f"t{x}", F.count_if(F.col(x) > 0).over(over))
        if below is None:
            for x in "ab":
                level = level.withColumn(f"p{x}", (F.col(x) + 1) / (F.col(f"n{x}") + SYMBOLS))
        else:
            level = level.withColumn("lower", F.expr(f"right(k, {order})")).join(F.broadcast(below), "lower")
            for x in "ab":
                smoothed = (F.col(x) + F.col(f"t{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))
                level = level.withColumn(f"p{x}", F.when(F.col(f"n{x}") == 0, F.col(f"q{x}")).otherwise(smoothed))
        below = level.select(F.col("k").alias("lower"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        tables.append(level.select("k", F.log(F.col("pa") / F.col("pb")).alias("ratio")))
    return tables


def value(strings: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(s, value): length-normalised log ratio of each distinct s."""
    rows = grams(strings.select("s"))
    for order, table in enumerate(tables):
        known = table.select(F.col("k").alias(f"k{order}"), F.col("ratio").alias(f"r{order}"))
        rows = rows.join(F.broadcast(known), F.expr(f"right(g, {order + 1})") == F.col(f"k{order}"), "left")
    best = F.coalesce(*[F.col(f"r{k}") for k in range(ORDER, -1, -1)], F.lit(0.0))
    return rows.groupBy("s").agg(F.avg(best).alias("value"))


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, value and threshold for every row of pages (page_id, url)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), folded(F.col("url")).alias("s"))
    rows = with_rule(rows, rules)
    strings = written(rows.groupBy("s").agg(F.max("ruled").alias("ruled")), "url-strings")
    decided = strings.where("ruled IS NOT NULL").withColumn("held", F.pmod(F.xxhash64("s"), F.lit(HELD_OUT)) == 0)
    values = written(value(strings, train(decided.where("NOT held"))), "url-values")
    stats = decided.join(values, "s").groupBy("ruled", "held").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).collect()
    held, taught = ({r["ruled"]: r for r in stats if r["held"] == k} for k in (True, False))
    found = held if {"allow", "block"} <= held.keys() else taught
    if {"allow", "block"} <= found.keys() and taught.keys() == {"allow", "block"}:
        a, b = found["allow"], found["block"]
        spread = a["sd"] + b["sd"]
        cut = F.lit((a["mean"] * b["sd"] + b["mean"] * a["sd"]) / spread if spread else (a["mean"] + b["mean"]) / 2)
    else:
        cut = F.lit(None).cast("double")
    out = rows.join(values, "s").withColumn("threshold", cut)
    verdict = F.coalesce("ruled", F.when(F.col("value") < F.col("threshold"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "value", "threshold")
