"""Spelling variants grouped by two-dimensional range reporting.

Words are the points of a plane: their rank in forward order by their rank in reverse order. At an edit position the words
that share the prefix before it are an interval of the one order, those that share the suffix behind it an interval of
the other, and a wavelet tree reports the points in both. Words of one length ask for each other (a replaced code point),
words that are shorter by one ask for them too (an inserted one, or seen from the longer word a deleted one).

One edit leaves all outside a range of positions as it is, so words meet in groups: the longer word's length, a range of
positions, and what lies before and behind the range. The ranges are halves at first; a group with more than CROWD code
points is dealt into the two halves of its range, at last into single positions, where a group has no more words than
there are letters. Each pair is reported at one position of one group only.

Defined cases: a null or empty text has no words. A null doc_id counts as an empty string for the hash. Repeated rows count
each time. Among near words of equal number the first in code-point order is the form. An empty table gives no words. Only
doc_id and text are read, so other columns may have any name. Runs of letters of any length are words as any others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.llm.storage import BROADCAST_IDS, small_batches, written
from tenderflow.llm.words import release

LEAST_LENGTH, LEAST_N, FORM_RATIO, DELETE_EVERY = 6, 5, 5, 199
#: Distinct words after which a counting worker hands on what it has.
FLUSH = 150_000
#: Code points of a block of groups on average, and of one group before its range is halved.
BLOCK, CROWD = 400_000, 1_000_000
#: In Latin-1: A-Z become a-z, other letters of the pattern stay, all else becomes a space.
_FOLD = bytes(b if b >= 0xC0 or 97 <= b <= 122 else 32 for b in bytes(range(256)).lower())
NEAR_SCHEMA = "word string, n_near long, best_n long, best string"


def document_words(doc_id: int | None, text: str | None) -> Iterator[tuple[bytes, int]]:
    """(word in Latin-1, occurrences) of a text, one code point deleted where the hash says so."""
    runs = Counter([w for w in (text or "").encode("latin-1", "replace").translate(_FOLD).split() if len(w) >= LEAST_LENGTH])
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in runs.items():
        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % DELETE_EVERY == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
            if len(word) < LEAST_LENGTH:
                continue
        yield word, n


def word_counts(docs: DataFrame, least_n: int = LEAST_N) -> DataFrame:
    """(word, n) of all words that occur least_n times in the texts of docs."""
    small_batches(docs.sparkSession)

    def rows(kept: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode("latin-1") for w in kept], pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kept: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for word, n in document_words(doc_id, text):
                        kept[word] += n
                if len(kept) > FLUSH:
                    yield rows(kept)
                    kept = Counter()
        yield rows(kept)

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class Order:
    """Texts in code-point order, and how many leading code points neighbours share."""

    def __init__(self, texts: np.ndarray, point: np.ndarray):
        self.at = np.argsort(texts, kind="stable")
        self.place = np.empty(len(texts), np.int64)
        self.place[self.at] = np.arange(len(texts))
        same = np.diff(texts[self.at].view(np.uint32).reshape(len(texts), -1), axis=0) == 0
        self.shared = np.concatenate([[-1], np.where(same.all(1), same.shape[1], same.argmin(1))])
        self.points = np.concatenate([[0], np.cumsum(point[self.at])])

    def interval(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text, from where to where among the points in order stand those with the same first k code points."""
        starts = self.shared < k
        first = np.flatnonzero(starts)
        group = (np.cumsum(starts) - 1)[self.place]
        return self.points[first][group], self.points[np.append(first[1:], len(starts))][group]


class Wavelet:
    """A wavelet tree over a permutation, kept level by level."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for b in reversed(range(max(1, (len(values) - 1).bit_length()))):
            bit = (values >> b) & 1
            self.levels.append((b, np.concatenate([[0], np.cumsum(bit)]), len(values) - int(bit.sum())))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which query, value) of all values from low to high at the places from left to right."""
        query, node = np.arange(len(left)), np.zeros(len(left), np.int64)
        for b, ones, zeros in self.levels:
            half, l1, r1, lo, hi = node + (1 << b), ones[left], ones[right], low[query], high[query]
            down = (left - l1 < right - r1) & (lo < half) & (hi > node)
            up = (l1 < r1) & (hi > half) & (lo < half + (1 << b))
            left, right = np.concatenate([(left - l1)[down], l1[up] + zeros]), np.concatenate([(right - r1)[down], r1[up] + zeros])
            query, node = np.concatenate([query[down], query[up]]), np.concatenate([node[down], half[up]])
        return query, node


def near_pairs(words: list[str], longer: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, Order]:
    """Pairs (a, b) of places in words whose edit lies at a position from start to stop of the longer word, each in both directions.

    words are distinct and have the length longer, or one less; two of them that are both shorter are no pair here.
    """
    texts = np.array(words, f"U{longer}")
    point = np.fromiter(map(len, words), np.int64, len(words)) == longer
    forward, backward = Order(texts, point), Order(np.array([w[::-1] for w in words], f"U{longer}"), point)
    in_reverse = backward.at[point[backward.at]]
    if not len(in_reverse):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), forward
    rank = np.zeros(len(words), np.int64)
    rank[in_reverse] = np.arange(len(in_reverse))
    tree = Wavelet(rank[forward.at[point[forward.at]]])
    letters, found = texts.view(np.uint32).reshape(len(words), -1), [(np.zeros(0, np.int64),) * 2]
    for i in range(start, stop):
        left, right = forward.interval(i)
        low, high = backward.interval(longer - 1 - i)
        ask = np.flatnonzero((right - left > point) & (high - low > point))
        if not len(ask):
            continue
        query, value = tree.report(left[ask], right[ask], low[ask], high[ask])
        a, b = ask[query], in_reverse[value]
        a, b = a[a != b], b[a != b]
        # a code point put beside an equal one could stand at either place: the first is taken
        if i:
            first = point[a] | (letters[b, i - 1] != letters[b, i])
            a, b = a[first], b[first]
        found += [(a, b), (b[~point[a]], a[~point[a]])]
    a, b = map(np.concatenate, zip(*found, strict=True))
    return a, b, forward


def _near_of_block(key: tuple, table: pa.Table) -> pa.Table:
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    a, b, forward = near_pairs(words, key[0].as_py(), key[1].as_py(), key[2].as_py())
    order = np.lexsort((forward.place[b], -n[b], a))
    a, b = a[order], b[order]
    which, first, size = np.unique(a, return_index=True, return_counts=True)
    best = b[first]
    taken = table.column("word").combine_chunks()
    return pa.table({"word": taken.take(pa.array(which)), "n_near": pa.array(size.astype(np.int64)), "best_n": pa.array(n[best]), "best": taken.take(pa.array(best))})


def _halves(longer: str, start: str, stop: str) -> list[str]:
    """The two halves of a range of positions; of a single position only itself."""
    middle = f"({start} + ({stop} - {start}) DIV 2)"
    return [f"IF({stop} - {start} > 1, struct({longer} AS longer, {start} AS start, {middle} AS stop), NULL)", f"struct({longer} AS longer, IF({stop} - {start} > 1, {middle}, {start}) AS start, {stop} AS stop)"]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n; distinct, written) that have near ones: how many, and the commonest."""
    key = F.concat(F.expr("left(word, start)"), F.lit("\x00"), F.expr("right(word, longer - stop)"))

    def dealt(rows: DataFrame, ranges: list[str]) -> DataFrame:
        new = rows.select("word", "n", F.explode(F.array_compact(F.expr(f"array({', '.join(ranges)})"))).alias("r"))
        return new.select("word", "n", "r.*").withColumn("kept", key)

    size = "length(word)"
    rows = dealt(words, _halves(size, "0", size) + _halves(f"({size} + 1)", "0", f"({size} + 1)"))
    group = ["longer", "start", "stop", "kept"]
    while True:
        crowds = rows.groupBy(*group).count().where(f"count * longer > {CROWD} AND stop - start > 1").drop("count")
        crowds = written(crowds, "crowds")
        many = crowds.count()
        if not many:
            break
        if many <= BROADCAST_IDS:
            crowds = F.broadcast(crowds)
        rows = rows.join(crowds, group, "left_anti").unionByName(dealt(rows.join(crowds, group, "left_semi"), _halves("longer", "start", "stop")))
        rows = written(rows, "ranges")
    blocks = F.expr(f"pmod(xxhash64(kept), 1 + {words.count()} * longer DIV {BLOCK})")
    near = rows.withColumn("block", blocks).groupBy("longer", "start", "stop", "block").applyInArrow(_near_of_block, NEAR_SCHEMA)
    best = F.min(F.struct((-F.col("best_n")).alias("order"), "best"))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return near.select("word", "n_near", (-F.col("b.order")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms (word, form; written) ends. Each round follows what the one before found."""
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(found.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = step.select("word", "root")
        if step.where("moved").isEmpty():
            return found


def variants(docs: DataFrame, least_n: int = LEAST_N, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs."""
    words = written(word_counts(docs, least_n), "words")
    form = F.expr(f"IF(best_n >= {ratio} * n, best, NULL)")
    rows = written(words.join(near_words(words), "word", "left").withColumn("form", form), "near")
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    form_n = F.expr("IF(form IS NOT NULL, best_n, NULL)").alias("form_n")
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form_n)
