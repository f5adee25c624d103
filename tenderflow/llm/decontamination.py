"""Benchmark decontamination with spaced seeds.

Each mask looks at six of eight to eleven neighbouring words and ignores the others, so a substituted word spoils
only the seeds that look at it. The seeds' hashes of the benchmark items meet those of every training position;
each hit, one for each exact run, is verified around its alignment: from the hit outwards, words that match gain 1 and words that don't
lose DROP_COST, and the stretch with the best sum is the overlap. It counts from MIN_OVERLAP words on (all words of
shorter items) with at least PERCENT per cent of them equal.

Seeds that follow each other on one diagonal are one hit, told by the hash of the seed before, so repeated words do not
multiply; hits are verified together, HITS at a time, in arrays.

The benchmark is dealt into blocks of about BLOCK_WORDS words, each broadcast by itself, and every block meets all
documents: one broadcast is bounded, but the driver reads the whole benchmark and each block adds a pass over the
documents. A benchmark is a collection of test items, small beside any corpus; for one of many millions of words this
operator is not meant.

Items with fewer words than the widest mask are looked for whole: their words must stand side by side in a text.

Defined cases: null and empty texts overlap with nothing; items without words or item_id are left out; repeated items
and repeated document rows each report; extra columns are ignored; of several overlaps of a
document with an item the longest counts, the first of equals. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.llm.storage import small_batches
from tenderflow.llm.words import DROP, DROP_COST, byte_texts, mix, spread, text_hashes, word_hashes  # noqa: F401

#: Positions each mask looks at.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 4, 7, 8), (0, 2, 3, 6, 8, 9), (0, 1, 5, 7, 9, 10))
MIN_OVERLAP, PERCENT = 12, 75
BLOCK_WORDS = 200_000
#: Hits that are verified together.
HITS = 200_000
SCHEMA = "doc_id long, item_id long, start_word int, n_words int, n_equal int, item_words int"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash under mask at every position where it fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[mask[0] : mask[0] + n] * _ODD[0]
    for k, at in enumerate(mask[1:], 1):
        total += words[at : at + n] * _ODD[k % len(_ODD)] * np.uint64(2 * (k // len(_ODD)) + 1)
    return mix(total + np.uint64(mask[-1]))


class Seeds:
    """The seeds of a block of items under one mask, sorted by hash and the hash of the seed before, behind a bit table."""

    def __init__(self, mask: tuple[int, ...], words: list[np.ndarray], bits: int):
        self.mask, self.shift = mask, np.uint64(64 - bits)
        found = [seeds(w, mask) for w in words]
        value = np.concatenate([*found, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        place = np.concatenate([*[np.arange(len(x)) for x in found], np.zeros(0, np.int64)])
        self.values, number = np.unique(value, return_inverse=True)
        # 0 stands for no seed before, so hashes are numbered from 1
        before = np.where(place > 0, np.append(0, number[:-1] + 1), 0) if len(value) else np.zeros(0, np.int64)
        order = np.lexsort((before, number))
        self.item, self.place, self.key = item[order], place[order], (number << 32 | before)[order]
        self.table = np.zeros(1 << bits, bool)
        self.table[value >> self.shift] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in item, place in text) of shared seeds, of seeds that follow each other in both only the first."""
        own = seeds(words, self.mask)
        near = np.flatnonzero(self.table[own >> self.shift])
        number = np.minimum(np.searchsorted(self.values, own[near]), max(0, len(self.values) - 1))
        known = self.values[number] == own[near]
        near, number = near[known], number[known]
        if not len(near):
            return (near,) * 3
        # what stands before: a seed of the items, some other seed, or (-1, which meets nothing) the start of the text
        before = np.full(len(own) + 1, -1)
        before[near + 1] = number + 1
        before = before[near]
        first, last = np.searchsorted(self.key, number << 32), np.searchsorted(self.key, (number + 1) << 32)
        same_first = np.where(before > 0, np.searchsorted(self.key, number << 32 | np.maximum(before, 0)), last)
        same_last = np.where(before > 0, np.searchsorted(self.key, number << 32 | np.maximum(before, 0), "right"), last)
        low, high = spread(first, same_first - first), spread(same_last, last - same_last)
        which, at = np.concatenate([low[0], high[0]]), np.concatenate([low[1], high[1]])
        return self.item[at], self.place[at], near[which]


class Items:
    """A block of benchmark items."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in rows]
        self.words = [text_hashes(text) for _, text in rows]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        #: Hashes of whole short items by their number of words, with the items of each.
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, words in enumerate(self.words):
            if 0 < len(words) <= MASKS[-1][-1]:
                self.short.setdefault(len(words), {}).setdefault(int(seeds(words, tuple(range(len(words))))[0]), []).append(i)
        bits = max(12, int(16 * len(MASKS) * len(self.flat)).bit_length())
        self.tables = [Seeds(mask, self.words, bits) for mask in MASKS]

    def _reach(self, words: np.ndarray, item: np.ndarray, at: np.ndarray, text_at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, equal words) of the stretch with the best sum from each hit on in one direction, as `stretch` goes."""
        total, peak, equal, length, kept = np.zeros((5, len(item)), np.int64)
        left = np.minimum(self.size[item] - at, len(words) - text_at) if step > 0 else np.minimum(at, text_at) + 1
        offset, alive, t = self.start[item] + at, np.flatnonzero(left > 0), 0
        while len(alive):
            same = self.flat[offset[alive] + step * t] == words[text_at[alive] + step * t]
            total[alive] += np.where(same, 1, -DROP_COST)
            equal[alive] += same
            better = alive[total[alive] > peak[alive]]
            peak[better], length[better], kept[better] = total[better], t + 1, equal[better]
            t += 1
            alive = alive[(peak[alive] - total[alive] <= DROP) & (left[alive] > t)]
        return length, kept

    def overlaps(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item_id, start word, words, equal words, item's words) of the verified overlaps, the longest of each item, the first of equals."""
        best: dict[int, tuple[int, int, int]] = {}
        for n, known in self.short.items():
            own = seeds(words, tuple(range(n)))
            at = np.flatnonzero(np.isin(own, np.fromiter(known, np.uint64, len(known))))
            for value, first in zip(*np.unique(own[at], return_index=True), strict=True):
                best.update((i, (n, int(at[first]), n)) for i in known[int(value)])
        found = [t.hits(words) for t in self.tables]
        item, place, text_at = (np.concatenate(x) for x in zip(*found, strict=True))
        # in the order of items, diagonals and places, each once
        wide, deep = len(words) + len(self.flat) + 1, len(self.flat) + 1
        item, rest = np.divmod(np.unique((item * wide + (text_at - place + len(self.flat))) * deep + place), wide * deep)
        diagonal, place = np.divmod(rest, deep)
        text_at = diagonal - len(self.flat) + place
        # the first hits of each item, then ever more: an item that is found whole needs no others
        turn = np.arange(len(item)) - np.searchsorted(item, item)
        low, high, open_items = 0, 64, np.ones(len(self.ids), bool)
        while low < turn.max(initial=-1) + 1:
            open_items[[i for i, (n, *_) in best.items() if n == self.size[i]]] = False
            now = np.flatnonzero((turn >= low) & (turn < high) & open_items[item])
            for k in range(0, len(now), HITS):
                part = now[k : k + HITS]
                self._verify(words, item[part], place[part], text_at[part], best)
            low, high = high, 8 * high
        return [(self.ids[i], start, n, equal, int(self.size[i])) for i, (n, start, equal) in best.items()]

    def _verify(self, words: np.ndarray, item: np.ndarray, place: np.ndarray, text_at: np.ndarray, best: dict[int, tuple[int, int, int]]) -> None:
        """Puts the longest overlap of each item into best; hits are in the order of diagonals."""
        ahead, ahead_equal = self._reach(words, item, place, text_at, 1)
        back, back_equal = self._reach(words, item, place - 1, text_at - 1, -1)
        n, equal = ahead + back, ahead_equal + back_equal
        good = np.flatnonzero((n >= np.minimum(MIN_OVERLAP, self.size[item])) & (100 * equal >= PERCENT * n))
        order = good[np.lexsort((text_at[good] - place[good], -n[good], item[good]))]
        for k in order[np.flatnonzero(np.append(True, item[order][1:] != item[order][:-1]))].tolist() if len(order) else []:
            i, found = int(item[k]), (int(n[k]), int(text_at[k] - back[k]), int(equal[k]))
            if i not in best or found[0] > best[i][0]:
                best[i] = found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text) and item (item_id, text) that overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    size = F.size(F.split("text", r"[ \t-\r]+"))
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_WORDS))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    found = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"].encode()) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value)
            for batch in batches:
                for part, texts in byte_texts(batch, "text"):
                    out = []
                    for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                        out += [(doc_id, *x) for x in items.overlaps(text_hashes(text))]
                    if out:
                        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                        yield pa.record_batch(columns, ["doc_id", "item_id", "start_word", "n_words", "n_equal", "item_words"])

        found.append(texts.mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionAll, found)
