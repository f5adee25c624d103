"""Quality scores by Bradley-Terry pairwise ranking: from preference pairs (a labelled-good text over a labelled-bad
one) a linear worth is learned by logistic loss on the differences of the two texts' features; the threshold is the
worth's quantile at the share of bad labels, and the score is the chance that a text beats one at the threshold.

Features come from the text alone. Every labelled document teaches, and every pair of a good and a bad one counts: the
loss is the mean over all pairs, with DECAY. It needs no pair by pair work, since what a text adds depends on its worth and
on how the worths of the other side lie, which are counted at BINS + 1 nodes (one between two counts for both in parts). Newton's method finds the least loss; each step
is two passes over the features, kept in blocks of about BLOCK documents, and the driver gets sums of a fixed size from each block. The
quantile is exact. Every text is scored whole.

Defined cases: null and empty texts have all-zero features and get a score like any other; labels without a text and null
labels teach nothing. Of labels that share a doc_id the lowest counts, of rows that share one the smallest text teaches,
and each row gets its own score. Without both labels every score is 0.5. An empty table gives no rows. Only doc_id, text
and quality are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.llm.storage import one_row_each, semi_join_ids, small_batches, written
from tenderflow.llm.words import byte_texts

#: Weight of the squared weights in the loss; the fit ends where a step lowers the loss by less than ENOUGH.
DECAY, ENOUGH = 1e-4, 1e-8
#: Bins between nodes, and those joined for what two sides add to the curvature together; documents of a block; bits of a worth told by a pass.
BINS, JOINED, BLOCK, BITS = 4_096, 32, 32_768, 12
SCHEMA = "doc_id long, score double, predicted int, worth double"
_KIND = np.zeros(256, np.uint8)  # 0 others, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 symbol
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9]], _KIND[[10, 13]] = 1, 2, 3, 4, 5
for _c in b".,;:'?-\"()":
    _KIND[_c] = 6
for _c in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _KIND[_c] = 7
N_FEATURES = 30


def features(text: bytes | None) -> np.ndarray:
    """Shares of character kinds and pairs of kinds, and shapes of words and lines; zeros for an empty text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    kinds = _KIND[raw := np.frombuffer(text, np.uint8)]
    n = len(kinds)
    out[:8] = np.bincount(kinds, minlength=8) / n
    if n > 1:
        after = kinds[1:]
        same = raw[1:] == raw[:-1]
        marks = kinds[:-1] >= 6
        out[8] = (same & marks).sum() / n
        out[9] = ((kinds[:-1] == 2) & (after == 2)).sum() / n
        out[10] = (marks & (after >= 6)).sum() / n
        out[11] = (same & (kinds[:-1] < 4)).sum() / n
        out[12] = ((kinds[:-1] == 7) & (after == 4)).sum() / n
        out[13] = ((kinds[:-1] == 1) & (after == 2)).sum() / n
        out[14] = ((kinds[:-1] == 3) & (after == 3)).sum() / n
    words = text.split()
    if words:
        m = len(words)
        counts = Counter(words)
        sizes = np.fromiter(map(len, words), np.int64, m)
        out[15] = np.log1p(m)
        out[16] = len(counts) / m
        out[17] = max(counts.values()) / m
        out[18] = sizes.mean()
        out[19] = sizes.std()
        out[20] = (sizes > 20).mean()
        out[21] = (sizes == 1).mean()
        out[22] = m < 20
        out[23] = np.log1p(m) ** 2 / 10
    lines = [x for x in text.split(b"\n") if x.strip()]
    if lines:
        out[24] = len(set(lines)) / len(lines)
        out[25] = max(Counter(lines).values()) / len(lines)
        out[26] = np.log1p(n / len(lines))
        out[27] = np.mean([x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines])
        out[28] = np.log1p(max(map(len, lines)))
        out[29] = np.log1p(len(lines))
    return out


Step = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Worth:
    """Linear worth with the threshold below which a text is called bad."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        self.learn(lambda step: step(x, good))

    @classmethod
    def over(cls, total: Callable[[Step], np.ndarray | float]) -> "Worth":
        """total gives the sum of a step over all blocks (features, good), 0.0 without any."""
        found = cls.__new__(cls)
        found.learn(total)
        return found

    def learn(self, total: Callable[[Step], np.ndarray | float]) -> None:
        self.mean, self.sd, self.weights = np.zeros(2 * N_FEATURES), np.ones(2 * N_FEATURES), np.zeros(2 * N_FEATURES)
        self.cut, self.width = 0.0, 1.0
        sums = total(lambda x, good: np.append([len(good), good.sum()], self.spread(x).sum(0)))
        n, n_good = (int(k) for k in sums[:2]) if np.ndim(sums) else (0, 0)
        if n_good in (0, n):
            return
        mean = sums[2:] / n
        sd = np.sqrt(total(lambda x, good: ((self.spread(x) - mean) ** 2).sum(0)) / n) + 1e-6
        self.mean, self.sd = mean, sd
        self.weights = self.best(total, n_good * (n - n_good))
        one, two = total(lambda x, good: np.array([(worth := self.of(x)).sum(), (worth**2).sum()]))
        self.width = float(np.sqrt(max(0.0, two / n - (one / n) ** 2)) + 1e-9) / 3
        self.cut = self.quantile(total, n, 1 - n_good / n)

    def best(self, total: Callable[[Step], np.ndarray], pairs: int) -> np.ndarray:
        """The weights of the least loss over all pairs, by Newton's method with steps halved until the loss falls."""
        weights, size = np.zeros(2 * N_FEATURES), 2 * N_FEATURES
        counts, low, wide = self.binned(total, weights)
        loss = self.loss(counts, wide, weights, pairs)
        while True:
            miss = 1 / (1 + np.exp(np.clip(-np.arange(-BINS, BINS + 1) * wide, -500, 500)))
            # at the nodes: by how much the pairs with all of the other side miss, and how that bends
            tables = [np.correlate(t, counts[k], "valid")[::-1] for k, t in ((0, miss), (1, 1 - miss), (0, miss * (1 - miss)), (1, miss * (1 - miss)))]
            nodes = low + wide * np.arange(BINS + 1)

            def moments(x: np.ndarray, good: np.ndarray, weights=weights, tables=tables, nodes=nodes, low=low, wide=wide) -> np.ndarray:
                z = self.standard(x)
                worth = z @ weights
                slope = np.where(good, -np.interp(worth, nodes, tables[0]), np.interp(worth, nodes, tables[1]))
                bend = np.where(good, np.interp(worth, nodes, tables[2]), np.interp(worth, nodes, tables[3]))
                both = np.zeros((2, BINS // JOINED, size))
                np.add.at(both, (good.astype(int), _bins(worth, low, wide)[0] // JOINED), z)
                return np.concatenate([slope @ z, ((z * bend[:, None]).T @ z).ravel(), both.ravel()])

            sums = total(moments) / pairs
            bad_z, good_z = sums[size + size**2 :].reshape(2, -1, size)
            far = np.subtract.outer(d := np.arange(BINS // JOINED), d) * wide * JOINED
            cross = good_z.T @ (1 / (2 + 2 * np.cosh(np.clip(far, -500, 500)))) @ bad_z * pairs
            bend = sums[size : size + size**2].reshape(size, size) - cross - cross.T
            values, axes = np.linalg.eigh((bend + bend.T) / 2)
            slope = sums[:size] + DECAY * weights
            step, now = axes @ ((axes.T @ slope) / (np.maximum(values, 0) + DECAY)), np.inf
            while now >= loss:
                if step @ slope < ENOUGH:
                    return weights
                tried, step = weights - step, step / 2
                counts, low, wide = self.binned(total, tried)
                now = self.loss(counts, wide, tried, pairs)
            weights, loss = tried, now

    def binned(self, total: Callable[[Step], np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, float, float]:
        """How many bad and good texts have their worth at each node, where the nodes begin and how far apart they are: they hold every possible worth."""
        reach = max(6 * float(np.abs(weights).sum()), 1e-6)
        low, wide = -reach, 2 * reach / BINS

        def step(x: np.ndarray, good: np.ndarray) -> np.ndarray:
            at, part = _bins(self.standard(x) @ weights, low, wide)
            sides = [np.bincount(at[k], 1 - part[k], BINS + 1) + np.bincount(at[k] + 1, part[k], BINS + 1) for k in (~good, good)]
            return np.concatenate(sides)

        return total(step).reshape(2, BINS + 1), low, wide

    def loss(self, counts: np.ndarray, wide: float, weights: np.ndarray, pairs: int) -> float:
        over = np.correlate(np.logaddexp(0, np.arange(-BINS, BINS + 1) * wide), counts[0], "valid")[::-1]
        return float(over @ counts[1]) / pairs + DECAY / 2 * float(weights @ weights)

    def quantile(self, total: Callable[[Step], np.ndarray], n: int, share: float) -> float:
        """np.quantile of all worths: the two values beside it are told BITS bits at a time by counting."""
        place = (n - 1) * share
        ranks = np.minimum([np.floor(place), np.floor(place) + 1], n - 1)
        found, known = np.zeros(2, np.uint64), 0
        while known < 64:
            bits = min(BITS, 64 - known)

            def step(x: np.ndarray, good: np.ndarray, found=found, known=known, bits=bits) -> np.ndarray:
                own, out = _ordered(self.of(x)), []
                for k in found:
                    same = own >> np.uint64(64 - known) == k if known else np.ones(len(own), bool)
                    out.append(np.bincount((own[same] >> np.uint64(64 - known - bits) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits))
                return np.concatenate(out).astype(float)

            upto = np.cumsum(total(step).reshape(2, -1), axis=1)
            digit = [int(np.searchsorted(u, r, "right")) for u, r in zip(upto, ranks, strict=True)]
            ranks = ranks - [u[k - 1] if k else 0 for u, k in zip(upto, digit, strict=True)]
            found, known = (found << np.uint64(bits)) | np.array(digit, np.uint64), known + bits
        return float(np.quantile(_ordered_back(found), place - np.floor(place)))

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Features and their squares."""
        return np.hstack([x, x * np.abs(x)])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self.spread(x) - self.mean) / self.sd, -6, 6)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, worth: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((worth - self.cut) / self.width, -30, 30)))


def _bins(worth: np.ndarray, low: float, wide: float) -> tuple[np.ndarray, np.ndarray]:
    """The node before each worth, and the part of the way to the next."""
    place = np.clip((worth - low) / wide, 0, BINS)
    at = np.minimum(place.astype(np.int64), BINS - 1)
    return at, place - at


_SIGN = np.uint64(1 << 63)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the values."""
    raw = (values + 0.0).view(np.uint64)
    return np.where(raw & _SIGN, ~raw, raw | _SIGN)


def _ordered_back(ordered: np.ndarray) -> np.ndarray:
    return np.where(ordered & _SIGN, ordered ^ _SIGN, ~ordered).view(np.float64)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in byte_texts(batch, "text"):
            rows = pa.array([features(t) for t in texts], pa.list_(pa.float64()))
            yield pa.record_batch([part.column(0), rows], ["doc_id", "features"])


def blocks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """block, quality, features: of every labelled document once, in the order of doc_id within a block, so that sums don't depend on how the input is split."""
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    labels = written(labels, "labels")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = one_row_each(semi_join_ids(docs, labels.select("doc_id"), "doc_id"))
    rows = docs.mapInArrow(_features_of, "doc_id long, features array<double>").join(labels, "doc_id")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(labels.count() // BLOCK + 1)).alias("block")
    rows = rows.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("doc_id", "quality", "features"))).alias("rows"))
    return written(rows.select("block", F.col("rows.quality").alias("quality"), F.flatten("rows.features").alias("features")), "features")


def fit(docs: DataFrame, labels: DataFrame) -> Worth:
    """From docs (doc_id, text) and labels (doc_id, quality): the rows to learn from."""
    small_batches(docs.sparkSession)
    rows = blocks(docs, labels)

    def total(step: Step) -> np.ndarray | float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, quality, x in zip(*batch.columns, strict=True):
                    sums = step(x.values.to_numpy().reshape(-1, N_FEATURES), quality.values.to_numpy() == 1)
                    yield pa.record_batch([pa.array([block.as_py()]), pa.array([sums], pa.list_(pa.float64()))], ["block", "sums"])

        parts = rows.mapInArrow(run, "block long, sums array<double>").toArrow().sort_by("block")
        return sum((s.values.to_numpy() for s in parts["sums"]), 0.0)

    return Worth.over(total)


def score(docs: DataFrame, worth: Worth) -> DataFrame:
    """doc_id, score, predicted and worth of every text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(worth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = shared.value
        for batch in batches:
            for part, texts in byte_texts(batch, "text"):
                value = worth.of(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES))
                chance = worth.score(value)
                yield pa.record_batch([part.column(0), pa.array(chance), pa.array((chance >= 0.5).astype(np.int32)), pa.array(value)], ["doc_id", "score", "predicted", "worth"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def taught(labels: DataFrame) -> DataFrame:
    """Labels that may teach: crc32 of the doc_id as text is not 1 modulo 3."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
