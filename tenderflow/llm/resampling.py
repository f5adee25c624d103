"""Target-distribution importance resampling over hashed word n-grams, with an integer word dictionary.

Features are all runs of one to three words (ASCII lower case; digits, letters and everything beyond ASCII), hashed into
buckets. A bucket's gain is the log ratio of its smoothed share in the target texts and in the corpus; a document's weight
is the sum of its features' gains, and Gumbel noise made from its doc_id turns the highest scores into a draw in
proportion to the weights.

Workers map distinct words to ids and hold an n-gram as a tuple of ids. In each block of a partition the distinct tuples
are found, the bytes that a tuple stands for are hashed once (a trigram's hash goes on from that of its bigram), and
counts or gains are joined back to all places. Two passes read the texts: one counts, one weighs. Nothing but the
counters of the buckets, whose number is a parameter, comes to the driver. Highest scores are ranked in groups between
percentiles of the score, of which only those that reach into the draw are sorted.

Defined cases: a null text, or one without words, has no features, weight 0 and no chance to be drawn. A null doc_id
counts as an empty string for the noise and comes last among equal scores. Repeated rows are documents of their own; ties
go to the smaller doc_id, then to fewer features, then to the smaller weight. An empty corpus gives no rows, an empty target makes all gains follow
the corpus alone. Texts of any length are taken in pieces that share two words. Only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderflow.llm.storage import semi_join_ids, small_batches, written
from tenderflow.llm.words import alive, byte_texts

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 42, 5, 20
#: Words of a block, bytes of a piece of a long text, and distinct words after which a worker's dictionary starts anew.
BLOCK_WORDS, PIECE, CACHE_WORDS = 200_000, 1_000_000, 300_000
#: Rows that a group of the ranking has on average, and the most groups.
GROUP_ROWS, MOST_GROUPS = 50_000, 10_000
_MASK = np.int64((1 << 32) - 1)
#: Digits and letters stay, A-Z become a-z, all other ASCII becomes a space.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
SCHEMA = "doc_id long, n_words long, n_features long, weight long"


class Dictionary(dict):
    """Ids of words; `tails` are a space and the word, `hashes` those of the words alone."""

    def __init__(self):
        super().__init__()
        self.tails: list[bytes] = []
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self.tails)
        self.tails.append(b" " + word)
        self.hashes.append(crc32(word))
        return value

    def trimmed(self) -> "Dictionary":
        return Dictionary() if len(self) > CACHE_WORDS else self


def pieces(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes], int]]:
    """(row, words, how many of them the piece before had too) of texts, long ones in several pieces."""
    for row, text in enumerate(texts):
        folded, at, carried = (text or b"").translate(_FOLD), 0, []
        while at < len(folded):
            end = folded.find(b" ", at + PIECE)
            end = len(folded) if end < 0 else end
            words = carried + folded[at:end].split()
            if len(words) > len(carried):
                yield row, words, len(carried)
            at, carried = end, words[-2:]


def blocks(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(words, their rows, their pieces, whether they are not carried over) of about BLOCK_WORDS words at a time."""
    words: list[bytes] = []
    held: list[tuple[int, int, int]] = []

    def block() -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        row, size, carried = map(np.array, zip(*held, strict=True))
        starts = np.cumsum(size) - size
        return words, np.repeat(row, size), np.repeat(np.arange(len(size)), size), np.arange(len(words)) - np.repeat(starts, size) >= np.repeat(carried, size)

    for row, some, carried in pieces(texts):
        words += some
        held.append((row, len(some), carried))
        if len(words) >= BLOCK_WORDS:
            yield block()
            words, held = [], []
    if held:
        yield block()


def tuples(known: Dictionary, words: list[bytes], piece: np.ndarray, own: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n of 1 to 3: (bucket of each distinct tuple, which tuple stands at each place, the places' last words)."""
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    last = np.flatnonzero(own)
    distinct, which = np.unique(ids[last], return_inverse=True)
    yield np.array([known.hashes[i] for i in distinct.tolist()], np.int64) % buckets, which, last
    # all pairs in a piece, carried ones too: trigrams go on from them
    pair = np.flatnonzero(piece[1:] == piece[:-1]) + 1
    distinct, which = np.unique(ids[pair - 1] << 32 | ids[pair], return_inverse=True)
    first, tails, hashes = (distinct >> 32).tolist(), known.tails, known.hashes
    pair_hash = [crc32(tails[b], hashes[a]) for a, b in zip(first, (distinct & _MASK).tolist(), strict=True)]
    counted = own[pair]
    yield np.array(pair_hash, np.int64) % buckets, which[counted], pair[counted]
    pair_at = np.full(len(ids), -1)
    pair_at[pair] = which
    last = np.flatnonzero(own[2:] & (piece[2:] == piece[:-2])) + 2
    distinct, which = np.unique(pair_at[last - 1] << 32 | ids[last], return_inverse=True)
    hashed = [crc32(tails[c], pair_hash[p]) for p, c in zip((distinct >> 32).tolist(), (distinct & _MASK).tolist(), strict=True)]
    yield np.array(hashed, np.int64) % buckets, which, last


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the texts of docs fall into each bucket."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in byte_texts(batch, "text"):
                for words, _, piece, own in blocks(texts):
                    known = alive("resampling", Dictionary).trimmed()
                    for bucket, which, _ in tuples(known, words, piece, own, buckets):
                        total += np.bincount(bucket, np.bincount(which, minlength=len(bucket)), buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket in the target and in the source."""
    more, fewer = float(int(source.sum()) + len(source)), float(int(target.sum()) + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * more / ((s + 1) * fewer))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs."""
    small_batches(docs.sparkSession)
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_texts(batch, "text"):
                n_words, n_features, weight = np.zeros((3, len(texts)), np.int64)
                for words, row, piece, own in blocks(texts):
                    n_words += np.bincount(row[own], minlength=len(texts))
                    known = alive("resampling", Dictionary).trimmed()
                    for bucket, which, last in tuples(known, words, piece, own, buckets):
                        n_features += np.bincount(row[last], minlength=len(texts))
                        weight += np.bincount(row[last], gain[bucket][which], len(texts)).astype(np.int64)
                yield pa.record_batch([part.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """weighed with score: the weight and Gumbel noise, in thousandths, from the hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(share))))


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (written) with the rank of those drawn: the highest scores of percent of all rows with least_words words."""
    may = F.col("n_words") >= least_words
    n = rows.where(may).count()
    wanted = percent * n // 100
    parts = min(MOST_GROUPS, 1 + n // GROUP_ROWS)
    cuts = np.array([], np.int64)
    if parts > 1:
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        cuts = np.unique(rows.where(may).agg(F.percentile_approx("score", shares, F.lit(4 * parts + 10_000))).first()[0])

    @F.pandas_udf("int")
    def place(score: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, score.to_numpy()))

    dealt = rows.withColumn("place", F.when(may, place("score")))
    sizes = dict(dealt.where("place IS NOT NULL").groupBy("place").count().collect())
    starts, total = [], 0
    for p in range(len(cuts) + 1):
        if total >= wanted:
            break
        starts.append((p, total))
        total += sizes.get(p, 0)
    last = len(starts) - 1
    offsets = rows.sparkSession.createDataFrame(starts, "place int, start long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    top = dealt.where(F.col("place") <= last).join(F.broadcast(offsets), "place").withColumn("rank", F.col("start") + F.row_number().over(order))
    top = top.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = dealt.where(F.col("place").isNull() | (F.col("place") > last)).withColumn("rank", F.lit(None).cast("long"))
    return top.select(*rows.columns, "rank").unionByName(rest.select(*rows.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every row of docs."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    return ranked(written(scored(weights(docs, gain), seed), "scored"), percent, least_words)


def drawn(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id was drawn."""
    return semi_join_ids(docs, written(result.where("rank IS NOT NULL").select("doc_id").distinct(), "drawn"), "doc_id")
