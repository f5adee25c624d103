"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The model gives P(token | token before). The VOCAB most frequent tokens (the end among them) and CLASSES classes of all
others, by their last two bytes, have a context vector, a word vector and a bias; the score of a pair is
context . word + bias, trained in numpy against noise drawn from the unigram distribution. A token outside the
vocabulary has its class's probability times its smoothed share of the class, so that the probabilities of all known
tokens and one unknown token of each class sum to 1. Log-sums over the vocabulary come from batched matrix products.

Training reads every token of the training texts: in each round every task runs over its own texts from the shared
parameters, and Spark averages the tasks' vectors, weighted by the pairs each has seen. The driver holds only the
parameters, VOCAB x 2 x SIZE numbers. Counts of all tokens stay a distributed table; tokens outside the TABLE most
frequent ones (a broadcast of bounded size) are joined with it, so base scores are exact.

Defined cases: a null text counts as empty: one end token; an unseen token counts c = 0; without training texts N
and V are 0 and the model is uniform over the end and the classes. Repeated rows each get their row; a null doc_id is not held out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.llm.storage import small_batches, written
from tenderflow.llm.words import CACHE_WORDS, byte_texts, release, split_words

VOCAB, CLASSES, TABLE, SIZE, ROUNDS = 4_096, 64, 100_000, 16, 2
NOISE, BATCH, CHUNK_BYTES, RATE, SEED = 128, 4_096, 2_400_000, 0.1, 7
#: The end token: no word holds a space.
END = b" "
COUNT_FLUSH = 250_000


def class_of(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % CLASSES


class TokenRows(dict):
    """Row of each token of a table; others get -1 less their class, kept for those seen last."""

    def __init__(self, table: dict[bytes, int]):
        super().__init__(table)
        self.table = table

    def __missing__(self, token: bytes) -> int:
        if len(self) >= len(self.table) + CACHE_WORDS:
            self.clear()
            self.update(self.table)
        value = self[token] = -1 - class_of(token)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    kept: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["token", "n"])
        kept.clear()
        return out

    for batch in batches:
        for _, texts in byte_texts(batch, "text", 128):
            for text in texts:
                kept.update(split_words(text))
            kept[END] += len(texts)
            if len(kept) > COUNT_FLUSH:
                yield flush()
    if kept:
        yield flush()


class Parameters:
    """Vocabulary, known counts and vectors: what scoring needs, of bounded size."""

    def __init__(self, frequent: dict[bytes, int], classes: dict[int, tuple[int, int]], total: int, kinds: int):
        """frequent: the most frequent tokens with their counts, in order, and the end; classes: tokens and distinct
        tokens of each class; total and kinds: over all training tokens."""
        self.total, self.kinds, self.counts = total, kinds, frequent
        self.ids = {END: 0} | {w: i for i, w in enumerate([w for w in frequent if w != END][: VOCAB - 1], 1)}
        self.first_class = len(self.ids)
        known = np.zeros(self.first_class + CLASSES)
        within = np.zeros((CLASSES, 2))
        for k, both in classes.items():
            within[k] = both
        for w, i in self.ids.items():
            known[i] = frequent[w]
            if w != END:
                within[class_of(w)] -= (frequent[w], 1)
        known[self.first_class :] = within[:, 0]
        #: log10 of what a class's token counts are divided by
        self.class_log = np.log10(within.sum(1) + 1)
        self.unigram = (known + 1) / (known + 1).sum()
        rng = np.random.default_rng(SEED)
        self.context = rng.normal(0, 0.1, (len(known), SIZE)).astype(np.float32)
        self.word = rng.normal(0, 0.1, (len(known), SIZE)).astype(np.float32)
        self.bias = np.log(self.unigram).astype(np.float32)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Ids of vocabulary rows as TokenRows gives them; those outside get their class's."""
        return np.where(rows < 0, self.first_class - 1 - rows, rows)

    def log_sums(self) -> np.ndarray:
        """Natural log of the normaliser of every context, by matrix products over blocks of contexts."""
        out = np.empty(len(self.bias))
        for at in range(0, len(out), 256):
            logits = self.context[at : at + 256] @ self.word.T + self.bias
            top = logits.max(1)
            out[at : at + 256] = top + np.log(np.exp(logits - top[:, None]).sum(1))
        return out


def nce(p: Parameters, before: np.ndarray, after: np.ndarray, weight: np.ndarray, rng: np.random.Generator, speed: tuple[np.ndarray, ...]) -> None:
    """One pass of noise-contrastive steps over weighted pairs; each batch shares its NOISE noise tokens."""
    cs, ws, bs = speed
    log_noise = np.log(NOISE * p.unigram).astype(np.float32)
    order = rng.permutation(len(before))
    for at in range(0, len(order), BATCH):
        k = order[at : at + BATCH]
        x, y, m = before[k], after[k], (weight[k] / weight[k].mean()).astype(np.float32)
        noise = rng.choice(len(p.unigram), NOISE, p=p.unigram)
        c, w, v = p.context[x], p.word[y], p.word[noise]
        true = (c * w).sum(1) + p.bias[y] - log_noise[y]
        false = c @ v.T + p.bias[noise] - log_noise[noise]
        miss = m / (1 + np.exp(np.clip(true, -20, 20)))
        fooled = -m[:, None] / (1 + np.exp(np.clip(-false, -20, 20)))
        dc = miss[:, None] * w + fooled @ v
        dw, db = miss[:, None] * c, miss
        dv, dn = fooled.T @ c, fooled.sum(0)
        both = np.append(y, noise)
        for table, sums, rows, step in ((p.context, cs, x, dc), (p.word, ws, both, np.vstack([dw, dv])), (p.bias, bs, both, np.append(db, dn))):
            order_of = np.argsort(rows, kind="stable")
            ordered = rows[order_of]
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            own, slope = ordered[first], np.add.reduceat(step[order_of], first, axis=0)
            sums[own] += slope**2
            table[own] += RATE * slope / np.sqrt(sums[own])


def _pairs(texts: list[bytes | None], p: Parameters, lookup: TokenRows) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct pairs of neighbouring ids (an end before and after each text), their counts, and how many in all."""
    tokens = [END]
    for text in texts:
        tokens += split_words(text)
        tokens.append(END)
    ids, size = p.of(lookup.of(tokens)), p.first_class + CLASSES
    pair, weight = np.unique(ids[:-1] * size + ids[1:], return_counts=True)
    return pair // size, pair % size, weight, len(tokens) - 1


def most_frequent(counts: DataFrame) -> list:
    """The rows of counts down to the lowest sixteenth of an octave of n at which they are at most TABLE."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    lowest, rows = None, 0
    for at, n in sizes:
        rows += n
        if rows > TABLE:
            break
        lowest = at
    return counts.where(step >= lowest).collect() if lowest is not None else []


def train(texts: DataFrame) -> tuple[Parameters, DataFrame]:
    """Parameters and the table (token, n) of all token counts from the training texts (doc_id, text)."""
    spark = texts.sparkSession
    small_batches(spark)
    counts = written(texts.select("text").mapInArrow(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "token-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = {bytes(r["token"]): r["n"] for r in sorted(most_frequent(counts), key=lambda r: (-r["n"], bytes(r["token"])))}
    end = counts.where(F.col("token") == F.lit(END)).first()
    frequent[END] = end["n"] if end else 0
    last = F.crc32(F.substring("token", -2, 2))
    by_class = counts.where(F.col("token") != F.lit(END)).groupBy((last % CLASSES).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect()
    p = Parameters(frequent, {r["k"]: (r["n"], r["m"]) for r in by_class}, total, kinds)
    for turn in range(ROUNDS if total else 0):
        shared = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            release()
            lookup = TokenRows(shared.value.ids)
            p, rng = shared.value, np.random.default_rng(SEED + turn)
            p.context, p.word, p.bias = p.context.copy(), p.word.copy(), p.bias.copy()
            speed = tuple(np.ones_like(t) for t in (p.context, p.word, p.bias))
            seen = 0
            kept: list[bytes | None] = []
            size = 0

            def learn() -> int:
                before, after, weight, n = _pairs(kept, p, lookup)
                nce(p, before, after, weight, rng, speed)
                return n

            for batch in batches:
                for _, texts in byte_texts(batch, "text", 64):
                    kept += texts
                    size += sum(len(t) for t in texts if t)
                    if size > CHUNK_BYTES:
                        seen += learn()
                        kept, size = [], 0
            if kept:
                seen += learn()
            if seen:
                rows = np.hstack([p.context, p.word, p.bias[:, None]]).astype(np.float64) * seen
                yield pa.record_batch([pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), float(seen))), pa.array(list(rows), pa.list_(pa.float64()))], ["row", "seen", "sums"])

        tasks = texts.select("text").mapInArrow(run, "row int, seen double, sums array<double>")
        columns = [F.sum(F.col("sums")[i]).alias(f"v{i}") for i in range(2 * SIZE + 1)]
        mean = tasks.groupBy("row").agg(F.sum("seen").alias("seen"), *columns).toPandas().sort_values("row").to_numpy()
        values = (mean[:, 2:] / mean[:, 1:2]).astype(np.float32)
        p.context, p.word, p.bias = values[:, :SIZE], values[:, SIZE : 2 * SIZE], values[:, -1]
    return p, counts


def score(docs: DataFrame, p: Parameters, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(p)
    schema = "row string, doc_id long, token binary, times long, n_tokens long, n_known long, base double, model double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        p = shared.value
        sums = p.log_sums()
        base = np.log10(p.total + p.kinds + 1.0)
        names = ["row", "doc_id", "token", "times", "n_tokens", "n_known", "base", "model"]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        lookup = TokenRows({w: i for i, w in enumerate(p.counts)})
        id_of = np.array([p.ids.get(w, p.first_class + class_of(w)) for w in p.counts], np.int64)
        number = np.array(list(p.counts.values()), np.int64)
        log_count = np.log10(number + 1.0)
        for batch in batches:
            for part, texts in byte_texts(batch, "text", 128):
                own: list[tuple[int, int, float, float]] = []
                place, rare, times = [], [], []
                for k, text in enumerate(texts):
                    words = [*split_words(text), END]
                    rows = lookup.of(words)
                    outer = rows < 0
                    ids = np.where(outer, p.first_class - 1 - rows, id_of[np.maximum(rows, 0)])
                    before = np.append(0, ids[:-1])
                    logs = np.einsum("ij,ij->i", p.context[before], p.word[ids], dtype=np.float64) + p.bias[ids] - sums[before]
                    outside, known = ids >= p.first_class, rows[~outer]
                    model = logs.sum() / np.log(10) - p.class_log[ids[outside] - p.first_class].sum() + log_count[rows[outside & ~outer]].sum()
                    own.append((len(words), int((number[known] > 0).sum()), log_count[known].sum() - len(words) * base, model))
                    counts = Counter(map(words.__getitem__, np.flatnonzero(outer).tolist()))
                    place += [k] * len(counts)
                    rare += counts
                    times += counts.values()
                n = len(rare)
                row, doc_id = (pa.concat_arrays([c, c.take(pa.array(place, pa.int64()))]) for c in (part.column(0), part.column(1)))
                token = pa.array([b" " + x.encode() for x in part.column(0).to_pylist()] + rare, pa.binary())
                figures = [np.append(np.array(c), np.zeros(n, np.array(c).dtype)) for c in zip(*own, strict=True)]
                columns = [row, doc_id, token, np.append(np.zeros(len(own), np.int64), np.array(times, np.int64)), *figures]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text"))
    rows = docs.select(key.alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    rest = counts.select("token", "n")
    joined = rows.join(rest, "token", "left")
    more = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found = joined.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.count_if(F.col("times") == 0).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + more).alias("base_score"),
        F.sum(F.col("model") + more).alias("score"),
    )
    each = [(F.col(c) / F.col("copies")).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))]
    found = found.select("doc_id", *each, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(p.total).cast("long").alias("train_tokens"), "base_score", "score")


def taught(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of the doc_id as text is not 2 modulo 7 (null ids teach)."""
    return docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))).select("doc_id", "text")
