"""Language identification, word first: a word known from training scores by its log frequency in each language; an
unseen word falls back to its character n-grams of the longest length of which any is known, down to one letter.

Words are runs of letters and the marks that belong to them, lower-cased; a run has at least one letter. The model is
fitted on at most SAMPLE labelled documents (a documented bound, those with the smallest hash of doc_id): all their words
and n-grams count, so that bound alone limits the model. It keeps a string's counts only for the languages that hold it,
so its size grows with what those documents hold and not with strings times languages: 5,000 documents of 3.4 kB in four
languages make 278,000 strings, 10.5 MB as they are sent, and the whole sample at most four times that. Every text is
judged whole.

Defined cases: a text that is null or has no letter (only digits, fractions, signs) gives `und` with score 0; so does every
text when nothing was learned. Ties go to the language first in the alphabet. Rows with null lang or null text teach
nothing; of rows that share a doc_id one teaches, the first by language and text, and each gets its own judgement. An empty
table gives no rows. `predict` reads doc_id and text alone and `accepted` hands on all columns, so others may have any name.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.llm.storage import small_batches, written
from tenderflow.llm.words import alive, release, spread

SAMPLE, LONGEST = 20_000, 4
UNKNOWN = "und"
#: Distinct strings after which a counting worker hands on what it has.
FLUSH = 100_000
#: Words a worker keeps the scores of before it starts anew, and most numbers it keeps for them.
CACHE_WORDS, CACHE_NUMBERS = 150_000, 4_000_000
#: Words after which further ones no longer make the score surer.
SURE_AFTER = 25
#: A text with a lower score is rejected along with `und`: nothing in it is known, or two languages fit alike.
REJECT_BELOW = 0.4
_WORD = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
SCHEMA = "doc_id long, lang_pred string, score double, n_words long"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_grams(word: str) -> Iterator[str]:
    marked = f"<{word}>"
    for n in range(2, LONGEST + 1):
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]
    yield from word


class Logs:
    """Log frequencies of strings, one added to every count; what is not `unseen` is kept for the languages that hold a string."""

    def __init__(self, counts: dict[str, dict[str, int]], langs: list[str]):
        every = sorted({w for c in counts.values() for w in c})
        self.rows = dict(zip(every, range(len(every)), strict=True))
        size = np.array([len(every) + sum(counts.get(lang, {}).values()) for lang in langs], float)
        self.unseen = -np.log(np.maximum(size, 1))
        held = [(self.rows[w], k, n) for k, lang in enumerate(langs) for w, n in counts.get(lang, {}).items()]
        row, lang, n = np.array(held, np.int64).reshape(-1, 3).T
        order = np.argsort(row, kind="stable")
        self.starts = np.searchsorted(row[order], np.arange(len(every) + 1))
        self.lang, self.more = lang[order].astype(np.int32), np.log(1.0 + n[order])

    def sums(self, place: list[int], rows: list[int], n: int) -> np.ndarray:
        """For each of n places the sum of the log frequencies of the strings (rows) entered there."""
        at, rows = np.array(place, np.int64), np.array(rows, np.int64)
        which, held = spread(self.starts[rows], self.starts[rows + 1] - self.starts[rows])
        size = len(self.unseen)
        more = np.bincount(at[which] * size + self.lang[held], self.more[held], n * size).reshape(n, size)
        return more + np.bincount(at, minlength=n)[:, None] * self.unseen


class Model:
    def __init__(self, words: dict[str, dict[str, int]], grams: dict[str, dict[str, int]]):
        """words and grams: counts by language."""
        self.key, self.langs = uuid.uuid4().hex, sorted(words.keys() | grams.keys())
        self.words, self.grams = Logs(words, self.langs), Logs(grams, self.langs)

    def score(self, words: list[str]) -> np.ndarray:
        """The log frequencies of each word in every language: its own, or the mean of its longest known n-grams; 0 where none is known."""
        known: tuple[list[int], list[int]] = ([], [])
        parts: tuple[list[int], list[int]] = ([], [])
        find, size = self.grams.rows.get, np.ones(len(words))
        for k, word in enumerate(words):
            row = self.words.rows.get(word)
            if row is not None:
                known[0].append(k)
                known[1].append(row)
                continue
            marked = f"<{word}>"
            for n in range(LONGEST, 0, -1):
                text = marked if n > 1 else word
                found = [r for i in range(len(text) - n + 1) if (r := find(text[i : i + n])) is not None]
                if found:
                    parts[0].extend([k] * len(found))
                    parts[1].extend(found)
                    size[k] = len(found)
                    break
        return self.words.sums(*known, len(words)) + self.grams.sums(*parts, len(words)) / size[:, None]


class Scores(dict):
    """Row of each word in a table of scores."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.room = max(1_000, min(CACHE_WORDS, CACHE_NUMBERS // max(1, len(model.langs))))
        self.table = np.zeros((self.room, len(model.langs)))

    def learn(self, words: set[str]) -> None:
        """Scores the words that are new, all together; the table starts anew where they don't fit, and leaves out what never would."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.room:
            self.clear()
            new = list(words) if len(words) <= self.room else []
        if new:
            at = len(self)
            self.table[at : at + len(new)] = self.model.score(new)
            self.update(zip(new, range(at, at + len(new)), strict=True))

    def total(self, words: list[str]) -> np.ndarray:
        """Sum of the scores of words, in pieces that fit the table."""
        out = np.zeros(len(self.model.langs))
        for at in range(0, len(words), self.room // 4):
            part = words[at : at + self.room // 4]
            self.learn(set(part))
            out += self.table[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(0)
        return out


def fit(labelled: DataFrame) -> Model | None:
    """Model from (doc_id, text, lang); null when no row teaches."""
    small_batches(labelled.sparkSession)
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    ids = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    once = F.min(F.struct("lang", "text")).alias("once")
    sample = labelled.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(once).select("once.lang", "once.text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kept: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                kept.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, kept.values())) > FLUSH:
                    yield from rows(kept)
                    kept = {}
        yield from rows(kept)

    def rows(kept: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in kept.items():
            yield pa.record_batch([pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], ["lang", "word", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kept: dict[str, Counter] = {}
        for batch in batches:
            for lang, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                counter = kept.setdefault(lang, Counter())
                for g in word_grams(word):
                    counter[g] += n
                if len(counter) > FLUSH:
                    yield from rows({lang: kept.pop(lang)})
        yield from rows(kept)

    def of(counts: DataFrame) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {}
        table = counts.select("lang", "word", "n").toArrow()
        for lang, word, n in zip(*[c.to_pylist() for c in table.columns], strict=True):
            out.setdefault(lang, {})[word] = n
        return out

    counts = written(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    words = of(counts)
    parts = counts.mapInArrow(grams, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Model(words, of(parts)) if words else None


def _scores(model: Model | None) -> Scores | None:
    """The worker's table for this model; one is kept at a time."""
    return None if model is None else alive(("language", model.key), lambda: Scores(model))


def judge(texts: list[str | None], scores: Scores | None) -> list[tuple[str, float, int]]:
    """(language, score, words) of each text."""
    out, found = [], list(map(words_of, texts))
    if scores is not None:
        scores.learn(set().union(*found))
    for words in found:
        if not words or scores is None:
            out.append((UNKNOWN, 0.0, len(words)))
            continue
        total = scores.total(words)
        best = int(total.argmax())
        apart = (total - total[best]) * (min(len(words), SURE_AFTER) / len(words))
        out.append((scores.model.langs[best], float(1 / np.exp(apart).sum()), len(words)))
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and n_words of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, sure, size = zip(*judge(part.column(1).to_pylist(), scores), strict=True)
                yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(size, pa.int64())], ["doc_id", "lang_pred", "score", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, whose language is told with a score of at least REJECT_BELOW."""
    small_batches(docs.sparkSession)
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = judge(part.column(text).to_pylist(), scores)
                yield part.filter(pa.array([lang != UNKNOWN and sure >= REJECT_BELOW for lang, sure, _ in found]))

    return docs.mapInArrow(run, docs.schema)


def taught(docs: DataFrame) -> DataFrame:
    """Rows that may teach: crc32 of the doc_id as text is not 2 modulo 4."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "text", "lang")
