"""Importance resampling against a plain model of its formulas."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tenderflow.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets_of(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(buckets_of(x))
    for x in target:
        t.update(buckets_of(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        found = buckets_of(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(words(x)) >= 20])
    may = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(may[: 5 * len(may) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, (r[:5] for r in rows)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def expected(spark, folder, documents):
    return plain([(r.doc_id, r.text) for r in documents.collect()], [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])


def test_query(spark, folder, expected):
    found = queries.op13_resampling(spark, folder)
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert result(found) == expected and any(r[4] for r in expected)


def test_groups_blocks_and_pieces_change_nothing(spark, folder, documents, expected, monkeypatch):
    monkeypatch.setattr(resampling, "GROUP_ROWS", 7)
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    gain = resampling.gains(resampling.bucket_counts(documents), resampling.bucket_counts(benchmark))
    rows = resampling.written(resampling.scored(resampling.weights(documents, gain)), "scored")
    assert result(resampling.ranked(rows)) == expected
    texts = [r.text.encode() for r in documents.limit(40).collect()]

    def counts():
        known, out = resampling.Dictionary(), Counter()
        for w, row, piece, own in resampling.blocks(texts):
            for bucket, which, last in resampling.tuples(known, w, piece, own, 10000):
                out.update(zip(row[last].tolist(), bucket[which].tolist(), strict=True))
        return out

    whole = counts()
    monkeypatch.setattr(resampling, "PIECE", 30)
    monkeypatch.setattr(resampling, "BLOCK_WORDS", 11)
    assert counts() == whole == Counter((k, b) for k, x in enumerate(texts) for b in buckets_of(x.decode()))


def test_odd_rows(spark, odd_docs):
    target = spark.createDataFrame([(None,), ("",), ("one two three w1 w2",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    many = odd_docs.union(odd_docs).union(odd_docs)
    assert result(resampling.resample(odd_docs, target)) == plain(rows, [None, "", "one two three w1 w2"])
    assert resampling.resample(many, target).count() == 3 * len(rows)


def test_ties_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(i % 40, text) for i in range(120)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(text,)], "text string")
    assert result(resampling.resample(docs, target)) == plain(rows, [text])


def test_empty_tables_and_drawn(spark, no_docs, documents):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, target).count() == 0
    found = resampling.resample(documents, target)
    ids = {r.doc_id for r in found.where("rank IS NOT NULL").collect()}
    assert ids and {r.doc_id for r in resampling.drawn(documents, found).collect()} == ids
