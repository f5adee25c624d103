"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tenderflow.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def plain(counts):
    links = {w: [] for w in counts}
    words = sorted(counts)
    for k, a in enumerate(words):
        for b in words[k + 1 :]:
            if near(a, b):
                links[a].append(b)
                links[b].append(a)
    form = {w: f if (f := min(x, key=lambda v: (-counts[v], v))) and counts[f] >= 5 * counts[w] else None for w, x in links.items() if x}
    out = []
    for w in words:
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, counts[w], len(links[w]), counts[f] if f else None))
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_query(spark, folder, documents):
    rows = queries.op12_spelling(spark, folder)
    assert rows.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    expected = plain(plain_counts([(r.doc_id, r.text) for r in documents.collect()]))
    assert found(rows) == expected and any(r[1] for r in expected)


@pytest.fixture(scope="module")
def crowded():
    """Words of few letters with many neighbours, runs of equal letters, long words, and a chain of forms."""
    rng = random.Random(9)
    made = {"".join(rng.choices("abé", k=rng.randrange(6, 10))): rng.choice([5, 6, 30, 200]) for _ in range(500)}
    long = "xyz" * 200
    made |= {long: 40, long[:300] + long[301:]: 5, long[:-1] + "q": 6, "ÿ" * 600: 50, "ÿ" * 601: 5}
    return made | {"chains": 1000, "chainss": 150, "chainsst": 25, "chainszst": 5, "zequals": 5, "yequals": 5, "equals": 5, "xequals": 5}


@pytest.mark.parametrize("block,crowd", [(400_000, 1_000_000), (300, 1_000_000), (300, 60)])
def test_all_pairs(spark, crowded, monkeypatch, block, crowd):
    """Also where blocks are small and groups are dealt down to single positions."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "CROWD", crowd)
    docs = spark.createDataFrame([(None, " ".join([w, "x"] * 1)) for w, n in crowded.items() for _ in range(n)], "doc_id long, text string").repartition(3)
    rows = found(spelling.variants(docs))
    counts = plain_counts([(None, w) for w, n in crowded.items() for _ in range(n)])
    assert rows == plain(counts)
    assert next(r for r in rows if r[0] == "chainszst")[2] == "chains"


def test_a_wavelet_tree_reports_what_a_scan_finds():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 64, 100):
        values = rng.permutation(size)
        tree = spelling.Wavelet(values)
        ends = np.sort(rng.integers(0, size + 1, (4, 50)).reshape(2, 2, 50), axis=0)
        left, right, low, high = ends[0, 0], ends[1, 0], ends[0, 1], ends[1, 1]
        query, value = tree.report(left, right, low, high)
        expected = [(q, v) for q in range(50) for v in values[left[q] : right[q]] if low[q] <= v < high[q]]
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == sorted(expected)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    five = odd_docs
    for _ in range(5):
        five = five.union(odd_docs)
    assert found(spelling.variants(five)) == plain(plain_counts(rows * 6))
    assert spelling.variants(no_docs).count() == 0
