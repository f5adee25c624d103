"""Learned operators: held-out results, exact parts against plain models, and defined cases."""

import math
from collections import Counter

import numpy as np
import pytest
from plain import crc
from pyspark.sql import functions as F

from tenderflow.llm import language_id, lm_scoring, quality, queries, url_filter

LARGER = "/root/testdata/sf0.01"


def test_language_id(spark, folder):
    rows = queries.op10_language_id(spark, LARGER).collect()
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    assert len(rows) == len(langs) and all(0 <= r.score <= 1 and r.held_out == (crc(r.doc_id) % 4 == 2) for r in rows)
    held = [(r.lang_pred, langs[r.doc_id][0]) for r in rows if r.held_out and langs[r.doc_id][0] and r.n_words >= 5]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(r.lang_pred == "und" for r in rows if not language_id.words_of(langs[r.doc_id][1]))


def test_words_come_first_then_the_longest_known_grams():
    model = language_id.Model({"a": {"cat": 3}, "b": {"dog": 3}}, {"a": {"ca": 1, "at>": 2}, "b": {"og": 2, "t": 1}})
    cat, rat, t, q = model.score(["cat", "rat", "t", "q"])
    assert np.allclose(cat, [math.log(4 / 5), math.log(1 / 5)])
    assert np.allclose(rat, [math.log(3 / 7), math.log(1 / 7)]) and np.allclose(t, [math.log(1 / 7), math.log(2 / 7)]) and not q.any()


def test_language_of_odd_rows(odd_docs, no_docs, spark):
    model = language_id.fit(spark.createDataFrame([(1, "one two null id here", "en"), (2, "uno dos", "es"), (3, None, "de"), (4, "drei", None)], "doc_id long, text string, lang string"))
    found = {r.doc_id: r for r in language_id.predict(odd_docs, model).collect()}
    assert found[4].lang_pred == "en" and [found[i].lang_pred for i in (1, 2, 3, 10)] == ["und"] * 4 and found[1].score == 0
    kept = language_id.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and {1, 2, 3, 10}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_id.predict(no_docs, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd_docs, language_id.fit(no_docs)).collect()} == {"und"}


def test_what_is_a_letter(spark):
    """Fractions and circled digits are no letters; marks belong to their words; languages of all counts are kept apart."""
    taught = [(1, "हिन्दी में लिखा", "hi"), (2, "naïve cafés", "fr"), (3, "one two", "en"), (4, "½ x²", "en")]
    model = language_id.fit(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    asked = ["½ ² ①", "12 ٣ ७", "①", "़", "हिन्दी", "x²"]
    found = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert [found[i].lang_pred for i in range(6)] == ["und"] * 4 + ["hi", "en"] and found[0].score == 0
    assert language_id.words_of("हिन्दी में") == ["हिन्दी", "में"] and language_id.words_of("x²y") == ["x", "y"]


def test_repeated_rows_teach_once(spark, monkeypatch):
    rows = [(1, "one two", "en")] * 50 + [(2, "uno dos", "es"), (2, "zwei", "xx")] + [(None, "three", "en")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "SAMPLE", 2)
    model = language_id.fit(labelled)
    assert model.langs == ["en", "es"] and np.allclose(model.score(["one"])[0], [math.log(2 / 6), math.log(1 / 6)])


def test_null_ids_are_not_held_out(spark, tmp_path):
    frame = spark.createDataFrame([(None, "one two", "en", 1), (2, "uno dos", "es", 0), (5, "one", "en", 1)], "doc_id long, text string, lang string, quality int")
    frame.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    frame.select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    for query, n, k in ((queries.op4_quality, 3, 1), (queries.op10_language_id, 4, 2)):
        assert {r.doc_id: r.held_out for r in query(spark, str(tmp_path)).collect()} == {None: False, 2: crc(2) % n == k, 5: crc(5) % n == k}


def test_quality_on_held_out_rows(spark, folder):
    rows = {r.doc_id: r for r in queries.op4_quality(spark, LARGER).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if crc(r.doc_id) % 3 == 1 and r.quality is not None]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (crc(r.doc_id) % 3 == 1) for r in rows.values())
    good, bad = ([rows[i].score for i, q in labels if q == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.85
    assert np.mean([rows[i].predicted == q for i, q in labels]) > 0.8


def test_quality_of_odd_rows(odd_docs, no_docs, spark):
    kinds = "doc_id long, quality int, text string"
    labels = spark.createDataFrame([(8, 1, "x"), (8, 1, "x"), (4, 0, "x"), (10, None, "x"), (99, 1, "x"), (None, 0, "x")], kinds)
    rows = quality.score(odd_docs, quality.fit(odd_docs, labels)).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(odd_docs, quality.fit(odd_docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(no_docs, quality.fit(no_docs, labels)).count() == 0


def test_repeated_labels_and_rows_teach_once(spark):
    texts = {i: ("Good prose here. " if i % 2 else "$$$ BUY!!! ") * (i + 1) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    one = quality.fit(docs, labels)
    many = quality.fit(docs.union(docs).union(docs), labels.union(labels))
    assert np.array_equal(one.weights, many.weights) and (one.cut, one.width) == (many.cut, many.width)


def test_preferences_reach_the_optimum():
    """The weights of the pairwise logistic loss against a plain solution over all pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, quality.N_FEATURES))
    good = x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=60) > 0
    worth = quality.Worth(x, good)
    z = worth.standard(x)
    apart = (z[good][:, None] - z[~good][None]).reshape(-1, z.shape[1])
    weights = np.zeros(z.shape[1])
    for _ in range(4000):
        weights += 0.2 * ((1 / (1 + np.exp(apart @ weights))) @ apart / len(apart) - quality.DECAY * weights)

    def loss(w):
        return np.log1p(np.exp(-apart @ w)).mean() + quality.DECAY / 2 * w @ w

    assert loss(worth.weights) < loss(np.zeros_like(weights)) / 2 and loss(worth.weights) < loss(weights) + 0.05
    assert worth.cut == np.quantile(z @ worth.weights, 1 - good.mean())


def test_every_label_teaches(spark):
    """Few bad texts whose doc_ids have the largest hashes among 21,000 labels."""
    ids = [r.id for r in spark.range(21_000).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, "Good prose here.", 1) for i in ids[:-50]] + [(i, "$$$ BUY!!!", 0) for i in ids[-50:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4).cache()
    found = quality.score(docs, quality.fit(docs, docs)).join(docs.select("doc_id", "quality"), "doc_id")
    assert {(r.quality, r.predicted) for r in found.select("quality", "predicted").distinct().collect()} == {(0, 0), (1, 1)}


def test_blocks_teach_as_one_table_does(spark, sayings, monkeypatch):
    """Sums over blocks against the whole table at once, and the slope of the mean over all pairs at the optimum."""
    monkeypatch.setattr(quality, "BLOCK", 7)
    rows = [(i, " ".join(sayings(20 + i % 13, i)) + (" !!" if i % 5 else "?") * (i % 3), int(i % 3 > 0)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    x, good = np.array([quality.features(t.encode()) for _, t, _ in rows]), np.array([q == 1 for *_, q in rows])
    one, many = quality.Worth(x, good), quality.fit(docs, docs)
    assert quality.blocks(docs, docs).count() > 5 and np.allclose(one.weights, many.weights, atol=1e-3) and np.isclose(one.cut, many.cut, atol=1e-2)
    z = one.standard(x)
    apart = (z[good][:, None] - z[~good][None]).reshape(-1, z.shape[1])
    assert np.abs(quality.DECAY * one.weights - (1 / (1 + np.exp(apart @ one.weights))) @ apart / len(apart)).max() < 1e-3


def test_language_model(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op3_lm_scoring(spark, LARGER).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b" "] for i, t in docs.items()}
    counts = Counter(w for i, ws in tokens.items() if crc(i) % 7 != 2 for w in ws)
    total, kinds = counts.total(), len(counts)
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 7 == 2, len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    frequent = {w.encode(): 10 for w in ("a", "b", "c")} | {lm_scoring.END: 5}
    p = lm_scoring.Parameters(frequent, {k: (40, 7) for k in range(lm_scoring.CLASSES)}, 2600, 450)
    rng = np.random.default_rng(1)
    p.word += rng.normal(0, 1, p.word.shape).astype(np.float32)
    logits = p.context @ p.word.T + p.bias
    assert np.allclose(np.exp(logits - p.log_sums()[:, None]).sum(1), 1, atol=1e-4)


def test_contrast_learns_pairs():
    """After training, the follower that was seen is likelier than by its frequency alone."""
    frequent = {f"w{i}".encode(): 100 for i in range(20)} | {lm_scoring.END: 100}
    classes = Counter(lm_scoring.class_of(w) for w in frequent if w != lm_scoring.END)
    p = lm_scoring.Parameters(frequent, {k: (100 * n, n) for k, n in classes.items()}, 2100, 21)
    before = np.arange(1, 21)
    after = before % 20 + 1
    speed = tuple(np.ones_like(t) for t in (p.context, p.word, p.bias))
    for turn in range(150):
        lm_scoring.nce(p, before, after, np.full(20, 50), np.random.default_rng(turn), speed)
    logs = (p.context @ p.word.T + p.bias - p.log_sums()[:, None])[before, after]
    assert np.exp(logs).mean() > 0.2


def test_language_model_of_odd_rows(odd_docs, no_docs):
    rows = lm_scoring.score(odd_docs, *lm_scoring.train(lm_scoring.taught(odd_docs))).collect()
    assert len(rows) == 13 and sum(r.doc_id == 8 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert lm_scoring.score(no_docs, *lm_scoring.train(no_docs)).count() == 0
    assert lm_scoring.score(odd_docs, *lm_scoring.train(no_docs)).count() == 13


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def by_rule(url):
    """(host, path, rule, verdict) by plain string work."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min([rest.find(c, cut) for c in "?#" if c in rest[cut:]], default=len(rest))
    path = rest[cut:end]
    fits = [(r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "https://example.com/en/x", "https://example.com/de", "http://com/", "http://x.net/es/1", "http://x.net/est", "http://net/fr/", "a://b://c/d", "http://x.org?q=/en/", "http://notcom/", "http://x.com", "http://é.net/FR/\nnew", "http://x.org/" + "p" * 5000]


@pytest.fixture(scope="module")
def pages(spark, folder):
    table = spark.read.parquet(f"{LARGER}/pages.parquet").select("page_id", "url")
    more = spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(URLS)] + [(None, "http://x.com/")] * 2, "page_id long, url string")
    return table.unionByName(more.select(more.page_id.cast(table.schema["page_id"].dataType), "url"))


def test_urls(pages):
    asked = Counter((r.page_id, *by_rule(r.url)[:3]) for r in pages.collect())
    rows = url_filter.judge(pages, RULES).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == asked
    for r in rows:
        ruled = by_rule(f"x://{r.host}{r.path}")[3] if r.host else None
        assert r.verdict == (ruled or ("block" if r.value < r.threshold else "allow"))


def test_url_values_by_brute_force(spark):
    """Counts, smoothing and ratios of the Markov models, computed letter by letter."""
    urls = [("ab.com/x?q=1", "allow"), ("aab.com/", "allow"), ("ba.net/es/", "block"), ("b.net/fr/x", "block")]
    fold = [("".join(c if c.isalpha() or c in "./-" else "0" if c.isdigit() else "*" for c in u), k) for u, k in urls]
    probability = {}
    for kind in ("allow", "block"):
        seen = [("^^^" + u + "$", k) for u, k in fold]
        for order in range(4):
            for text, _ in seen:
                for i in range(3, len(text)):
                    context, c = text[i - order : i], text[i]
                    follow = Counter(t[j] for t, k in seen if k == kind for j in range(3, len(t)) if t[j - order : j] == context)
                    if order == 0:
                        p = (follow[c] + 1) / (follow.total() + url_filter.SYMBOLS)
                    else:
                        lower = probability[kind, (context + c)[1:]]
                        p = (follow[c] + len(follow) * lower) / (follow.total() + len(follow)) if follow else lower
                    probability[kind, context + c] = p

    def plain_value(text):
        text, logs = "^^^" + text + "$", []
        for i in range(3, len(text)):
            known = [text[i - o : i + 1] for o in (3, 2, 1, 0) if ("allow", text[i - o : i + 1]) in probability]
            logs.append(math.log(probability["allow", known[0]] / probability["block", known[0]]) if known else 0.0)
        return np.mean(logs)

    taught = spark.createDataFrame(fold, "s string, ruled string")
    asked = ["ab.net/x*q*0", "zz", "", "ba.com"]
    rows = url_filter.value(spark.createDataFrame([(s,) for s in asked], "s string"), url_filter.train(taught)).collect()
    assert {r.s for r in rows} == set(asked) and all(math.isclose(r.value, plain_value(r.s), abs_tol=1e-9) for r in rows)
    folded = spark.createDataFrame([("HTTP://Ab.com/x?q=12",), ("no Scheme",), (None,)], "url string").select(url_filter.folded(F.col("url")).alias("s"))
    assert [r.s for r in folded.collect()] == ["ab.com/x*q*0", "no*scheme", ""]


def test_languages_by_brute_force(spark):
    """Predictions and scores of a small table, word by word."""
    taught = [(1, "the cat sat", "en"), (2, "the dog ran far", "en"), (3, "el gato come", "es"), (4, "el perro corre", "es")]
    asked = ["the perro", "gatos catty", "zzz", "el el the", "Cat"]
    words, grams = {}, {}
    for _, text, lang in taught:
        for w in text.split():
            words.setdefault(lang, Counter())[w] += 1
            for g in language_id.word_grams(w):
                grams.setdefault(lang, Counter())[g] += 1
    langs = sorted(words)

    def logs(table, x):
        every = {y for c in table.values() for y in c}
        return [math.log((table[k][x] + 1) / (table[k].total() + len(every))) for k in langs] if x in every else None

    def score(w):
        if (known := logs(words, w)) is not None:
            return known
        for n in (4, 3, 2, 1):
            text = w if n == 1 else f"<{w}>"
            found = [x for i in range(len(text) - n + 1) if (x := logs(grams, text[i : i + n])) is not None]
            if found:
                return np.mean(found, axis=0)
        return [0.0] * len(langs)

    model = language_id.fit(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    rows = language_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    for r in rows:
        total = np.sum([score(w) for w in asked[r.doc_id].lower().split()], axis=0)
        n = len(asked[r.doc_id].split())
        best = int(np.argmax(total))
        assert r.lang_pred == langs[best] and math.isclose(r.score, 1 / np.exp((total - total[best]) * min(n, 25) / n).sum(), rel_tol=1e-9)


def test_url_model_tells_the_classes_apart(spark):
    rows = [(i, f"http://site{i}.com/shop/item{i}") for i in range(60)] + [(100 + i, f"http://x{i}.net/es/casino-bonus-{i}") for i in range(60)]
    asked = [(500, "http://other.org/shop/item7"), (501, "http://other.org/casino-bonus-7")]
    found = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows + asked, "page_id long, url string"), RULES).collect()}
    assert found[500] == "allow" and found[501] == "block"


def test_urls_without_classes(spark):
    df = spark.createDataFrame([(1, "http://x.org/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge(df, RULES).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), RULES).count() == 0
    clashing = spark.createDataFrame([(1, "http://a.net/fr/x", *["x"] * 6), (1, "http://a.net/fr/x", *["x"] * 6)], "page_id long, url string, host string, path string, rule string, verdict string, s string, value string")
    assert [(r.page_id, r.host, r.rule) for r in url_filter.judge(clashing, RULES).collect()] == [(1, "a.net", "net/fr/")] * 2
