"""The corpus pipeline against the plain models, and in small."""

import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from plain import near_classes

from tenderflow.llm import storage


def test_stages(spark, documents, folder):
    docs = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()} if k < 4 else before
        docs = storage.written(stage(spark, docs, folder), "stage")
        rows = docs.collect()
        if k < 4:
            assert docs.columns == documents.columns, name
            assert len({r.doc_id for r in rows}) == len(rows)
        if name == "near_dedup":
            assert {r.doc_id for r in rows} == set(near_classes(before).values())
        if name == "substring_dedup":
            assert len(rows) >= 0.9 * len(before) and all(r.n_chars == len(r.text) for r in rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = {r.doc_id: r for r in rows}
    assert all(r.decoded == sp.decode(r.ids) for r in last.values())


def test_run_gives_what_the_stages_give(spark, folder):
    once, again = (sorted((r.doc_id, len(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert once == again and once


def test_odd_rows(spark, odd_docs, folder):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, folder)
    assert docs.columns == odd_docs.columns
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(8) == 1 and 7 not in ids and {1, 2, 3, 4, 6, 9, 10, 11} <= set(ids)
    coded = {r.doc_id: r for r in corpus_pipeline.STAGES[4][1](spark, odd_docs, folder).collect()}
    assert [len(coded[i].ids) for i in (1, 2)] == [1, 1] and coded[6].decoded == next(r.text for r in odd_docs.collect() if r.doc_id == 6)
    labelled = odd_docs.drop("lang").selectExpr("*", "CASE WHEN doc_id IN (4, 5, 8) THEN 'en' WHEN doc_id = 9 THEN 'ja' END AS lang")
    known = corpus_pipeline.STAGES[0][1](spark, labelled, folder)
    assert known.columns == labelled.columns and {1, 2, 3, 10}.isdisjoint(r.doc_id for r in known.collect())
    assert corpus_pipeline.STAGES[0][1](spark, odd_docs.withColumn("lang", F.lit(None).cast("string")), folder).count() == 0
    empty = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_remains_without_words_go(spark, folder):
    """A text that is cut to line breaks alone is no document."""
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{passage} more"), (2, f"\n\t{passage}\r\n"), (3, "\n")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.cut_repeated_passages(spark, docs, folder).collect()} == {1, 3}
