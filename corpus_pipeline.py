"""A corpus pipeline over documents: five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow.llm import decontamination, language_id, minhash_dedup, piece_codec, storage, substring_dedup


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; those without letters or without any known word or n-gram go.

    Null and empty texts have no letters and go; repeated rows are judged each, equal ones alike. Rows without a language
    teach nothing, so a table without any language, as an empty one, keeps nothing.
    """
    return language_id.accepted(docs, language_id.fit(language_id.taught(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id, once if it is repeated.

    Rows without a doc_id or without words have no duplicates and stay; an empty table stays empty.
    """
    found = storage.written(minhash_dedup.near_duplicates(docs), "components")
    docs = storage.anti_join_ids(docs, found.where("NOT kept").select("doc_id").distinct(), "doc_id")
    again = storage.written(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    once = storage.semi_join_ids(docs, again, "doc_id").dropDuplicates(["doc_id"])
    return storage.anti_join_ids(docs, again, "doc_id").unionByName(once)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller doc_id holds; remains without any word go.

    Null and short texts and rows without a doc_id stay as they are; of equal passages the one of the smallest doc_id stays.
    """
    spans = storage.written(substring_dedup.repeated_passages(docs), "spans")
    cut = substring_dedup.cut_passages(docs, spans)
    touched = spans.select("doc_id").distinct()
    whole = storage.anti_join_ids(cut, touched, "doc_id")
    rest = storage.semi_join_ids(cut, touched, "doc_id").where(F.col("text").rlike(r"[^ \t-\r]"))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(rest)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item; null texts overlap with none, repeated rows share their fate.

    An empty benchmark takes nothing away.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = storage.written(decontamination.contaminated(docs, benchmark).select("doc_id").where("doc_id IS NOT NULL").distinct(), "contaminated")
    return storage.anti_join_ids(docs, hit, "doc_id")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, the decoded text, and whether the sentencepiece library agrees, of every row; a null text counts as empty."""
    return piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: The stages' models and hashes are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = storage.written(docs, name)
    return docs
