"""Piece codec and token counts against the libraries."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tenderflow.llm import piece_codec, queries, token_counts

MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "  two  spaces ", "a▁b", "naïve café ﬁ ½ ①", "日本語テキスト", "\x00\x01\t\n\r", "🙂🙃 zero​width", "x" * 3000, "ab" * 2000, "<s> </s> <unk> <0x41>", "don't we'll I'M", "<|endoftext|> a<|endoftext|>", "１２３ 456", "a_b__c___", "  \n\n  x", "\u2028sep\u00a0nbsp", "\u0558 x\u058by \U0001df25 a\u088f", "é" * 100, "...!!!???", "\r\n" * 50]


@pytest.fixture(scope="module")
def hard(spark, documents, odd_docs):
    more = spark.createDataFrame(list(enumerate(HARD, 10**6)), "doc_id long, text string")
    return documents.select("doc_id", "text").union(more).union(odd_docs.selectExpr("doc_id + 2000000", "text"))


def test_piece_digests(hard):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for r in hard.collect():
        ids = sp.encode(r.text or "", add_eos=True)
        expected.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    rows = piece_codec.digests(hard, MODEL).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows), key=str) == sorted(expected, key=str)
    assert sum(not r.agrees for r in rows) <= 3


def test_merging_alone_gives_the_librarys_ids(documents):
    """Without the check by the library."""
    pieces, sp = piece_codec.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text for r in documents.limit(60).collect()] + [t for t in HARD if "\x00" not in t]
    wrong = [t for t in texts if t and pieces.encode(t) != sp.encode(t, add_eos=True)]
    assert not wrong
    assert all(pieces.decode(sp.encode(t)) == sp.decode(sp.encode(t)) for t in texts)


def test_pieces_round_trip(hard):
    rows = piece_codec.encode_decode(hard, MODEL).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(r.decoded == sp.decode(r.ids) for r in rows)


def test_token_counts(hard):
    t = Tokenizer.from_file(VOCABULARY)
    expected = sorted(((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in hard.collect()), key=str)
    rows = token_counts.token_counts(hard, VOCABULARY).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=str) == expected
    whole, merges = token_counts.prove(VOCABULARY), token_counts.load(VOCABULARY)
    find = lambda x: (merges.find_exact if merges.has_odd.search(x) else merges.find)(x)
    plain = {r.doc_id: r.text or "" for r in hard.collect() if "<|" not in (r.text or "")}
    assert all(r.n_whole == sum(x in whole for x in find(plain[r.doc_id])) for r in rows if r.doc_id in plain)


def test_proven_strings_encode_alone_as_one_token():
    t = Tokenizer.from_file(VOCABULARY)
    proven = sorted(token_counts.prove(VOCABULARY))
    assert len(proven) > 40_000
    find = token_counts.load(VOCABULARY).find
    assert all(len(t.encode(x, add_special_tokens=False).ids) == 1 for x in proven[::37] if find(x) == [x])


def test_empty_tables(no_docs):
    assert piece_codec.digests(no_docs, MODEL).count() == piece_codec.encode_decode(no_docs, MODEL).count() == token_counts.token_counts(no_docs, VOCABULARY).count() == 0


def test_clashing_columns_and_repeated_rows(odd_docs):
    """Every row gives a row; columns of other names are not looked at."""
    clashing = odd_docs.selectExpr("*", "1 AS ids", "'x' AS n_tokens", "'x' AS decoded", "'x' AS agrees", "'x' AS n_bytes")
    for found in (piece_codec.digests(clashing, MODEL), piece_codec.encode_decode(clashing, MODEL), token_counts.token_counts(clashing, VOCABULARY)):
        ids = [r.doc_id for r in found.collect()]
        assert len(ids) == 13 and ids.count(8) == 2


def test_query_columns(spark, folder):
    assert queries.op7_token_counts(spark, folder).dtypes[:4] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert queries.op2_sentencepiece(spark, folder).dtypes[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
