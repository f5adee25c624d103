"""Byte-level encoding with the pair index against the tokenizers library."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from tenderflow.llm import pair_index, queries, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "  two  spaces ", "naïve café ﬁ ½ ①", "日本語テキスト", "\x00\x01\t\n\r", "\x1c\x1d x", "🙂🙃 zero​width", "x" * 3000, "ab" * 2000, "aaa aaaa aaaaa", "don't we'll I'M ''s 'sam", "<|endoftext|> a<|endoftext|>", "<|endoftext|", "１２３ 456", "՘ x֋y \U0001df25", " sep nbsp　wide", "é" * 5000, "...!!!???'ll", "\r\n" * 50, "हिन्दी में", "a" * 100_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def index():
    return pair_index.PairIndex(VOCABULARY, token_counts.odd_points())


@pytest.fixture(scope="module")
def hard(spark, documents, odd_docs):
    more = spark.createDataFrame([*enumerate(HARD, 10**6)], "doc_id long, text string")
    return documents.select("doc_id", "text").union(more).union(odd_docs.selectExpr("doc_id + 2000000", "text"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(hard, library):
    expected = []
    for r in hard.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    found = [tuple(r) for r in pair_index.digests(hard, VOCABULARY).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_ids_and_texts(hard, library):
    rows = pair_index.encode_decode(hard, VOCABULARY).collect()
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert sorted((r.decoded for r in rows)) == sorted(r.text or "" for r in hard.collect())


def test_classes_are_the_librarys(index):
    """Around every code point on which the versions of Unicode differ, and around common ones."""
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    odd = [ord(c) for x in token_counts.odd_points().values() for c in x]
    for c in [*range(3000), *odd[::7], *range(0x2000, 0x2100)]:
        text = f"a{chr(c)}{chr(c)}b 1{chr(c)}1 ,{chr(c)}, {chr(c)} {chr(c)}\n{chr(c)}  {chr(c)}'s 's{chr(c)}"
        assert index.pretokens(text) == [text[a:b] for _, (a, b) in cut(text)], hex(c)


def test_one_row_of_symbols_merges_as_each_pretoken_by_itself(index):
    rng = random.Random(5)
    some = ["".join(rng.choices("aabehinrst é", k=rng.randrange(1, 40))) for _ in range(2000)]
    assert index.merge(some) == [index.merge([x])[0] for x in some]


def test_broken_utf8_decodes_as_the_library_does(index, library):
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(12)]
        assert index.decode(",".join(map(str, ids))) == library.decode(ids, skip_special_tokens=False)


def test_a_small_cache_changes_nothing(index, documents, monkeypatch):
    texts = [r.text or "" for r in documents.collect()] + ["<|endoftext|> again"]
    whole = pair_index.Known(index).coded(texts)
    monkeypatch.setattr(pair_index, "CACHE_CHARS", 500)
    small = pair_index.Known(index)
    assert [x for at in range(0, len(texts), 16) for x in small.coded(texts[at : at + 16])] == whole


def test_a_vocabulary_out_of_order_is_refused(tmp_path):
    with open(VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"].reverse()
    path = tmp_path / "reversed.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        pair_index.PairIndex(str(path), {})


def test_empty_table_and_columns(spark, no_docs, folder):
    assert pair_index.digests(no_docs, VOCABULARY).count() == pair_index.encode_decode(no_docs, VOCABULARY).count() == 0
    assert queries.op11_pair_index(spark, folder).dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
