"""Byte-level BPE encoding and decoding with a pair occurrence index.

The pre-tokens that are new in a slice of a partition are laid out in one row of symbols. The index maps the rank of each
mergeable pair to all places where the pair stands; the active ranks are applied in ascending order, each at all its
places from left to right, and every merge enters the pairs that it makes with its two neighbours. Places of pairs that
an earlier merge took apart are passed over. Each distinct pre-token is merged once per worker, as long as it stays in a
bounded cache; ids are decoded by the vocabulary's bytes alone.

One rank after the other gives what merging each pre-token by itself gives only if a merge never makes a pair of a lower
rank. That holds where every merge makes a token of its own and joins tokens that lower ranks made; it is checked when
the vocabulary is read.

Texts are cut as `token_counts` cuts them, by the library's classes of letters and numbers.

Defined cases: a null or empty text has no ids and decodes to "". Added tokens inside a text become their ids, as the
library does by default. Every row gives a row, repeated ones too; an empty table gives none; only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderflow.llm.storage import small_batches
from tenderflow.llm.token_counts import byte_letters, exact_pattern, odd_points, patterns
from tenderflow.llm.words import alive

#: Characters of pre-tokens after which a worker keeps only those in use; texts of a slice.
CACHE_CHARS, SLICE = 4_000_000, 256
#: Marks in the row of symbols: the end of a pre-token, and a symbol that a merge took in.
END, TAKEN = -1, -2
SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairIndex:
    """A byte-level BPE vocabulary and the merging of many pre-tokens at once."""

    def __init__(self, path: str, odd: dict[str, str]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        self.of_byte = [vocab[c] for c in letters]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {a * self.size + b: r for r, (a, b, _) in enumerate(self.rules)}
        made = {c: r for r, (_, _, c) in enumerate(self.rules)}
        ordered = len(made) == len(self.rules) and all(max(made.get(a, -1), made.get(b, -1)) < r for r, (a, b, _) in enumerate(self.rules))
        if not ordered or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("needs merges that each make a new token of older ones, and added tokens that match as they stand")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known, byte = Tokenizer.from_file(path), {c: b for b, c in enumerate(letters)}
        self.bytes_of: dict[str, bytes] = {}
        for i in range(known.get_vocab_size(with_added_tokens=True)):
            token = known.id_to_token(i) or ""
            spelled = [byte.get(c) for c in token]
            self.bytes_of[str(i)] = token.encode() if None in spelled else bytes(spelled)
        self.quick, self.has_odd = patterns(odd)
        self.exact = exact_pattern(odd)
        specials = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.split = re.compile(f"({specials})").split if specials else None

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text; added tokens stand among them."""
        cut = self.exact.findall if self.has_odd and not text.isascii() and self.has_odd.search(text) else self.quick.findall
        if self.split is None or not any(map(text.__contains__, self.added)):
            return cut(text)
        out = []
        for k, piece in enumerate(self.split(text)):
            out += [piece] if k % 2 else cut(piece)
        return out

    def merge(self, pretokens: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        row: list[int] = []
        for p in pretokens:
            row += [self.of_byte[b] for b in p.encode()]
            row.append(END)
        n, size, rank = len(row), self.size, self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(row, row[1:], strict=False)):
            if a >= 0 and b >= 0 and (r := rank.get(a * size + b)) is not None:
                places.setdefault(r, []).append(i)
        active = list(places)
        heapq.heapify(active)
        while active:
            now = heapq.heappop(active)
            left, right, made = self.rules[now]
            for i in sorted(places.pop(now)):
                j = after[i]
                if row[i] != left or row[j] != right:
                    continue
                row[i], row[j] = made, TAKEN
                after[i] = k = after[j]
                before[k] = i
                h = before[i]
                for at, a, b in ((h, row[h], made), (i, made, row[k])):
                    if a >= 0 and b >= 0 and (r := rank.get(a * size + b)) is not None:
                        if r in places:
                            places[r].append(at)
                        else:
                            places[r] = [at]
                            heapq.heappush(active, r)
        out: list[list[int]] = [[]]
        for s in row:
            if s >= 0:
                out[-1].append(s)
            elif s == END:
                out.append([])
        return out[:-1]

    def decode(self, ids: str) -> str:
        """Text of ids in decimals; broken UTF-8 gives U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


class Known(dict):
    """The ids, in decimals, of the pre-tokens a worker has met."""

    def __init__(self, index: PairIndex):
        super().__init__({t: str(i) for t, i in index.added.items()})
        self.index, self.chars = index, 0

    def coded(self, texts: list[str]) -> list[str]:
        """The ids of each text of a slice, joined by commas; its new pre-tokens are merged together."""
        cut = [self.index.pretokens(t) for t in texts]
        wanted = set().union(*cut)
        new = [t for t in wanted if t not in self]
        self.chars += sum(map(len, new))
        if self.chars > CACHE_CHARS:
            kept = {t: self[t] for t in (wanted | self.index.added.keys()) if t in self}
            self.clear()
            self.update(kept)
            self.chars = sum(map(len, self)) + sum(map(len, new))
        self.update(zip(new, [",".join(map(str, ids)) for ids in self.index.merge(new)], strict=True))
        return [",".join([self[t] for t in tokens]) for tokens in cut]


def _slices(path: str, odd: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], list[str]]]:
    """(doc_id, ids in decimals, decoded) of each slice."""
    known = alive(("pair index", path), lambda: Known(PairIndex(path, odd)))
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            ids = known.coded([x or "" for x in part.column(1).to_pylist()])
            yield part.column(0), ids, list(map(known.index.decode, ids))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, of every row of docs."""
    small_batches(docs.sparkSession)
    odd = odd_points()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, decoded in _slices(path, odd, batches):
            numbers = pa.array([list(map(int, i.split(","))) if i else [] for i in ids], pa.list_(pa.int32()))
            yield pa.record_batch([doc_id, numbers, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """What encode_decode gives, as counts and SHA-256 digests made in the same pass: no id list leaves the worker."""
    small_batches(docs.sparkSession)
    odd = odd_points()

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, decoded in _slices(path, odd, batches):
            sizes = pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64())
            yield pa.record_batch([doc_id, sizes, pa.array(list(map(sha, ids)), pa.string()), pa.array(list(map(sha, decoded)), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST_SCHEMA)
