"""Token counts for a byte-level BPE vocabulary with the whole-token shortcut.

Offline, the merge rules are run over every vocabulary string; those that end as one token are proven. A pre-token
that is a proven string counts one; only the rest are merged, each distinct one once per worker.

The classes of letters and numbers are the library's: code points on which it and the `regex` package differ (they
follow other versions of Unicode) are asked of it once, and texts that hold one are cut by those classes.

Defined cases: a null text counts as empty, 0 bytes and 0 tokens; the vocabulary's added special strings inside a
text count as one token each, as the tokenizers library does by default. Every row gives a row, repeated ones too; an empty
table gives none; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from tenderflow.llm.storage import small_batches
from tenderflow.llm.words import alive

#: Distinct pre-tokens a worker keeps before it starts anew.
CACHE_TOKENS = 200_000
#: Fixed pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_whole long"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@functools.cache
def odd_points() -> dict[str, str]:
    """Code points that the library puts in another class than `regex` does, as {class: characters}.

    All characters of one class in a row are one token for the library, so only where it cuts is there a difference.
    """
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    out = {"L": "", "N": "", "O": "", "S": ""}
    for kind, test in {"L": r"\p{L}+", "N": r"\p{N}+", "S": r"\s+", "O": r"[^\s\p{L}\p{N}]+"}.items():
        row = "".join(regex.findall(test, "".join(every)))
        for _, (a, b) in cut(row):
            theirs = next((k for k, x in (("L", "a"), ("N", "1"), ("O", ",")) if len(cut(x + row[a])) == 1), "S")
            if theirs != kind:
                out[theirs] += row[a:b]
    return out


def ranges(points: str) -> str:
    """The inside of a character class for code points in ascending order."""
    runs: list[list[int]] = []
    for c in map(ord, points):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join([rf"\U{a:08x}-\U{b:08x}" for a, b in runs])


def patterns(odd: dict[str, str]) -> tuple[re.Pattern, re.Pattern | None]:
    """The pattern that cuts texts, and one that finds texts for which it does not hold."""
    points = "".join(map(ranges, odd.values()))
    return regex.compile(PATTERN), re.compile(f"[{points}]") if points else None


def exact_pattern(odd: dict[str, str]) -> re.Pattern:
    """The fixed pattern with the library's classes."""
    every = "".join(map(ranges, odd.values()))
    own = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s", "O": r"[^\s\p{L}\p{N}]"}
    of = {k: f"[[{x}--[{every}]]{ranges(odd[k])}]" if every else x for k, x in own.items()}
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{of['L']}+| ?{of['N']}+| ?{of['O']}+|{of['S']}+(?!(?!{of['S']}).)|{of['S']}+", regex.DOTALL)


class Merges:
    def __init__(self, path: str, odd: dict[str, str]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.vocab = spec["model"]["vocab"]
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.letters = byte_letters()
        quick, self.has_odd = patterns(odd)
        self.find, self.find_exact = quick.findall, exact_pattern(odd).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        parts, rank = list(symbols), self.rank
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(r, i, i + 1, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, x, y = heapq.heappop(agenda)
            if after[a] != b or parts[a] != x or parts[b] != y:
                continue
            parts[a], parts[b] = x + y, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            for c, d in ((before[a], a), (a, after[a])):
                if c >= 0 and d >= 0 and (r := rank.get((parts[c], parts[d]))) is not None:
                    heapq.heappush(agenda, (r, c, d, parts[c], parts[d]))
        return [p for p in parts if p]

    def spelled(self, token: str) -> str:
        return "".join([self.letters[b] for b in token.encode()])

    def proven(self) -> frozenset[str]:
        """Vocabulary strings that the merges alone turn into one token, as pre-token texts (those that are UTF-8)."""
        byte = {c: b for b, c in enumerate(self.letters)}
        out = []
        for word in self.vocab:
            if word not in self.added and len(self.merge(list(word))) == 1:
                try:
                    out.append(bytes(byte[c] for c in word).decode())
                except UnicodeDecodeError:
                    continue
        return frozenset(out)


class Counts(dict):
    """Tokens of each pre-token: 1 for a proven string, else by merging."""

    def __init__(self, merges: Merges, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.merges, self.whole = merges, whole

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_TOKENS + len(self.whole):
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        value = self[token] = len(self.merges.merge(list(self.merges.spelled(token))))
        return value

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, pre-tokens counted by the shortcut) of a text."""
        tokens = shortcut = 0
        odd = self.merges.has_odd
        find = self.merges.find_exact if odd and not text.isascii() and odd.search(text) else self.merges.find
        pieces = self.merges.split(text) if self.merges.split else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                tokens += 1
                continue
            found = find(piece)
            tokens += sum([self[x] for x in found])
            shortcut += sum(map(self.whole.__contains__, found))
        return tokens, shortcut


_LOADED: dict[str, Merges] = {}


def load(path: str, odd: dict[str, str] | None = None) -> Merges:
    """The vocabulary at path; odd is what odd_points gives, so that workers need not ask for it."""
    if path not in _LOADED:
        _LOADED[path] = Merges(path, odd_points() if odd is None else odd)
    return _LOADED[path]


@functools.lru_cache(maxsize=2)
def prove(path: str) -> frozenset[str]:
    """The offline step; its result has at most the size of the vocabulary."""
    return load(path).proven()


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_whole (pre-tokens that the shortcut counted) of every whole text."""
    small_batches(docs.sparkSession)
    whole, odd = docs.sparkSession.sparkContext.broadcast(prove(path)), odd_points()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = alive(("token counts", path), lambda: Counts(load(path, odd), whole.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [counts.count(x or "") for x in part.column(1).to_pylist()]
                size = pc.fill_null(pc.binary_length(part.column(1)).cast(pa.int64()), 0)
                n, w = zip(*rows, strict=True)
                yield pa.record_batch([part.column(0), size, pa.array(n, pa.int64()), pa.array(w, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "n_whole"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
