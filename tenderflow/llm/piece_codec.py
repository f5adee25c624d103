"""SentencePiece merge-type (BPE) encoding and decoding with a score-ordered agenda of adjacent symbol pairs.

A merge never crosses a place that no piece of the vocabulary spans. Two kinds of such places are proven when the
model is read: where a space mark follows another character, and between letters or digits and
other characters, but for the few (`mixers`) that a piece joins with the other kind. Texts are cut there, and each distinct chunk is merged once per worker. The sentencepiece library checks
every Arrow slice: it encodes and decodes the chunks that are new in it, and the first text whole. The decoded text is
read back from the document's ids. `agrees` says whether both gave the same; a text with a chunk on which they differ gets the library's result.

Defined cases: a null text counts as empty; an empty text gives the end id alone and decodes to "". Every row gives a row,
repeated ones too; an empty table gives none; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.llm.storage import small_batches
from tenderflow.llm.words import alive

MARK = "▁"
#: Distinct chunks after which a worker starts a new generation; it keeps the one before, so those in use stay.
CACHE_CHUNKS = 250_000
#: Characters from which a chunk's agenda is kept in a heap; the score of a pair that is no piece.
LONG_CHUNK, NEVER = 48, float("-inf")
SCHEMA = "doc_id long, ids array<int>, decoded string, agrees boolean"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"


class Pieces:
    """A merge-type vocabulary and the agenda over it."""

    def __init__(self, model: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.ids = {self.text[i]: i for i in range(size) if i not in special and not sp.is_unused(i)}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(self.text[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = special - set(self.byte_of)
        #: Text of each id in decimals, but for byte pieces, which are read together.
        self.spelled = {str(i): "" if i in self.special else x for i, x in enumerate(self.text) if i not in self.byte_of}
        self.end = sp.eos_id()
        self.prefix = sp.normalize("a")[:-1]
        joined = {pair for p in self.ids for pair in zip(p, p[1:], strict=False) if MARK not in pair}
        across = [(a, b) for a, b in joined if a.isalnum() != b.isalnum()]
        mixers = {c for pair in across for c in pair if not c.isascii()} | {c for pair in across if "".join(pair).isascii() for c in pair}
        mix = re.escape("".join(sorted(mixers)))
        # runs of letters and digits, and runs of signs, apart; from a mixer on, all up to the next mark stays together
        tail = f"(?:[{mix}][^{MARK}]*)?" if mix else ""
        under = "" if "_" in mixers else "|_"
        parts = [rf"[^\W_{mix}]+{tail}", rf"(?:[^\w{MARK}{mix}]{under})+{tail}", *([f"[{mix}][^{MARK}]*"] if mix else [])]
        self.cut = re.compile(f"{MARK}*(?:{'|'.join(parts)})|{MARK}+").findall
        #: A sign that no piece holds: it keeps chunks apart when the library checks them.
        self.fence = next((c for c in map(chr, range(33)) if c != " " and not any(c in p for p in self.ids)), None)
        if len(self.bytes) != 256 or self.fence is None or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("needs a merge-type vocabulary with byte pieces, space marks at the front only and a control character of no piece")

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk: always merge the best-scored adjacent pair, the leftmost of equals."""
        if len(chunk) > LONG_CHUNK:
            return self._merge_long(chunk)
        get, parts = self.scores.get, list(chunk)
        agenda = [get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while agenda and (best := max(agenda)) != NEVER:
            i = agenda.index(best)
            parts[i] += parts.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                agenda[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return self._ids_of(parts)

    def _merge_long(self, chunk: str) -> list[int]:
        """The same with the agenda in a heap and linked neighbours."""
        parts, scores = list(chunk), self.scores
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (score := scores.get(joined := parts[a] + parts[b])) is not None:
                heapq.heappush(agenda, (-score, a, b, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, joined = heapq.heappop(agenda)
            if after[a] != b or not parts[a] or not parts[b] or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return self._ids_of([x for x in parts if x])

    def _ids_of(self, parts: list[str]) -> list[int]:
        out = []
        for part in parts:
            found = self.ids.get(part)
            if found is None:
                out += [self.bytes[x] for x in part.encode()]
            else:
                out.append(found)
        return out

    def chunks(self, text: str) -> list[str]:
        return self.cut((self.prefix + text).replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.merge(c)] + [self.end]

    def spell(self, ids: list[int]) -> str:
        """Text of ids with space marks; runs of byte pieces are read as UTF-8, broken bytes one by one as U+FFFD."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.text[i] for i in ids if i not in self.special])
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            while run:
                for k in range(1, min(4, len(run)) + 1):
                    try:
                        out.append(run[:k].decode())
                        del run[:k]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    del run[:1]
            if i >= 0 and i not in self.special:
                out.append(self.text[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.spell(ids).removeprefix(self.prefix).replace(MARK, " ")

    def decode_decimals(self, ids: str) -> str:
        """What decode gives for ids in decimals; without byte pieces each decimal is looked up as it stands."""
        parts = ids.split(" ")
        try:
            return "".join(map(self.spelled.__getitem__, parts)).removeprefix(self.prefix).replace(MARK, " ")
        except KeyError:
            return self.decode(list(map(int, parts)))


class Chunks(dict):
    """The ids of each chunk in decimals; `new` are those not yet checked, `wrong` those that need the library."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.old, self.new, self.wrong = pieces, {}, [], set()

    def __missing__(self, chunk: str) -> str:
        if len(self) >= CACHE_CHUNKS:
            self.old = dict(self)
            self.clear()
        value = self.old.get(chunk)
        if value is not None:
            self[chunk] = value
            return value
        ids = self.pieces.merge(chunk)
        value = self[chunk] = " ".join(map(str, ids))
        self.new.append((chunk, ids))
        return value

    def check(self) -> None:
        """Hold the new chunks against the library: the ids, and that they spell the chunk in both decoders."""
        p, new, fence = self.pieces, self.new, self.pieces.fence
        front = p.library.encode(fence)
        n = len(front)
        plain = [fence + c.replace(MARK, " ") for c, _ in new]
        sent = p.library.encode(plain, num_threads=1)
        for (c, ids), x, text, back in zip(new, sent, plain, p.library.decode(sent, num_threads=1), strict=True):
            if x[:n] != front or x[n:] != ids or back != text or p.spell(ids) != c:
                self.wrong.add(c)
        self.new = []


@functools.lru_cache(maxsize=2)
def load(model: str) -> Pieces:
    return Pieces(model)


def _chunks(model: str) -> Chunks:
    return alive(("chunks", model), lambda: Chunks(load(model)))


def _coded(model: str, texts: list[str]) -> Iterator[tuple[str, str, bool]]:
    """(ids in decimals, decoded, agrees) of each text of a slice, checked against the library."""
    pieces, known = load(model), _chunks(model)
    sp, end = pieces.library, str(pieces.end)
    cut = [pieces.chunks(text) for text in texts]
    coded = [" ".join([*[known[c] for c in chunks], end]) for chunks in cut]
    known.check()
    for k, (text, chunks, ids) in enumerate(zip(texts, cut, coded, strict=True)):
        agrees = not known.wrong or known.wrong.isdisjoint(chunks)
        if k == 0 or not agrees:
            theirs = sp.encode(text, add_eos=True)
            plain = " ".join(map(str, theirs))
            agrees = agrees and plain == ids and sp.decode(theirs) == text.replace(MARK, " ")
            if not agrees:
                yield plain, sp.decode(theirs), False
                continue
        yield ids, pieces.decode_decimals(ids), True


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part.column(0), [x or "" for x in part.column(1).to_pylist()]


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (with the end id), the decoded text, and whether the library agrees."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, texts in _slices(batches):
            rows = list(_coded(model, texts))
            ids = pa.array([[int(i) for i in r[0].split()] for r in rows], pa.list_(pa.int32()))
            yield pa.record_batch([doc_id, ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows])], ["doc_id", "ids", "decoded", "agrees"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """What encode_decode gives, as counts and SHA-256 digests made in the same pass: no id list leaves the worker."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, texts in _slices(batches):
            rows = [(ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ok) for ids, decoded, ok in _coded(model, texts)]
            n, a, b, ok = zip(*rows, strict=True)
            yield pa.record_batch([doc_id, pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(ok)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST_SCHEMA)
