"""Words of a text (ASCII lower case, split on space and \\t..\\r) and hashes of five-word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Words that match gain 1, others cost DROP_COST; a stretch ends where the sum has fallen by more than DROP.
DROP_COST, DROP = 2, 8
#: Entries after which a worker's word cache starts anew, so that memory stays bounded.
CACHE_WORDS = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: The lowest k bytes of a long.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


_ALIVE: dict[object, Any] = {}


def alive(kind: object, make: Callable[[], Any]) -> Any:
    """What a worker keeps from batch to batch. One kind at a time: a worker that serves several operators holds the memory of one."""
    if kind not in _ALIVE:
        _ALIVE.clear()
        _ALIVE[kind] = make()
    return _ALIVE[kind]


def release() -> None:
    """Lets go of what the worker keeps: for steps that need the memory themselves."""
    _ALIVE.clear()


def split_words(text: bytes | None) -> list[bytes]:
    """bytes.lower() touches A-Z only and bytes.split() cuts at 0x20 and 0x09-0x0D only."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    return x * np.uint64(0x81DADEF4BC2DD44D)


def text_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hash of each word of split_words(text), of eight bytes at a time, without making the words."""
    raw = np.frombuffer(text or b"", np.uint8)
    outside = np.ones(len(raw) + 2, bool)
    np.take(_SPACE, raw, out=outside[1:-1])
    cuts = np.flatnonzero(outside[1:] != outside[:-1])
    starts, size = cuts[::2], cuts[1::2] - cuts[::2]
    folded = np.zeros(len(raw) + 8, np.uint8)
    np.take(_LOWER, raw, out=folded[: len(raw)])
    eight = np.ndarray(len(raw) + 1, "<u8", folded, strides=(1,))
    total = mix((eight[starts] & _BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD[0])
    long, done = np.flatnonzero(size > 8), 8
    while len(long):
        left = size[long] - done
        total[long] = mix(total[long] * _ODD[1] + (eight[starts[long] + done] & _BYTES[np.minimum(left, 8)]))
        long, done = long[left > 8], done + 8
    return total


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The same of words that hold no white space."""
    return text_hashes(b" ".join(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the five words from each position on; of all words as one where there are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE:
        total = np.array([n], np.uint64)
        for k in range(n):
            total = mix(total + words[k : k + 1] * _ODD[k])
        return total
    total = words[: n - 4] * _ODD[0]
    for k in range(1, SHINGLE):
        total += words[k : n - 4 + k] * _ODD[k]
    return mix(total)


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places of the ranges that start at first."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def byte_texts(batch: pa.RecordBatch, name: str, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of an Arrow batch with a text column as UTF-8 bytes; slices keep few Python objects alive at a time."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, part.column(part.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
    pa.default_memory_pool().release_unused()


def stretch(same: np.ndarray, at: int) -> tuple[int, int]:
    """The stretch around at with the best sum of gains and costs, given up once the sum falls DROP below its best."""

    def reach(steps: np.ndarray) -> int:
        size = 256
        while True:
            total = np.cumsum(np.where(steps[:size], 1, -DROP_COST))
            fallen = np.flatnonzero(np.maximum(np.maximum.accumulate(total), 0) - total > DROP)
            if len(fallen) or size >= len(steps):
                break
            size *= 4
        total = total[: fallen[0]] if len(fallen) else total
        return int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0

    return at - reach(same[:at][::-1]), at + reach(same[at:])
