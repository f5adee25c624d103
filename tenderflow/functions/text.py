"""Repair, masking and reading of text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that real document text is full of.
ANCHORS = """the and not use all wall door type plan scale with shall dimension room floor
detail sheet schedule general notes frame section existing new provide contractor
architect finish equipment mounted typical above below required price list net
each series stainless steel satin mounted surface""".split()
# Fixed patterns of keys that must not be shown.
SECRETS = [
    r"sk-ant-[A-Za-z0-9\-_]{16,}",
    r"sk-or-[A-Za-z0-9\-_]{16,}",
    r"sk-[A-Za-z0-9\-_]{24,}",
    r"nvapi-[A-Za-z0-9\-_]{16,}",
    r"ABSK[A-Za-z0-9+/=]{16,}",
    r"\b(?:ASIA|AKIA)[A-Z0-9]{16}\b",
]
CONTROL_ABOVE, MOST_SHIFT = 0.05, 64


def control_ratio(text: Column) -> Column:
    """Share of control characters other than line breaks and tabs."""
    return F.when(F.length(text) == 0, 0.0).otherwise((F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))) / F.length(text))


def english_score(text: Column) -> Column:
    """Anchor words over the square root of all words of two letters or more."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), 0), F.lower)
    known = F.size(F.filter(words, lambda w: w.isin(sorted(set(ANCHORS)))))
    return F.when(F.size(words) == 0, 0.0).otherwise(known / F.sqrt(F.size(words)))


def shift_letters(shift: int) -> tuple[str, str]:
    """The characters that move by shift, and where to: printable ASCII results only, line breaks and tabs stay."""
    moved = [c for c in range(0, 127) if chr(c) not in "\n\r\t" and 32 <= c + shift < 127]
    return "".join(map(chr, moved)), "".join(chr(c + shift) for c in moved)


def shifted(text: Column, shift: int) -> Column:
    return F.translate(text, *shift_letters(shift)) if shift else text


def best_shift(text: Column) -> Column:
    """The shift whose text scores strictly best, the smallest of equals; 0 where few control characters show damage."""
    tries = F.array(*[F.struct(english_score(shifted(text, k)).alias("score"), F.lit(-k).alias("less")) for k in range(MOST_SHIFT + 1)])
    return F.when(control_ratio(text) > CONTROL_ABOVE, -F.array_max(tries)["less"]).otherwise(0)


def redacted(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[redacted]")
    return text


def kept_head(text: Column, keep: int) -> tuple[Column, Column]:
    """The first characters, and how many were left out."""
    return F.left(text, F.lit(keep)), F.greatest(F.length(text) - keep, F.lit(0)).cast("long")


def price_near(text: Column, code: Column, mark: str = "MIL", window: int = 500, reach: int = 120) -> Column:
    """The first $ price within `reach` characters of the first mark in the window that starts at the code; else null."""
    at = F.instr(text, code)
    part = F.when(at > 0, F.substr(text, at, F.lit(window)))
    tail = F.when(F.instr(part, mark) > 0, F.substr(part, F.instr(part, mark), F.lit(reach)))
    return F.nullif(F.regexp_extract(tail, r"\$(\d+\.\d+)", 1), F.lit("")).cast("double")
