import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

FOLDER = "/root/testdata/sf0.001"
NAMES = "key rep hub label n row token count block text_a lang".split()


@pytest.fixture(scope="session")
def folder():
    if not Path(FOLDER).exists():
        pytest.skip("needs the test tables")
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def sayings():
    """Makes prose of n words from a seed."""

    def say(n: int, seed: int, kinds: int = 3000) -> list[str]:
        rng = random.Random(seed)
        return [f"w{rng.randrange(kinds)}" for _ in range(n)]

    return say


@pytest.fixture(scope="session")
def odd_docs(spark, sayings):
    """Documents with nulls, empty and very long texts, repeated rows and columns of clashing names."""
    long = " ".join(sayings(60_000, 1))
    other = " ".join(sayings(300, 2))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "ONE Two"), (6, long), (7, long + " tail"), (8, other), (8, other), (9, "日本語 のテキスト \x00 ​ ﬁ ½ <|endoftext|> ▁x"), (None, "null id here"), (10, "12345 !!! ???"), (11, "é" * 5000)]
    return spark.createDataFrame([(i, t, *["x"] * len(NAMES)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
