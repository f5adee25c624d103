"""Plain models of the operators, written for small inputs."""

import zlib


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_classes(docs: dict[int, str | None]) -> dict[int, int]:
    """Smallest doc_id that each document reaches over links of similarity 0.75, all pairs looked at."""
    sets, root = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: find(i) for i in ids}


def repeated_words(docs: dict[int, str | None], n: int = 50) -> dict[int, set[int]]:
    """Word places of each document that lie in n words in a row which a smaller doc_id holds too."""
    first: dict[tuple, int] = {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out: dict[int, set[int]] = {}
    for i in docs:
        w = words(docs[i])
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                out.setdefault(i, set()).update(range(k, k + n))
    return out
