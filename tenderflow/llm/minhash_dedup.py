"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct five-word shingles (all its words as one where there are fewer). Of HASHES
minima, groups of ROWS make band keys that find candidates, and the low BITS of each are packed into eight longs.
The packed signatures of two candidates give the collision-corrected similarity

    (matching share - 2**-BITS) / (1 - 2**-BITS)

by XOR and bit counts; pairs far below the wanted similarity are left, all others are confirmed on their full
sets. At similarity 0.75 the bands miss a pair with chance 5e-6, and the estimate drops one with chance 3e-7.

No group is expanded into pairs. Equal sets fall together first. Then every document of a bucket is held against
the bucket's smallest document alone; the confirmed links give provisional components. What is left are pairs
within a bucket whose components differ: STARS rounds take two more pivots in each bucket, and a last round compares all
pairs that still differ, so no link between components is lost. These rounds screen with FINE more minima, of which
one bit each is kept, made only for documents of such buckets: their estimate is sharp enough (standard deviation
0.015) that few pairs below the wanted similarity reach the full sets, and only pairs that pass leave the join. A
bucket of more than SALT such documents is dealt over tasks. Groups of equal sets with more than a WHOLE-th of all
documents are joined by broadcast, as there are fewer than WHOLE of them.

Defined cases: documents without words have an empty set, n_shingles 0 and are linked with nothing; rows that
share a doc_id are one document in the links; a null doc_id is linked with nothing and kept; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.llm.components import components
from tenderflow.llm.storage import semi_join_ids, small_batches, written
from tenderflow.llm.words import byte_texts, mix, release, shingle_hashes, text_hashes

HASHES, ROWS, BITS = 128, 4, 4
BANDS, PACKED = HASHES // ROWS, HASHES * BITS // 64
#: Similarity in per cent of a link, and estimated similarity from which a pair is confirmed on full sets.
PERCENT, SCREEN = 75, 0.55
STARS = 1
#: Documents of a bucket that one task takes; most broadcast groups of equal sets, and fewest documents of one.
SALT, WHOLE, FEW = 4_000, 500_000, 1_000
#: Minima of the last round's one-bit signatures; five standard deviations below the wanted similarity are let pass.
FINE = 2_048
#: Signature slots that may differ for the corrected estimate to reach SCREEN.
MOST_DIFFERENT = int(HASHES * (1 - SCREEN) * (1 - 2.0**-BITS))
SCHEMA = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(PACKED))
_MISS = (1 - PERCENT / 100) / 2
FINE_DIFFERENT = int(FINE * _MISS + 5 * (FINE * _MISS * (1 - _MISS)) ** 0.5)
FINE_WORDS = [f"f{i}" for i in range(FINE // 64)]
_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_ODD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_FINE_XOR = _RNG.integers(0, 2**32, FINE, dtype=np.uint32)
_FINE_ODD = _RNG.integers(0, 2**32, FINE, dtype=np.uint32) | np.uint32(1)
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_SHIFT = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :]


def minima(distinct: np.ndarray, xor: np.ndarray = _XOR, odd: np.ndarray = _ODD) -> np.ndarray:
    """The minima of a set of 64-bit shingle hashes under each function."""
    x = (distinct >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    step = max(64, 2**19 // len(xor))
    for at in range(0, len(x), step):
        np.minimum(out, ((x[at : at + step, None] ^ xor) * odd).min(0), out=out)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    key = _SALT.copy()
    for column in mins.reshape(BANDS, ROWS).T:
        key = mix(key + column.astype(np.uint64))
    return key.view(np.int64)


def pack(mins: np.ndarray) -> np.ndarray:
    low = (mins & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(PACKED, -1)
    return np.bitwise_or.reduce(low << _SHIFT, axis=1).view(np.int64)


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(text_hashes(text)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    names = ["doc_id", "n_shingles", "h1", "h2", "bands", *(f"s{i}" for i in range(PACKED))]
    for batch in batches:
        for part, texts in byte_texts(batch, "text"):
            sizes, whole, keys, packed = [], [], [], []
            for text in texts:
                found = shingle_set(text)
                sizes.append(len(found))
                if not len(found):
                    whole.append((None, None))
                    keys.append([])
                    packed.append([None] * PACKED)
                    continue
                digest = xxhash.xxh3_128_digest(found.tobytes())
                whole.append(tuple(np.frombuffer(digest, np.int64).tolist()))
                mins = minima(found)
                keys.append(band_keys(mins))
                packed.append(pack(mins).tolist())
            h1, h2 = zip(*whole, strict=True)
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch(columns + [pa.array(c, pa.int64()) for c in zip(*packed, strict=True)], names)


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for part, texts in byte_texts(batch, "text"):
            bits = [np.packbits((minima(shingle_set(t), _FINE_XOR, _FINE_ODD) & np.uint32(1)).astype(np.uint8)).view(np.int64) for t in texts]
            yield pa.record_batch([part.column(0), *[pa.array(c, pa.int64()) for c in np.array(bits).reshape(-1, FINE // 64).T]], ["rep", *FINE_WORDS])


def _fine_different(a: str, b: str) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in FINE_WORDS])


def _different(a: str, b: str) -> Column:
    """Signature slots that differ, by XOR, folding each slot onto its lowest bit, and bit counts."""
    total = F.lit(0)
    for i in range(PACKED):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        for k in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _may_link(a: str, b: str, fine: bool = False) -> Column:
    small, large = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    alike = _fine_different(a, b) <= FINE_DIFFERENT if fine else _different(a, b) <= MOST_DIFFERENT
    return (small * 100 >= large * PERCENT) & alike


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in batches:
        for part, left in byte_texts(batch, "text_a", 128):
            right = part.column(part.schema.get_field_index("text_b")).cast(pa.binary()).to_pylist()
            keep = []
            for x, y in zip(left, right, strict=True):
                if last[0] != y:
                    last = (y, shingle_set(y))
                a, b = shingle_set(x), last[1]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(bool(100 * both >= PERCENT * (len(a) + len(b) - both)))
            yield pa.record_batch([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep))


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough, as a written table."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = semi_join_ids(docs.select("doc_id", "text"), ids, "doc_id")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return written(rows.mapInArrow(_linked, "a long, b long"), "links")


def _pairs(found: DataFrame, a: str, b: str) -> DataFrame:
    return found.select(F.least(f"{a}.rep", f"{b}.rep").alias("a"), F.greatest(f"{a}.rep", f"{b}.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(docs.mapInArrow(_signatures, SCHEMA), "signatures")
    usable = rows.where("h1 IS NOT NULL AND doc_id IS NOT NULL")
    groups = written(usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "groups")
    packed = [f"s{i}" for i in range(PACKED)]
    own = groups.select("rep", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    nodes = written(usable.join(own, F.col("doc_id") == F.col("rep")).where("h1 = g1 AND h2 = g2").select("rep", F.col("n_shingles").alias("n"), "bands", *packed), "nodes")
    sig, bands = nodes.select("rep", "n", *packed), nodes.select("rep", "bands")

    keys = nodes.select("rep", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").select("key", "hub")
    shared = written(keys.join(hubs, "key").select("key", "rep", "hub"), "buckets")

    star = shared.where("rep <> hub").select("rep", "hub").distinct().alias("p")
    star = star.join(sig.alias("x"), F.col("p.rep") == F.col("x.rep")).join(sig.alias("y"), F.col("p.hub") == F.col("y.rep")).where(_may_link("x", "y"))
    best = star.groupBy(F.col("x.rep").alias("a")).agg(F.min_by("y.rep", F.struct(_different("x", "y"), F.col("y.rep"))).alias("b"))
    links = confirm(best, docs)
    labels = components(links)

    screen = None
    for last_round in [False] * STARS + [True]:
        known = labels.select(F.col("node").alias("rep"), "label")
        member = shared.join(known, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
        member = written(member.join(hub, "hub", "left").withColumn("hub_label", F.coalesce("hub_label", "hub")), "members")
        minor = member.where("label <> hub_label")
        open_keys = minor.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("pivot2"))
        left = minor if last_round else minor.join(open_keys, "key").where("rep = pivot OR rep = pivot2")
        right = member.join(open_keys.select("key"), "key", "left_semi").select("key", "rep", "label", "hub_label")
        if screen is None:
            # the keys still open later are among these
            ids = written(right.select(F.col("rep").alias("doc_id")).distinct(), "ids")
            screen = written(semi_join_ids(docs, ids, "doc_id").mapInArrow(_fine, "rep long, " + ", ".join(f"{w} long" for w in FINE_WORDS)), "fine")
            screen = screen.join(sig.select("rep", "n"), "rep").join(bands, "rep")
        parts = left.groupBy("key").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
        left = left.select("key", "rep", "label").join(parts, "key").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts").join(screen, "rep")
        right = right.join(parts, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").join(screen, "rep")
        same_key = (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt"))
        once = (F.col("y.label") == F.col("y.hub_label")) | (F.col("x.rep") < F.col("y.rep")) if last_round else F.lit(True)
        # of the buckets that two documents share, only the first brings their pair up
        first = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True) == F.array_position("x.bands", F.col("x.key")) if last_round else F.lit(True)
        found = left.alias("x").join(right.alias("y"), same_key & (F.col("x.label") != F.col("y.label")) & once & _may_link("x", "y", True) & first)
        more = confirm(_pairs(found, "x", "y"), docs)
        if more.isEmpty():
            if last_round:
                break
            continue
        links = links.union(more)
        labels = components(links)

    final = labels.select(F.col("node").alias("rep"), "label")
    found = written(groups.join(final, "rep", "left").select("h1", "h2", "copies", F.coalesce("label", "rep").alias("component")), "classes")
    large = F.col("copies") > max(FEW, rows.count() // WHOLE)
    many, few = F.broadcast(found.where(large).drop("copies")), found.where(~large).drop("copies")
    rows = rows.select("doc_id", "n_shingles", "h1", "h2")
    out = rows.join(many, ["h1", "h2"]).unionByName(rows.join(many, ["h1", "h2"], "left_anti").join(few, ["h1", "h2"], "left"))
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
