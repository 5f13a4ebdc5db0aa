"""SimHash near-dedup by anchor-point covering.

Fingerprints: 64 bits, by majority over the XXH64 hashes of a text's 3-word shingles.

Anchors are the words of a product code on 61 of the 64 bits: two binary Golay codes (23 bits, covering
radius 3) and a Hamming code (15 bits, covering radius 1). All three are perfect, so every point z has
exactly one home anchor within the radius of each block. Let x and y differ in 1 to 3 bits and z be x with the
lowest differing bit flipped. Then y is at most 2 bits from z, so at home(z) y exceeds the covering
radii by 2 bits in all at most. Hence

* role A: x goes to home(x ^ bit) for each of the 64 bits (about 16 anchors), with the mask of bits;
* role B: y goes to every anchor that it exceeds by 2 at most (about 153, within radius plus threshold);

and each pair meets at exactly one anchor in role order x < y: no link is lost and none is made twice.
B rows whose anchor is surely without an A row are dropped by a fixed-size sketch before the shuffle.

An anchor with more than HOT_ROWS A rows (a dense heap of near copies) is not compared pair by pair. Its rows
are dealt again to the single points z (the covering code of radius 0): whatever is within 1 of z and within
2 of z is within 3 of each other, so all of z is tied to its smallest member, in rows linear in the
heap. So the work at an anchor is at most HOT_ROWS per row, at any density.

Components are computed over distinct fingerprints, distributed; no fingerprint, link or component goes to the driver. What does is the sketch of SKETCH_BITS, once from
every task's partial union (at most SKETCH_BITS / 64 rows of 16 bytes after the aggregate: 16 MB) and once back (8 MB).

Null and empty texts and texts without words have fingerprint zero and are linked like any other; equal texts share a fingerprint, so repeated rows are in one component. Very
long texts are hashed BLOCK shingles at a time. Ties: of rows of one id the one of the smallest text hash is first; null ids come last. An empty table has no
groups. Columns other than id and text aren't read, and ``near_dedup`` keeps them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import overlap
from .caches import hold
from .components import components
from .store import materialise, quoted, retain, short_batches

SEED = 42
SHINGLE = 3
#: Shingles of one text that are hashed at once.
BLOCK = 200_000
#: A rows of an anchor beyond which its rows are dealt to single points.
HOT_ROWS = 256
#: Bits of the sketch of occupied anchors (8 MB).
SKETCH_BITS = 1 << 26
#: (first bit, length, generator polynomial, covering radius) of each block.
BLOCKS = ((0, 23, 0b110001110101, 3), (23, 23, 0b110001110101, 3), (46, 15, 0b10011, 1))


# --- fingerprints -----------------------------------------------------------------------------------


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        shingles: Iterator = iter(words)
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
        total = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        n = min(BLOCK, total - at)
        h = np.fromiter((xxhash.xxh64_intdigest(next(shingles), SEED) for _ in range(n)), np.uint64, n)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fingerprints(sketch: overlap.Sketch | None) -> Callable:
    """Rows (id, th, fp, size, signature, bands) from rows (id, th, text); without a sketch the last three are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash")
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            out = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, batch.num_rows).view(np.int64)
            size, signature, bands = zip(*(sketch.of(t.as_py()) for t in texts)) if sketch and batch.num_rows else ([None] * batch.num_rows,) * 3
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(out), pa.array(size, pa.int64()), pa.array(signature, longs), pa.array(bands, longs)], ["id", "th", "fp", "size", "signature", "bands"])

    return run


# --- the anchor code --------------------------------------------------------------------------------


def _syndromes(words: np.ndarray, length: int, poly: int) -> np.ndarray:
    """Remainders modulo the generator polynomial."""
    degree = poly.bit_length() - 1
    rest = words.astype(np.int64)
    for bit in range(length - 1, degree - 1, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (poly << (bit - degree)), rest)
    return rest


@lru_cache
def _code(length: int, poly: int, radius: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """By syndrome: the home error, and for 0, 1 and 2 bits of excess the errors that lead to a codeword, with their validity."""
    size = 1 << (poly.bit_length() - 1)
    home, errors, valid = np.zeros(size, np.int64), [], []
    for excess in range(3):
        weights = range(radius + 1) if excess == 0 else (radius + excess,)
        found: list[list[int]] = [[] for _ in range(size)]
        pats = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(length), w)], np.int64)
        for p, s in zip(pats, _syndromes(pats, length, poly)):
            found[s].append(p)
        width = max(map(len, found))
        errors.append(np.array([x + [0] * (width - len(x)) for x in found], np.int64))
        valid.append(np.array([[True] * len(x) + [False] * (width - len(x)) for x in found]))
        if excess == 0:
            home = errors[0][:, 0]
    return home, errors, valid


def _cut(fp: np.ndarray, first: int, length: int) -> np.ndarray:
    return ((fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << length) - 1)).astype(np.int64)


def home(fp: np.ndarray) -> np.ndarray:
    """The one anchor of each point within the covering radius of every block."""
    out = np.zeros(fp.shape, np.int64)
    for first, length, poly, radius in BLOCKS:
        y = _cut(fp, first, length)
        out |= (y ^ _code(length, poly, radius)[0][_syndromes(y, length, poly)]) << first
    return out


def a_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of fp, anchor, mask of the bits whose flip has that home)."""
    bits = (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64)
    anchors = home(fp[:, None] ^ bits[None, :])
    rows = np.repeat(np.arange(len(fp)), 64)
    order = np.lexsort((anchors.ravel(), rows))
    r, a, m = rows[order], anchors.ravel()[order], np.tile(bits, len(fp))[order]
    start = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (a[1:] != a[:-1])][: len(r)])
    return r[start], a[start], np.bitwise_or.reduceat(m, start) if len(start) else m


def b_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of fp, anchor) for all anchors that exceed the covering radii by 2 bits in all at most."""
    parts = []
    for first, length, poly, radius in BLOCKS:
        y = _cut(fp, first, length)
        _, errors, valid = _code(length, poly, radius)
        s = _syndromes(y, length, poly)
        parts.append([((y[:, None] ^ errors[e][s]) << first, valid[e][s]) for e in range(3)])
    rows, anchors = [], []
    for i in range(3):
        for j in range(3 - i):
            for k in range(3 - i - j):
                (a, va), (b, vb), (c, vc) = parts[0][i], parts[1][j], parts[2][k]
                ok = va[:, :, None, None] & vb[:, None, :, None] & vc[:, None, None, :]
                every = a[:, :, None, None] | b[:, None, :, None] | c[:, None, None, :]
                rows.append(np.nonzero(ok)[0])
                anchors.append(every[ok])
    return np.concatenate(rows), np.concatenate(anchors)


def _slots(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each anchor in the sketch."""
    h = anchor.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    g = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (g & np.uint64(SKETCH_BITS - 1)).astype(np.int64), ((g >> np.uint64(32)) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)


def _flat(fn: Callable, names: tuple[str, ...], step: int = 2000) -> Callable:
    """mapInArrow over a column fp, ``step`` fingerprints at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fp").to_numpy()
            for at in range(0, len(whole), step):
                fp = whole[at : at + step]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in fn(fp)], list(names))

    return run


def _role_a(fp: np.ndarray) -> tuple[np.ndarray, ...]:
    r, a, m = a_rows(fp)
    return a, fp[r], m


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketch's words (64 bits each) that a task's A rows set."""
    own = np.zeros(SKETCH_BITS >> 6, np.uint64)
    for batch in batches:
        for slot in _slots(batch.column("anchor").to_numpy()):
            np.bitwise_or.at(own, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
    word = np.flatnonzero(own)
    yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(own[word].view(np.int64))], ["word", "bits"])


def _points(anchor: np.ndarray, fp: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, z) for the points z within 1 (by mask) or 2 bits of fp whose home is the anchor."""
    bits = (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64)
    if mask is not None:
        z = fp[:, None] ^ bits[None, :]
        return (ok := np.nonzero((mask[:, None] & bits[None, :]) != 0))[0], z[ok]
    i, j = np.triu_indices(64, 1)
    z = fp[:, None] ^ np.concatenate([[0], bits, bits[i] ^ bits[j]])[None, :]
    return (ok := np.nonzero(home(z) == anchor[:, None]))[0], z[ok]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(z, fp, near) from rows (anchor, fp, mask); near: by an A row."""
    for batch in batches:
        cols = [batch.column(i) for i in range(3)]
        for at in range(0, batch.num_rows, 256):
            anchor, fp = (c.slice(at, 256).to_numpy() for c in cols[:2])
            mask = cols[2].slice(at, 256)
            is_a = mask.is_valid().to_numpy(zero_copy_only=False)
            for near in (True, False):
                own = is_a == near
                if own.any():
                    r, z = _points(anchor[own], fp[own], mask.fill_null(0).to_numpy()[own] if near else None)
                    yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(fp[own][r]), pa.array(np.full(len(z), near))], ["z", "fp", "near"])


# --- links and components ---------------------------------------------------------------------------


def links(fps: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (u, v) from distinct fingerprints (fp): every pair within 3 bits, but for hot anchors, where the rows connect what such pairs would connect."""
    spark = fps.sparkSession
    a = fps.select("fp").mapInArrow(_flat(_role_a, ("anchor", "x", "mask")), "anchor long, x long, mask long")
    a = materialise(a, "simhash-a")
    words = a.select("anchor").mapInArrow(_sketch, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = words.toArrow()
    sketch = np.zeros(SKETCH_BITS >> 6, np.int64)
    sketch[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    held = spark.sparkContext.broadcast(sketch.view(np.uint64))

    def role_b(fp: np.ndarray) -> tuple[np.ndarray, ...]:
        bits = held.value
        r, anchor = b_rows(fp)
        ok = np.ones(len(anchor), bool)
        for slot in _slots(anchor):
            ok &= (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0
        return anchor[ok], fp[r[ok]]

    b = fps.select("fp").mapInArrow(_flat(role_b, ("anchor", "y")), "anchor long, y long")

    hot = materialise(a.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("anchor"), "simhash-hot")
    some = not hot.isEmpty()
    cold_a, cold_b = (a.join(hot, "anchor", "left_anti"), b.join(hot, "anchor", "left_anti")) if some else (a, b)
    diff = F.col("x").bitwiseXOR(F.col("y"))
    least = F.lit(-(1 << 63)).cast("long")
    lowest = F.when(diff == least, least).otherwise(diff.bitwiseAND(-diff))
    met = cold_a.join(cold_b, "anchor").where((F.col("x") < F.col("y")) & (F.bit_count(diff) <= 3) & (F.col("mask").bitwiseAND(lowest) != 0))
    found = met.select(F.col("x").alias("u"), F.col("y").alias("v"))
    if not some:
        return found
    hot_a = a.join(hot, "anchor", "left_semi").select("anchor", F.col("x").alias("fp"), "mask")
    hot_b = b.join(hot, "anchor", "left_semi").select("anchor", F.col("y").alias("fp"), F.lit(None).cast("long").alias("mask"))
    at_z = materialise(hot_a.unionByName(hot_b).mapInArrow(_dealt, "z long, fp long, near boolean"), "simhash-points")
    low = at_z.groupBy("z").agg(F.min("fp").alias("low"), F.max("near").alias("near")).where("near").select("z", "low")
    tied = at_z.join(low, "z").where("fp != low").select(F.col("low").alias("u"), F.col("fp").alias("v"))
    return found.unionByName(tied.distinct())


def _near_texts(prints: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts to be checked: those that share a fingerprint with its smallest, and of each fingerprint the smallest with that of one near it."""
    least = prints.groupBy("fp").agg(F.min("th").alias("low"), F.max("th").alias("high"))
    same = prints.select("fp", "th").join(least.where("low != high"), "fp").where("th != low").select(F.col("low").alias("a"), F.col("th").alias("b"))
    one = near.groupBy("v").agg(F.min("u").alias("u"))
    named = one.join(least.select(F.col("fp").alias("u"), F.col("low").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("low").alias("b")), "v")
    return same.unionByName(named.select("a", "b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS, similarity: float | None = None, words: int = 5) -> DataFrame:
    """Per row of ``docs``: id, th (xxhash64 of the raw text), fp (signed), component_id (smallest id reachable), keep.

    Without ``similarity`` texts are linked whose fingerprints differ in 3 bits at most. With it, those whose sets of shingles of ``words`` words
    have at least that Jaccard similarity: near fingerprints are then candidates only, see ``overlap``. keep marks the row with the smallest
    (id, th) of its component, null ids last.
    """
    short_batches(docs.sparkSession, 250)
    base = docs.select(quoted(id_col).alias("id"), F.xxhash64(quoted(text_col)).alias("th"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(base.dtypes)["id"]
    sketch = overlap.Sketch(words, similarity) if similarity else None
    prints = materialise(base.mapInArrow(_fingerprints(sketch), f"id {kind}, th long, fp long, size long, signature array<long>, bands array<long>"), "simhash-prints")
    near = links(materialise(prints.select("fp").distinct(), "simhash-distinct"), hot_rows)
    node = "fp"
    if sketch:
        node = "th"
        near = overlap.links(prints, base.select("th", "text"), _near_texts(prints, near), sketch, similarity)
    roots = components(near)
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("th"))
    lows = materialise(prints.groupBy(node).agg(F.min(first).alias("low")), "simhash-lows")
    tied = roots.select(F.col("node").alias(node), "root").unionByName(roots.select(F.col("root").alias(node), "root").distinct())
    tied = materialise(tied.join(lows, node), "simhash-tied")
    least = tied.groupBy("root").agg(F.min("low").alias("component"))
    moved = tied.join(least, "root").select(node, "component")
    # Written, so that the join with all rows has a plain exchange on either side and can be split where it is skewed.
    by_node = materialise(lows.join(moved, node, "left").select(node, F.coalesce("component", "low").alias("first")), "simhash-components")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    return prints.join(by_node, node, "left").select("id", "th", "fp", F.col("first.id").alias("component_id"), kept.alias("keep"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, words: int = 5) -> DataFrame:
    """``docs`` with one row of each group, the one of the smallest id, all columns kept as they are."""
    return retain(docs, id_col, text_col, near_groups(docs, id_col, text_col, similarity=similarity, words=words).select("id", "th", "keep"))
