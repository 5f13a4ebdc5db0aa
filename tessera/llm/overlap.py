"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

Fingerprints can't find all of these: at 0.8 two texts differ in about 10 of 64 bits. So texts are candidates too that share
a band of MinHash values, and every candidate, of either kind, is checked on the whole sets of shingle hashes (XXH64). BANDS bands are
as long as leaves a pair at the threshold without a common band with a chance of MISS at most; at 0.8 these are
36 bands of 5 values, and the chance is 6e-7.

What is known of a pair before its sets are read: the sizes of both sets (at 0.8 the smaller has at least 0.8 of the larger's), and one bit of
each value (SPREAD standard deviations are left to a pair at the threshold, so it is dropped with a chance below 1e-6).

Candidates are checked in rounds, and after each of them what is tied already is left alone:

1. each text with the likeliest of its bands' pivots (a band's pivot is its text with the smallest hash of band and text, another one in each
   band), and with its neighbour by fingerprint;
2. each text with the other pivots that are not tied to it yet;
3. all pairs that share a band and are not tied yet, each pair in the first band that it shares.

The first two rounds make rows linear in the texts, and tie most of a dense heap of near copies. The last one compares what is left pair by pair,
in numbers of its sketch and then in whole sets, and makes a row only of what is similar; so no candidate that could join two components is left out. Texts are named by their hash (th). A set is read from its text again, only for texts in a pair or in the last
round, whose rows of open bands carry it. Texts without words have an empty set, which is like other empty sets alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .caches import hold
from .components import components
from .store import flag_members, key_filter, materialise

SEED = 43
MISS, SPREAD, BANDS = 1e-6, 5.0, 36
#: Shingles of one text whose minima are taken at once.
BLOCK = 256
#: Bits of a signature in one number.
WORD_BITS = 60
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def band_rows(similarity: float) -> int:
    """Values in a band: as many as leave a pair at the threshold without a common band with a chance of MISS at most."""
    return max((r for r in range(1, 17) if (1 - similarity**r) ** BANDS <= MISS), default=1)


class Sketch:
    """What is kept of a text's set of shingles: its size, a signature of one bit for each MinHash value, and its bands."""

    def __init__(self, words: int, similarity: float):
        self.words, self.rows = words, band_rows(similarity)
        self.hashes = self.rows * BANDS
        rng = np.random.default_rng(SEED)
        self.times, self.plus, self.mix = (rng.integers(0, 1 << 64, self.hashes, np.uint64) for _ in range(3))
        self.times |= np.uint64(1)
        self.mix |= np.uint64(1)
        self.numbers = -(-self.hashes // WORD_BITS)
        differ = self.hashes * (1 - similarity) / 2
        #: Bits in which signatures of a pair at the threshold may differ.
        self.most = int(np.ceil(differ + SPREAD * np.sqrt(differ * (1 + similarity) / 2)))

    def shingles(self, text: bytes | None) -> np.ndarray:
        """The distinct hashes of a text's shingles, sorted; of a shorter text, the one of all its words."""
        parts = (text or b"").translate(LOWER).split()
        runs = map(b" ".join, zip(*(parts[i:] for i in range(self.words)))) if len(parts) >= self.words else [b" ".join(parts)] if parts else []
        return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), np.uint64))

    def of(self, text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
        """(size, signature, bands); no band where there is no shingle."""
        own = self.shingles(text)
        if not len(own):
            return 0, np.zeros(self.numbers, np.int64), np.zeros(0, np.int64)
        least = np.full(self.hashes, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(own), BLOCK):
            np.minimum(least, (own[None, at : at + BLOCK] * self.times[:, None] + self.plus[:, None]).min(axis=1), out=least)
        least = (least ^ (least >> np.uint64(29))) * self.mix  # other factors in each band, so that bands don't meet each other
        bits = np.zeros(self.numbers * WORD_BITS, np.uint64)
        bits[: self.hashes] = (least >> np.uint64(40)) & np.uint64(1)
        signature = (bits.reshape(-1, WORD_BITS) << np.arange(WORD_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
        return len(own), signature, least.reshape(-1, self.rows).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sets(sketch: Sketch):
    def run(batches):
        hold("overlap")
        for batch in batches:
            own = [sketch.shingles(t.as_py()).view(np.int64) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("th"), pa.array(own, pa.list_(pa.int64()))], ["th", "own"])

    return run


def _items(named: DataFrame, texts: DataFrame, sketch: Sketch) -> DataFrame:
    """The set of each named text (th): rows (th, own), read from the texts again."""
    some = flag_members(texts, "th", key_filter(named, "th"), "hit").where("hit").select("th", "text")
    sets = some.mapInArrow(_sets(sketch), "th long, own array<long>").groupBy("th").agg(F.first("own").alias("own"))
    return materialise(sets.join(named, "th", "left_semi"), "overlap-sets")


def _alike(a: Column, b: Column, similarity: float) -> Column:
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when(both == 0, True).otherwise(common >= similarity * both)


def _checked(pairs: DataFrame, texts: DataFrame, sketch: Sketch, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of texts that are similar enough, as (u, v)."""
    pairs = materialise(pairs.select("a", "b").distinct(), "overlap-pairs")
    named = materialise(pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))).distinct(), "overlap-named")
    sets = _items(named, texts, sketch)
    left, right = (sets.select(F.col("th").alias(n), F.col("own").alias(f"own_{n}")) for n in "ab")
    met = pairs.join(left, "a").join(right, "b").where(_alike(F.col("own_a"), F.col("own_b"), similarity))
    return materialise(met.select(F.col("a").alias("u"), F.col("b").alias("v")), "overlap-links")


def _placed(rows: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the root of the text in ``column`` (the text itself where it is tied to none)."""
    own = roots.select(F.col("node").alias(column), F.col("root").alias(name))
    return rows.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def links(prints: DataFrame, texts: DataFrame, near: DataFrame, sketch: Sketch, similarity: float) -> DataFrame:
    """Links (u, v) that connect all similar texts.

    ``prints`` has rows (th, size, signature, bands), ``texts`` rows (th, text), ``near`` candidate pairs (a, b) from elsewhere.
    """
    # Only bands that at least two texts share are spread out; a key filter recognises them.
    flat = prints.select("th", F.explode("bands").alias("band"))
    shared = materialise(flat.groupBy("band").agg(F.min("th").alias("low"), F.max("th").alias("high")).where("low != high").select("band"), "overlap-shared")
    spread = flag_members(prints.select("th", "size", "signature", F.explode("bands").alias("band")), "band", key_filter(shared, "band"), "hit").where("hit")
    spread = spread.groupBy("band", "th").agg(F.first("size").alias("size"), F.first("signature").alias("signature"))
    members = materialise(spread.join(shared, "band", "left_semi"), "overlap-members")

    def likely(x: str, y: str) -> tuple[Column, Column]:
        """Whether a pair may be at the threshold, and in how many bits its signatures differ."""
        n, m = (F.col(f"{s}.size") for s in (x, y))
        bits = sum((F.bit_count(F.element_at(f"{x}.signature", i + 1).bitwiseXOR(F.element_at(f"{y}.signature", i + 1))) for i in range(sketch.numbers)), F.lit(0))
        return (F.least(n, m) >= similarity * F.greatest(n, m)) & (bits <= sketch.most), bits

    own = F.struct("th", "size", "signature")
    pivots = members.groupBy("band").agg(F.min_by(own, F.xxhash64("band", "th")).alias("x"))
    can, bits = likely("x", "y")
    star = members.select("band", own.alias("y")).join(pivots, "band").where(F.col("x.th") != F.col("y.th")).where(can)
    star = materialise(star.select(F.col("x.th").alias("a"), F.col("y.th").alias("b"), bits.alias("bits")).distinct(), "overlap-star")

    first = star.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a"))
    found = _checked(first.select("a", "b").unionByName(near), texts, sketch, similarity)
    roots = components(found)
    rest = _placed(_placed(star, roots, "a", "ra"), roots, "b", "rb").where("ra != rb")
    found = materialise(found.unionByName(_checked(rest, texts, sketch, similarity)), "overlap-found")

    placed = materialise(_placed(members, components(found), "th", "root"), "overlap-placed")
    open_ = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    placed = placed.join(open_, "band", "left_semi")
    # A pair is met in the first band that it shares, of those that are open still (a text is in BANDS at most), and its sets are there to be compared at once:
    # texts that are alike, but below the threshold, make no row.
    listed = placed.groupBy("th").agg(F.collect_list("band").alias("open"))
    listed = materialise(listed, "overlap-listed")
    placed = materialise(placed.join(listed.join(_items(listed.select("th"), texts, sketch), "th"), "th"), "overlap-open")
    x, y = (placed.select("band", *(F.col(c).alias(f"{c}_{s}") for c in ("root", "open", "own")), own.alias(s)) for s in "xy")
    once = F.array_min(F.array_intersect("open_x", "open_y")) == F.col("band")
    last = x.join(y, "band").where(F.col("root_x") < F.col("root_y")).where(can).where(once).where(_alike(F.col("own_x"), F.col("own_y"), similarity))
    return found.unionByName(last.select(F.col("x.th").alias("u"), F.col("y.th").alias("v")))
