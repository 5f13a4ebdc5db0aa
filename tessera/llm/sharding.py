"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

The units are groups of equal texts, which share a shard. Each is placed by its own vector of shares of the total, in
descending order of the largest, where the dot product of the vector with the shard's residual capacity is highest.

1. Groups that hold more than 1/LARGE of the bytes, tokens or rows (at most 3 x LARGE of those exist) are placed first, together, on the driver. A
   group that is larger than a shard's whole share is split by a hash of its ids, since it can't be balanced whole; rows of a large group that repeat an id are salted by their places
   in a written table, so they are split like others.
2. All other groups are dealt by their digest into bins of about BIN_GROUPS, packed apart and in parallel. A bin has its part, by rows, of every
   shard's capacity that is left after step 1, so that all bins together fill it. A group is below 1/LARGE of the total, so
   a bin of many misses its capacities by less than its last, smallest groups have.

So the driver gets at most 3 x LARGE vectors and a task about BIN_GROUPS at a time, whatever the input; groups are counted by partial aggregates, and no text is
shuffled. Slots number the rows of a shard from 0 without gaps: rows are ranked within (shard, part of ids) and
shifted by the counts of the parts before, so no task holds a shard, however often one row is stored.

Null texts have size 1 (their bytes plus 1), crc32 0 and no tokens; they and empty texts are one group. Ties in order go by digest, in capacity to the
lowest shard. Repeated rows are rows of their group like any other. Very long texts are read once, for their digest. An empty table gives no rows; columns other than id and
text aren't read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .mixing import size_of
from .store import materialise, quoted

LARGE = 4096
#: Groups that are packed at once, on average.
BIN_GROUPS = 20_000
#: Weights of bytes, tokens and rows: bytes are to be equal first.
WEIGHTS = (8.0, 1.0, 1.0)
#: Pieces of an over-large group, for each shard's share that it holds.
PIECES = 32
#: Rows of one part of a shard that one task ranks, on average.
PART_ROWS = 20_000
DIMS = ("bytes", "tokens", "rows")


def pack(vectors: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The shard of each vector by the highest dot product with residual capacity, the dimensions weighed by WEIGHTS; ``left`` (shards x dimensions) is what remains afterwards."""
    place = np.zeros(len(vectors), np.int64)
    weighed = vectors * np.array(WEIGHTS[: vectors.shape[1]])
    for i in np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1))).tolist():
        place[i] = k = int((left @ weighed[i]).argmax())
        left[k] -= vectors[i]
    return place


def _piece(pieces: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), "id", "salt"), pieces)


def _salted(narrow: DataFrame, digests: list[bytes]) -> DataFrame:
    """``narrow`` with ``salt``: the row's number where a row of one of the large groups repeats an id, else null, which no hash feels."""
    large = narrow.sparkSession.createDataFrame([(bytearray(d),) for d in digests], "digest binary")  # at most 3 x LARGE
    plain = narrow.join(F.broadcast(large), "digest", "left_anti").withColumn("salt", F.lit(None).cast("long"))
    rows = narrow.join(F.broadcast(large), "digest", "left_semi")
    # Written, so that the join has a plain exchange on either side and can be split where it is skewed.
    again = materialise(rows.groupBy(F.xxhash64("digest", "id").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-again")
    salted = rows.withColumn("key", F.xxhash64("digest", "id")).join(again, "key", "left").withColumn("salt", F.when(F.col("n") > 1, F.col("rid")))
    return plain.unionByName(salted.select(*plain.columns))


def _piece_shares(narrow: DataFrame, pieces: dict[bytes, int]) -> dict[bytes, list[float]]:
    """What share of a group's rows each of its pieces has, for the few groups (fewer than three to a shard) that are split."""
    if not pieces:
        return {}
    split = narrow.sparkSession.createDataFrame([(bytearray(d), n) for d, n in pieces.items()], "digest binary, pieces long")
    counts = narrow.join(F.broadcast(split), "digest").groupBy("digest", _piece(F.col("pieces")).alias("piece")).agg(F.count(F.lit(1)).alias("n")).collect()
    found = {d: [0.0] * n for d, n in pieces.items()}
    for r in counts:
        found[bytes(r["digest"])][r["piece"]] = float(r["n"])
    return {d: [x / sum(n) for x in n] for d, n in found.items()}


def _packed(total: np.ndarray, left: np.ndarray):
    """Places the groups of a bin: rows (digest, bin_shard)."""
    rest = np.maximum(left.sum(0), 1e-12)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("digest", kind="stable")
        vectors = group[list(DIMS)].to_numpy(float) / total
        # The bin's part of what is left of every shard, in each dimension.
        capacity = left / rest * vectors.sum(0)
        return pd.DataFrame({"digest": group["digest"], "bin_shard": pack(vectors, capacity)})

    return run


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, size, text_crc32, tokens, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        quoted(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        size_of(text).alias("tokens"),
        F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("digest"),
    )
    narrow = materialise(narrow.withColumn("rid", F.monotonically_increasing_id()), "shard-narrow")
    groups = materialise(narrow.groupBy("digest").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    totals = groups.agg(*(F.sum(c).alias(c) for c in DIMS), F.count(F.lit(1)).alias("groups")).first()
    total = np.array([max(float(totals[c] or 0), 1.0) for c in DIMS])

    share = F.greatest(*(F.col(c) / F.lit(float(t)) for c, t in zip(DIMS, total)))
    found = groups.where(share > 1 / LARGE).collect()  # at most 3 x LARGE
    large = {bytes(r["digest"]): np.array([float(r[c]) for c in DIMS]) / total for r in sorted(found, key=lambda r: bytes(r["digest"]))}
    pieces = {d: 1 if v.max() <= 1 / shards else int(np.ceil(v.max() * shards * PIECES)) for d, v in large.items()}
    narrow = _salted(narrow, list(large))
    shares = {d: [1.0] for d in pieces} | _piece_shares(narrow, {d: n for d, n in pieces.items() if n > 1})
    units = [(d, large[d] * s) for d in pieces for s in shares[d]]
    left = np.full((shards, len(DIMS)), 1.0 / shards)
    by_group: dict[bytes, list[int]] = {}
    for (d, _), k in zip(units, pack(np.array([v for _, v in units]).reshape(-1, len(DIMS)), left)):
        by_group.setdefault(d, []).append(int(k))
    larges = spark.createDataFrame([(bytearray(d), ks) for d, ks in by_group.items()], "digest binary, group_shards array<int>")

    bins = max(1, -(-int(totals["groups"]) // BIN_GROUPS))
    small = groups.where(share <= 1 / LARGE).withColumn("bin", F.pmod(F.xxhash64("digest"), F.lit(bins)))
    placed = small.groupBy("bin").applyInPandas(_packed(total, np.maximum(left, 0)), "digest binary, bin_shard int")
    # Written, so that the join with all rows has a plain exchange on either side and can be split where it is skewed.
    placed = materialise(placed, "shard-placed")

    dealt = narrow.join(F.broadcast(larges), "digest", "left")
    piece = F.element_at("group_shards", (_piece(F.size("group_shards")) + 1).cast("int"))
    own = dealt.where("group_shards is not null").withColumn("shard", piece)
    other = dealt.where("group_shards is null").join(placed, "digest").withColumn("shard", F.col("bin_shard"))
    columns = ["id", "rid", "salt", "size", "text_crc32", "tokens", "shard"]
    n_parts = max(64, -(-int(total[2]) // (PART_ROWS * shards)))
    dealt = own.select(*columns).unionByName(other.select(*columns)).withColumn("part", F.pmod(F.xxhash64("id", "text_crc32", "salt"), F.lit(n_parts)))
    dealt = materialise(dealt, "shard-dealt")
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    offsets = counts.select("shard", "part", before.alias("before"))
    place_in = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "rid")) - 1
    return dealt.withColumn("place", place_in).join(offsets, ["shard", "part"]).select("id", "size", "text_crc32", "tokens", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"))
