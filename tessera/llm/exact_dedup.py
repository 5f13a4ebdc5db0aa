"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

1. One scan keeps two numbers of each text: the length of its normalised form and a hash of its first
   PREFIX_CHARS characters. Lengths that occur once are settled.
2. Among the others, pairs (length, prefix hash) that occur once are settled.
3. A second scan takes the SHA-256 of the whole text, only for rows whose pair survived. The survivors
   are recognised by fixed-size key filters, so no text is shuffled and a filter's false hit costs one hash.

Groups are counted by partial aggregation and joined back on the hash, so a text that a third of all rows
share is never in one task (the join is of the kind that adaptive execution splits).
Nulls count as empty texts. Of equal texts the smallest id stays, null ids last; among rows that repeat
an id too, exactly one stays. Very long texts are hashed whole, one at a time. An empty table gives an empty result. Columns other than id and text aren't read, and
``exact_dedup`` keeps them as they are, whatever their names.

The key filters have FILTER_WORDS words: beyond a few million surviving keys they let most rows pass, and the full hash is then taken of most rows; the
result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import flag_members, key_filter, materialise, quoted, retain

PREFIX_CHARS = 64
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """Per row of ``docs``: id, th (xxhash64 of the raw text), keep_id, group_size, kept, sha256.

    sha256 is null for rows settled before the full hash, unless ``digest_all`` asks for every digest.
    """
    base = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    body = base.select("id", F.xxhash64("text").alias("th"), normalised(F.col("text")).alias("norm"))
    level = body.select("id", "th", "norm", F.octet_length("norm").alias("length"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"))

    keys = materialise(level.select("length", "prefix"), "dedup-keys")
    lengths = keys.groupBy("length").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("length").alias("key"))
    second = flag_members(keys.withColumn("key", F.xxhash64("length")), "key", key_filter(lengths, "key"), "hit").where("hit")
    pairs = second.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("length", "prefix").alias("key"))
    filt = materialise(key_filter(pairs, "key"), "dedup-filter")

    third = flag_members(level.withColumn("key", F.xxhash64("length", "prefix")), "key", filt, "alive")
    sha = F.sha2(F.encode("norm", "UTF-8"), 256)
    hashed = third.select("id", "th", F.monotonically_increasing_id().alias("rid"), "alive", (sha if digest_all else F.when(F.col("alive"), sha)).alias("sha256"))
    hashed = materialise(hashed, "dedup-hashed")

    alive = hashed.where("alive")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("rid"))).alias("first")
    # Written, so that the join below has a plain exchange on either side and can be split where it is skewed.
    groups = materialise(alive.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1"), "dedup-groups")
    met = alive.join(groups, "sha256", "left")
    one = F.col("n").isNull()
    found = met.select(
        "id", "th",
        F.when(one, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("rid") == F.col("first.rid"))).alias("kept"),
        "sha256",
    )
    settled = hashed.where("not alive").select("id", "th", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha256")
    return settled.unionByName(found)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each distinct normalised text, all columns kept as they are."""
    groups = exact_groups(docs, id_col, text_col)
    return retain(docs, id_col, text_col, groups.select("id", "th", F.col("kept").alias("keep")))
