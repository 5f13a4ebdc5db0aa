"""Places within groups of any size against a plain loop, and the size of what one task sorts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import curation, ordinals, rows


def loop(data):
    out, seen = {}, {}
    for g, k, i in sorted(data, key=lambda r: (str(r[0]), r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        out[g, k, i] = seen[g]
    return out


@pytest.mark.parametrize("range_rows", [7, 100, 10**6])
def test_ranks_within_groups(spark, range_rows):
    rng = random.Random(range_rows)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None, "c d"]), rng.randint(0, 40), i) for i in range(700)]
    df = spark.createDataFrame(data, "g string, k int, i long").repartition(5)
    got = {(r["g"], r["k"], r["i"]): r["p"] for r in ordinals.ranked(df, [F.col("k"), F.col("i")], "p", ["g"], range_rows).collect()}
    assert got == loop(data)
    over = ordinals.ranked(df, [-F.col("i")], "p", range_rows=range_rows).orderBy("p").collect()
    assert [(r["p"], r["i"]) for r in over] == [(n + 1, 699 - n) for n in range(700)]
    assert over[0].asDict().keys() == {"g", "k", "i", "p"}
    assert ordinals.ranked(df.limit(0), [F.col("k")], "p", ["g"]).collect() == []


def test_one_stratum_is_many_ranges(spark, monkeypatch):
    """One stratum with nearly all rows: no range, and no window, of more than a stated size."""
    written = []
    own = ordinals.materialise
    monkeypatch.setattr(ordinals, "materialise", lambda df, label: written.append(own(df, label)) or written[-1])
    monkeypatch.setattr(ordinals, "RANGE", 2_000)
    df = spark.range(60_000).select(F.col("id").alias("k"), F.when(F.col("id") % 100 == 0, "small").otherwise("hot").alias("s"))
    out = curation.stratified_split(df, "s", F.col("k"), [("train", 30_000), ("dev", 500)], 7)
    counts = {(r["s"], r["split"]): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert counts == {("hot", "train"): 30_000, ("hot", "dev"): 500, ("hot", None): 59_400 - 30_500, ("small", "train"): 600}
    sizes = [r["count"] for r in written[0].groupBy(F.shiftright("_no", 33)).count().collect()]
    assert len(sizes) >= 25 and max(sizes) <= 4_000
    assert out.groupBy("s").agg(F.count_distinct("split_rank").alias("n"), F.max("split_rank").alias("m"), F.count(F.lit(1)).alias("c")).where("n <> c or m <> c").count() == 0


def test_ids_by_position(spark):
    df = spark.createDataFrame([(i, "g" if i else "h", f"x_{i:04d}", i % 3 != 1) for i in range(12)], "o int, g string, ident string, ok boolean")
    ids = {r["o"]: r["record_id"] for r in curation.numbered(df, "r", ["o"]).collect()}
    assert ids == {i: f"r_{i + 1:04d}" for i in range(12)}
    off = rows.contiguous_issues(df, "ident", "x_", "o", "g").collect()
    assert [(r["o"], r["expected_id"]) for r in off] == [(0, "x_0001")]
    named = {r["o"]: r["review_id"] for r in rows.review_ids(df, "v", F.col("ok"), "o", "g").collect()}
    assert named[1] is None and named[0] == "v01" and named[2] == "v01" and named[3] == "v02"
