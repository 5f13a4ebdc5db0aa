"""Exact dedup and SimHash near-dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, exact_dedup, simhash

from .odd import none, odd


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(spark):
    rows = odd(spark).select("doc_id", "text").collect()
    got = exact_dedup.exact_groups(odd(spark), digest_all=True).collect()
    assert len(got) == len(rows)
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(normal(r["text"]), []).append(r["doc_id"])
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept: dict[str, int] = {}
    for g in got:
        ids = by_hash[g["sha256"]]
        assert g["group_size"] == len(ids) and g["keep_id"] == min((i for i in ids if i is not None), default=None)
        kept[g["sha256"]] = kept.get(g["sha256"], 0) + g["kept"]
    assert set(kept) == set(by_hash) and set(kept.values()) == {1}


def test_full_hash_is_for_survivors_only(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "a text of a length of its own")], "doc_id long, text string")
    got = {g["id"]: g["sha256"] for g in exact_dedup.exact_groups(df).collect()}
    assert got[3] is None and got[1] == got[2] == hashlib.sha256(b"abc").hexdigest()


def test_exact_dedup_keeps_columns(spark):
    df = odd(spark)
    out = exact_dedup.exact_dedup(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted(normal(r["text"]) for r in out.collect()) == sorted({normal(r["text"]) for r in df.collect()})
    assert exact_dedup.exact_dedup(none(spark)).collect() == [] and exact_dedup.exact_groups(none(spark)).collect() == []


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "É é A", "a b c d e f g a b c", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) == whole


def test_code_is_perfect_and_covers():
    rng = np.random.default_rng(1)
    fp = rng.integers(-(1 << 62), 1 << 62, 300).astype(np.int64)
    h = simhash.home(fp)
    for first, length, _, radius in simhash.BLOCKS:
        assert (np.bitwise_count(simhash._cut(fp, first, length) ^ simhash._cut(h, first, length)) <= radius).all()
    rows, anchors = simhash.b_rows(fp)
    own = [set(anchors[rows == i].tolist()) for i in range(len(fp))]
    for i, x in enumerate(fp):
        for _ in range(40):
            bits = rng.choice(64, rng.integers(0, 3), replace=False)
            z = x ^ np.bitwise_xor.reduce(np.array([1 << int(b) for b in bits] or [0], np.uint64)).astype(np.int64)
            assert int(simhash.home(np.array([z]))[0]) in own[i]


def clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            out.add(x - (1 << 64) if x >> 63 else x)
            if rng.random() < 0.3:
                base = x
    return sorted(out)


def brute(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a = np.array(fps, np.int64)
    d = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64))
    pairs = [(i, j) for i, j in zip(*np.nonzero(d <= 3)) if i < j]
    for i, j in pairs:
        parent[find(i)] = find(j)
    return {(fps[i], fps[j]) for i, j in pairs}, [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("hot", [1, 3, simhash.HOT_ROWS])
def test_links_lose_nothing(spark, hot):
    fps = [*clustered(700, hot), -(1 << 63), 0, 1, (1 << 63) - 1, -1]
    fps = sorted(set(fps))
    pairs, roots = brute(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = [tuple(r) for r in simhash.links(df, hot).collect()]
    if hot == simhash.HOT_ROWS:
        assert {tuple(sorted(p)) for p in got} == pairs and len(got) == len(pairs)
    named = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(got, "u long, v long")).collect()}
    least: dict[int, int] = {}
    for f, r in zip(fps, roots):
        least[r] = min(least.get(r, f), f)
    assert [named.get(f, f) for f in fps] == [least[r] for r in roots]


def test_components_in_chunks(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    one = {tuple(r) for r in components.components(df).collect()}
    assert {tuple(r) for r in components.components(df, chunk_edges=25).collect()} == one
    assert (60, 0) in one and (559, 500) in one
    assert components.components(df.limit(0)).collect() == []


def test_near_groups_and_dedup(spark):
    df = odd(spark)
    got = simhash.near_groups(df).collect()
    rows = df.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    print_of = {}
    for r in rows:
        print_of.setdefault(r["doc_id"], set()).add(slow_fingerprint(r["text"]))
    assert all((g["fp"] & (1 << 64) - 1) in print_of[g["id"]] for g in got)
    by = {g["id"]: g["component_id"] for g in got}
    assert by[2] == by[3] == by[1] == 1 and by[4] == by[5] == by[7] == 4
    out = simhash.near_dedup(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert out.count() == len({g["component_id"] for g in got})
    assert simhash.near_dedup(none(spark)).collect() == []
    assert out.where(F.col("doc_id") == 8).count() == 1
