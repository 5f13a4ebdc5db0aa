"""Near dedup by shingle similarity against every pair."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tessera.llm import overlap, simhash

from .odd import none, odd
from .test_dedup import slow_fingerprint


def slow_shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set())


def heaps(seed):
    """Texts in families: copies of copies with some words changed, and a heap around one text."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    out = []
    for n, changes in [(4, 1), (4, 2), (4, 4), (3, 6), (30, 2), *[(3, 2)] * 12]:
        base = [word() for _ in range(rng.randint(60, 160))]
        for i in range(n):
            t = list(base)
            for _ in range(rng.randint(0, changes)):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
            if n < 30 and rng.random() < 0.5:
                base = t
    rng.shuffle(out)
    return list(dict.fromkeys(out))


def test_stage_finds_every_similar_pair(spark):
    texts = heaps(5)
    sets, prints = [slow_shingles(t) for t in texts], [slow_fingerprint(t) for t in texts]
    root, beyond, only_bits = list(range(len(texts))), 0, 0
    for i in range(len(texts)):
        for j in range(i):
            similar = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            bits = (prints[i] ^ prints[j]).bit_count()
            beyond += similar and bits > 3
            only_bits += not similar and bits <= 3
            if similar:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert beyond > 20 and only_bits and len(set(root)) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == sorted(set(root))
    groups = simhash.near_groups(docs, similarity=0.8).collect()
    assert {r["id"]: r["component_id"] for r in groups} == dict(enumerate(root))


def test_dense_heaps_around_one_text(spark):
    """Copies of one text, each near it and mostly not near each other, and a heap of texts that are all alike, but below the threshold."""
    rng = random.Random(11)
    base, other = ([f"{c}{rng.randrange(10**6)}" for _ in range(200)] for c in "ab")
    texts = [" ".join(base)]
    for i in range(150):
        t = list(base)
        for at in rng.sample(range(0, 200, 6), 3):
            t[at] = f"x{i}y{at}"
        texts.append(" ".join(t))
    for i in range(60):
        t = list(other)
        for at in rng.sample(range(0, 200, 6), 5):
            t[at] = f"z{i}y{at}"
        texts.append(" ".join(t))
    sets = [slow_shingles(t) for t in texts]
    alike = [[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets]
    assert all(alike[0][:151]) and sum(map(sum, (row[:151] for row in alike[:151]))) < 0.7 * 151**2
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike[i][j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_groups(docs, similarity=0.8).collect()
    assert {r["id"]: r["component_id"] for r in got} == dict(enumerate(root)) and len(set(root)) > 30


SKETCH = overlap.Sketch(5, 0.8)


def test_shingles_and_odd_rows(spark):
    for t in (None, "", "a B", "a b c d e F", "É é A b c d", "x " * 50):
        assert len(SKETCH.shingles(t.encode() if t is not None else None)) == len(slow_shingles(t))
    assert SKETCH.rows == 5 and 30 < SKETCH.most < 60
    docs = odd(spark)
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = simhash.near_groups(docs, similarity=0.8).collect()
    assert len(got) == docs.count() and sum(r["keep"] for r in got) >= 2
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    assert {(r["doc_id"], r["text"]) for r in kept} <= rows and len(kept) == len({r["component_id"] for r in got})
    assert corpus_pipeline.near_dedup_stage(spark, none(spark), "").count() == 0


@pytest.mark.parametrize("size", [overlap.BLOCK, 9])
def test_minima_in_blocks(monkeypatch, size):
    text = " ".join(f"v{i}" for i in range(300)).encode()
    whole = SKETCH.of(text)
    monkeypatch.setattr(overlap, "BLOCK", size)
    n, signature, bands = SKETCH.of(text)
    assert n == whole[0] == 296 and signature.tolist() == whole[1].tolist() and bands.tolist() == whole[2].tolist() and len(set(bands.tolist())) == overlap.BANDS
