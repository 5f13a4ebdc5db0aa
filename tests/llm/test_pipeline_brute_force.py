"""corpus_pipeline.run() against a plain Python version of its five stages on the smallest documents."""

from __future__ import annotations

import math
import os
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from tessera.llm import quality_rules, registry

from .test_models import slow_counts
from .test_overlap import slow_shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
SPACE = "\t\n\x0b\x0c\r "


def classes(text):
    out = Counter()
    for c in text:
        kind = (
            "other" if ord(c) > 127 else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "space" if c in " \t" else "line" if c in SPACE
            else "stop" if c in ".,;:?'\"-()" else "bang" if c == "!" else "control" if ord(c) < 32 or ord(c) == 127 else "symbol"
        )
        out[kind] += 1
    return [out[k] for k in quality_rules.CLASSES]


def plain(text):
    words = [w.strip(".,;:!?\"'()").lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [w if w.isalpha() else "" for w in words]


def share(counts):
    return [c / max(sum(counts), 1) for c in counts]


def distance(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(total / 2, 0))


def middle(values):
    values = sorted(values)
    return values[(len(values) - 1) // 2]


def step(d):
    return math.ceil(d * 1000 - 1e-6)


def rules(docs):
    failed = {}
    for d in docs:
        n = slow_counts(d["text"])
        failed[d["doc_id"]] = n[0] < 50 or 100 * n[4] > 50 * n[0]
    words = defaultdict(list)
    for d in docs:
        words[d["lang"]] += plain(d["text"])
    common = {lang: sorted(w for w, n in Counter(own).items() if w and 250 * n >= len(own)) for lang, own in words.items()}

    def histograms(d):
        own = Counter(plain(d["text"]))
        counts = [own[w] for w in common[d["lang"]]]
        return share(classes(d["text"] or "")), share([*counts, sum(own.values()) - sum(counts)])

    shares = {d["doc_id"]: histograms(d) for d in docs}
    size = lambda d, test: (len(d["text"]) if test == 0 else len(plain(d["text"]))).bit_length() - 1
    kept = {d["doc_id"] for d in docs if not failed[d["doc_id"]]}
    tested = 0
    for lang in common:
        good = [d for d in docs if d["lang"] == lang and not failed[d["doc_id"]]]
        if len(good) < 20:
            continue
        for test, least in ((0, 200), (1, 50)):
            of = {d["doc_id"]: shares[d["doc_id"]][test] for d in docs if d["lang"] == lang}
            inside = good
            for _ in range(3):
                ref = share([sum(x) / len(inside) for x in zip(*(of[d["doc_id"]] for d in inside))])
                half = middle(step(distance(of[d["doc_id"]], ref)) for d in good)
                inside = [d for d in good if step(distance(of[d["doc_id"]], ref)) <= half]
            limits = {}
            for k in {size(d, test) for d in good}:
                steps = [step(distance(of[d["doc_id"]], ref)) for d in good if size(d, test) == k]
                if len(steps) >= 20:
                    m = middle(steps)
                    limits[k] = (m + 6 * middle(abs(x - m) for x in steps)) / 1000 + 0.1
            for d in good:
                n = len(d["text"]) if test == 0 else len(plain(d["text"]))
                if n >= least and limits:
                    tested += 1
                    limit = limits[max((k for k in limits if k <= size(d, test)), default=min(limits))]
                    if distance(of[d["doc_id"]], ref) > limit:
                        kept.discard(d["doc_id"])
    assert tested > 100
    return [d for d in docs if d["doc_id"] in kept]


def first_of_equal(docs):
    seen, kept = set(), []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", d["text"])
        if key not in seen:
            seen.add(key)
            kept.append(d)
    return kept


def first_of_near(docs):
    sets = [slow_shingles(d["text"]) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [d for i, d in enumerate(docs) if find(i) == i]


def signed_hash(data, seed):
    return xxhash.xxh64_intdigest(data, seed % (1 << 64))


def selected(docs, taken):
    """What the mix takes: whole copies, and of each source and size the rows of the smallest hash, as many as ``taken`` has; their sum is the best that counts allow."""
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append(d)
    size = {d["doc_id"]: len(d["text"].split()) for d in docs}
    total = {s: sum(size[d["doc_id"]] for d in by[s]) for s in by}
    goal, open_, left = {}, sorted(by), sum(total.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(open_)}
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 3 * total[s]]
        goal |= {s: 3 * total[s] for s in over} if over else part
        left -= sum(3 * total[s] for s in over)
        open_ = [s for s in open_ if s in over] and [s for s in open_ if s not in over]
    out = Counter()
    for s in by:
        repeats = min(int(goal[s] // total[s]), 3)
        budget = round(goal[s]) - repeats * total[s] if repeats < 3 else 0
        reach = 1
        for d in by[s]:
            reach |= reach << size[d["doc_id"]]
        best = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
        groups = defaultdict(list)
        for d in by[s]:
            groups[size[d["doc_id"]]].append(d)
        got = 0
        for n, own in groups.items():
            k = sum(taken[d["doc_id"]] - repeats for d in own)
            got += n * k

            def key(d):
                h = signed_hash(struct.pack("<i", 42), 42)
                h = signed_hash(struct.pack("<q", d["doc_id"]), h)
                h = signed_hash(struct.pack("<Q", signed_hash(d["text"].encode(), 42)), h)
                return h - (1 << 64) if h >> 63 else h

            for i, d in enumerate(sorted(own, key=key)):
                out[d["doc_id"]] += repeats + (i < k)
        assert got == best
    return +out


def test_run_matches_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = first_of_near(first_of_equal(rules(docs)))
    rows = corpus_pipeline.run(spark, SF).collect()
    taken = Counter(r["doc_id"] for r in rows)
    assert set(taken) <= {d["doc_id"] for d in kept} and 0 < len(kept) < len(docs)
    assert taken == selected(kept, taken)
    lib = SentencePieceProcessor(model_file=registry.tokenizer_file("piece_bpe_32k.model"))
    text = {d["doc_id"]: d["text"] for d in docs}
    for r in rows:
        assert r["ids"] == lib.encode(text[r["doc_id"]]) and r["decoded"] == text[r["doc_id"]]
