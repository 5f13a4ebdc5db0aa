"""Classifiers, rules, shards and mixes: held-out accuracy, brute force and invariants."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, quality_rules, quality_zstd, sharding, toxicity_fm
from tessera.llm.sampling import labelled_sample

from .odd import none, odd, odd_rows

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def out_of_sample(spark, scored, label):
    y = {r["doc_id"]: r[label] for r in read(spark, "labels").collect()}
    rows = scored.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    return [(y[r["id"]], r["predicted"]) for r in rows if r["held_out"] and r["id"] in y]


@tables
def test_quality_held_out(spark):
    model = quality_zstd.train(read(spark, "documents"), read(spark, "labels"))
    pairs = out_of_sample(spark, quality_zstd.scored(read(spark, "documents"), model), "quality")
    assert np.mean([a == b for a, b in pairs]) >= 0.95


@tables
def test_toxicity_held_out(spark):
    model = toxicity_fm.train(read(spark, "documents"), read(spark, "labels"))
    pairs = out_of_sample(spark, toxicity_fm.scored(read(spark, "documents"), model), "toxic")
    assert np.mean([a == b for a, b in pairs]) >= 0.93
    assert sum(b for a, b in pairs if not a) <= 1  # clean ones are left alone


def test_pairs_of_terms_are_learnt():
    """Either word alone is harmless, both together aren't: only the pairwise part can tell."""
    rng = random.Random(1)
    filler = [f"w{i}" for i in range(30)]
    texts, labels = [], []
    for i in range(1200):
        words = rng.sample(filler, 8)
        a, b = i % 2 == 0, (i // 2) % 2 == 0
        words += ["scoundrels"] * a + ["neighbours"] * b
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(a and b))
    model = toxicity_fm.Model(texts, labels)
    terms = toxicity_fm.Terms()
    score = lambda t: model.score(terms(t))
    assert score("w1 scoundrels w2 neighbours") > 0.7 and max(score("w1 scoundrels"), score("w3 neighbours"), score(""), score(None)) < 0.3


def test_words_that_say_nothing_alone_are_learnt_in_pairs():
    """The label is exactly one of two words: each alone is as common in either class."""
    rng = random.Random(2)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"f{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}x" for _ in range(12)] + ["alpha"] * a + ["omega"] * b
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(a != b))
    model, terms = toxicity_fm.Model(texts[:2400], labels[:2400]), toxicity_fm.Terms()
    assert np.mean([(model.score(terms(t)) >= 0.5) == y for t, y in zip(texts[2400:], labels[2400:])]) > 0.98


def auc(scores, labels):
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    rank = {i: k for k, i in enumerate(order, 1)}
    good = [i for i in range(len(labels)) if labels[i]]
    return (sum(rank[i] for i in good) - len(good) * (len(good) + 1) / 2) / (len(good) * (len(labels) - len(good)))


@tables
def test_the_difference_alone_ranks_and_is_calibrated(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality_zstd.scored(docs, quality_zstd.train(docs, labels)).collect() if r["held_out"] and r["id"] in y]
    assert auc([r["difference"] for r in rows], [y[r["id"]] for r in rows]) >= 0.97
    assert sorted(rows, key=lambda r: r["difference"]) == sorted(rows, key=lambda r: (r["score"], r["difference"]))
    assert abs(np.mean([r["score"] for r in rows]) - np.mean([y[r["id"]] for r in rows])) < 0.08


def test_a_sample_is_deduplicated_and_bounded_before_it_is_collected(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x" * 50), (3, "y" * 10), (4, None)], "doc_id long, text string").union(spark.range(20_000).selectExpr("5L", "'same'"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, y int")
    own = [i for i in range(1, 6) if zlib.crc32(str(i).encode()) % 3 != 1]
    texts, ys = labelled_sample(docs, labels, "y", 10)
    assert texts == [{1: "a", 2: "x" * 50, 3: "y" * 10, 4: "", 5: "same"}[i] for i in own] and ys == [i % 2 for i in own]
    assert sum(map(len, labelled_sample(docs, labels, "y", 10, max_bytes=12)[0])) <= 12


def test_classifiers_without_labels_and_over_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    for mod, label in ((quality_zstd, "quality"), (toxicity_fm, "toxic")):
        for some in (labels, labels.limit(0)):
            model = mod.train(odd(spark), some, label)
            rows = mod.scored(odd(spark), model).collect()
            assert len(rows) == len(odd_rows()) and len({r["score"] for r in rows}) == 1
        assert mod.scored(none(spark), model).collect() == []


def test_sample_leaves_held_out_rows_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 0)], "doc_id long, y int")
    texts, _ = labelled_sample(docs, labels, "y", 1000)
    assert {int(t[1:]) for t in texts} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(labelled_sample(docs, labels, "y", 7)[0]) == 7


def test_odd_texts_have_sizes():
    d = quality_zstd.dictionary(["some text " * 50, "other words " * 50])
    s = quality_zstd.Sizer((d, quality_zstd.dictionary(["nothing alike 123 " * 50])))
    assert s.difference(None) == s.difference("") == 0 and s.difference("some text " * 50_000) < 0


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(covered)


def test_rule_counts_match_a_loop(spark):
    rng = random.Random(4)
    texts = ["", None, "a", "a b c a b c", "x\nx\n \n \nx y", "# <|> é", *("".join(rng.choice("ab#é \n\t　") for _ in range(rng.randint(0, 60))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judged(df, lang_col=None).collect():
        n = slow_counts(texts[r["id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_js_distance_matches_the_definition():
    rng = np.random.default_rng(0)
    p, q = rng.dirichlet(np.ones(6), 2)
    m = (p + q) / 2
    want = np.sqrt((np.sum(p * np.log2(p / m)) + np.sum(q * np.log2(q / m))) / 2)
    assert quality_rules.js_distance(p, q) == pytest.approx(want)
    assert quality_rules.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1) and quality_rules.js_distance(p, p) == 0


@tables
def test_rules_keep_clean_documents(spark):
    docs = read(spark, "documents")
    y = {r["doc_id"]: r["quality"] for r in read(spark, "labels").collect()}
    rows = quality_rules.judged(docs).collect()
    good = [r for r in rows if y.get(r["id"]) == 1 and not r["base_failed"]]
    bad = [r for r in rows if y.get(r["id"]) == 0]
    assert sum(r["kept"] for r in good) >= 0.995 * len(good) and sum(r["kept"] for r in bad) <= 0.2 * len(bad)
    kept = {r["doc_id"] for r in quality_rules.filter_documents(docs).collect()}
    assert kept == {r["id"] for r in rows if r["kept"]}


def test_rules_over_odd_rows(spark):
    df = odd(spark)
    assert quality_rules.judged(df).count() == len(odd_rows())
    out = quality_rules.filter_documents(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert quality_rules.filter_documents(none(spark)).collect() == [] and quality_rules.judged(none(spark)).collect() == []


def check_shards(rows, texts, shards, tolerance):
    slots = defaultdict(list)
    sizes = Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if tolerance:
        assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= tolerance * sum(sizes.values()) / shards
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for t in texts)


def test_sharding(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 6) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["copy of a text"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sharding.sharded(df, 8).collect()
    check_shards(rows, texts, 8, 0.02)
    assert len({r["shard"] for r in rows if texts[r["id"]] == "copy of a text"}) == 1
    assert {(r["id"], r["shard"], r["slot"]) for r in sharding.sharded(df.repartition(2), 8).collect()} == {(r["id"], r["shard"], r["slot"]) for r in rows}


def test_pack_matches_a_plain_loop():
    rng = random.Random(12)
    for n in (0, 1, 40, 300):
        vectors = [[rng.random() ** 4 for _ in range(3)] for _ in range(n)]
        total = [sum(v[d] for v in vectors) or 1 for d in range(3)]
        vectors = [[x / t for x, t in zip(v, total)] for v in vectors]
        left = [[1 / 5] * 3 for _ in range(5)]
        want = [0] * n
        for i in sorted(range(n), key=lambda i: (-max(vectors[i]), i)):
            dots = [sum(w * x * c for w, x, c in zip(sharding.WEIGHTS, vectors[i], shard)) for shard in left]
            want[i] = max(range(5), key=lambda k: (round(dots[k], 12), -k))
            left[want[i]] = [c - x for c, x in zip(left[want[i]], vectors[i])]
        assert sharding.pack(np.array(vectors).reshape(-1, 3), np.full((5, 3), 1 / 5)).tolist() == want


def test_many_small_groups_are_placed_by_their_own_vectors(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BIN_GROUPS", 3000)
    df = spark.range(100_000).selectExpr("id doc_id", "repeat(concat(id % 977, if(id % 3 = 0, ' ', 'x'), id, ' '), cast(1 + id % 13 as int)) text")
    rows = sharding.sharded(df, 8).groupBy("shard").agg(*(F.sum(c).alias(c) for c in ("size", "tokens")), F.count(F.lit(1)).alias("n")).collect()
    for c, most in (("size", 1.001), ("tokens", 1.02), ("n", 1.02)):
        assert max(r[c] for r in rows) <= most * min(r[c] for r in rows)


def test_a_group_larger_than_a_shard_is_split(spark):
    texts = ["the one text that is everywhere " * 5] * 900 + [f"other {i} " * 5 for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_shards(sharding.sharded(df, 8).collect(), texts, 8, 0.1)


def test_a_row_stored_many_times_is_split(spark):
    """8,000 rows of one id and text beside 8,000 others: bytes within 1 %, and no part that is ranked at once holds them all."""
    same, other = "one row, stored again and again", "another text of no. {:05}"
    df = spark.range(16_000).selectExpr("if(id < 8000, 7, id) AS doc_id", f"if(id < 8000, '{same}', concat('another text of no. ', lpad(cast(id AS string), 5, '0'))) AS text").repartition(6)
    rows = sharding.sharded(df, 8).collect()
    texts = [same] * 8000 + [other.format(i) for i in range(8000, 16_000)]
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values()) / 8
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == len(texts)
    assert len({r["shard"] for r in rows if r["id"] == 7}) == 8


def test_sharding_odd_rows(spark):
    rows = sharding.sharded(odd(spark), 8).collect()
    check_shards(rows, [r[1] for r in odd_rows()], 8, None)
    assert sharding.sharded(none(spark), 8).collect() == []


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    capped = mixing.targets([100, 1, 100], [1, 2, 3])
    assert capped[1] == 3.0 and sum(capped) == pytest.approx(201) and capped[2] == pytest.approx(3 * capped[0])
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [1, 1]) == [0.0, 5.0]


def test_fit_finds_exact_sums():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 300, rng.integers(1, 40)))
        counts = rng.integers(1, 9, len(lengths))
        reach = {0}
        for n, c in zip(lengths, counts):
            reach |= {s + int(n) * k for s in reach for k in range(1, int(c) + 1)} if len(reach) < 20_000 else set()
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 1))
        take = mixing.fit(lengths.astype(np.int64), counts.astype(np.int64), budget)
        got = int((take * lengths).sum())
        assert (take >= 0).all() and (take <= counts).all() and got <= budget
        if total <= mixing.DP_BUDGET // 2 and len(reach) < 20_000:
            assert got == max(s for s in reach if s <= budget)
    assert int((mixing.fit(np.array([5, 7]), np.array([10, 10]), 38) * [5, 7]).sum()) == 38


def test_knapsack_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(80):
        lengths, counts = np.unique(rng.integers(1, 40, 6)), None
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, 150))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        out = mixing._knapsack(lengths, counts, budget)
        assert (out <= counts).all() and int((out * lengths).sum()) == max(s for s in sums if s <= budget)


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice([None, "é", "a", "b", "z"] + ["hot"] * 6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mixed(df).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    totals, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[r["id"]]
        assert r["size"] == size[r["id"]] and r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        totals[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    order = sorted((s for s in totals if s is not None)) + [None]
    assert [target[s] for s in order] == pytest.approx(mixing.targets([totals[s] for s in order], [1, 2, 3, 1, 2, 3][: len(order)]))
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert {(r["id"], r["taken"]) for r in mixing.mixed(df.repartition(2)).collect()} == {(r["id"], r["taken"]) for r in got}
    copies = Counter(r["doc_id"] for r in mixing.mix_documents(df).collect())
    assert copies == Counter({r["id"]: r["copies"] for r in got if r["copies"]})


def test_hot_sizes_are_cut_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(500)] + [(i, "a b", "t") for i in range(500, 900)], "doc_id long, text string, source string")
    got = mixing.mixed(df).collect()
    taken = Counter()
    for r in got:
        taken[r["id"] < 500] += r["taken"]
    goal = mixing.targets([1500, 800], [1, 2])
    assert abs(taken[True] - goal[0]) <= 3 and abs(taken[False] - goal[1]) <= 2


def test_a_document_that_is_stored_many_times_meets_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 300)
    once = [(10 + i, f"{'w ' * (5 + i % 40)}{i}", "sa" if i % 2 else "sb", i) for i in range(1000)]
    again = [(1, "ten words of one row that is there many times", "sc", i % 2) for i in range(4000)]
    df = spark.createDataFrame(once + again, "doc_id long, text string, source string, extra int").repartition(4)
    got = mixing.mixed(df).collect()
    assert len(got) == 5000
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = "sc" if r["id"] == 1 else "sa" if r["id"] % 2 else "sb"
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    assert sum(size.values()) == pytest.approx(sum(target.values())) and all(abs(taken[s] - target[s]) <= 10 for s in size)
    assert 0 < taken["sc"] < size["sc"]
    copies = Counter((r["doc_id"], r["extra"]) for r in mixing.mix_documents(df).collect())
    assert sum(n for (i, _), n in copies.items() if i == 1) * 10 == taken["sc"]
    assert all(copies[r["id"], r["id"] - 10] == r["copies"] for r in got if r["id"] != 1)
    assert copies == Counter((r["doc_id"], r["extra"]) for r in mixing.mix_documents(df.repartition(7)).collect())


def test_mixing_odd_rows(spark):
    df = odd(spark)
    assert len(mixing.mixed(df).collect()) == len(odd_rows())
    assert mixing.mix_documents(df).schema.simpleString() == df.schema.simpleString()
    mixing.mix_documents(df).collect()
    assert mixing.mixed(none(spark)).collect() == [] and mixing.mix_documents(none(spark)).collect() == []


def test_margin_is_the_sum_over_all_pairs():
    """The margin in linear time against bias, weights and a double loop over pairs; scores follow by the line."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.sample(words, 12)) + (" insult group" if i % 4 == 0 else rng.choice((" insult", " group", ""))) for i in range(200)]
    model = toxicity_fm.Model(texts, [int(i % 4 == 0) for i in range(200)])
    terms = toxicity_fm.Terms()
    for text in [*texts[:10], "", "unknown words only", "insult group"]:
        x = terms(text).tolist()
        slow = model.bias + sum(float(model.weight[i]) for i in x)
        slow += sum(float(model.factor[i].astype(float) @ model.factor[j].astype(float)) for n, i in enumerate(x) for j in x[n + 1 :])
        assert abs(model.margin(terms(text)) - slow) < 1e-6
        assert abs(model.score(terms(text)) - 1 / (1 + np.exp(-np.clip(model.slope * slow + model.shift, -30, 30)))) < 1e-6
    assert model.score(terms("insult group")) > model.score(terms("insult")) and model.score(terms("insult group")) > model.score(terms("group"))
    assert not toxicity_fm.Model(["a", "b"], [1, 1]).trained and not toxicity_fm.Model([], []).trained


def test_quality_score_is_recomputed_naively(spark):
    """Sizes with either dictionary, their difference for a byte, the logistic of a line in it: with plain zstandard, text by text."""
    import zstandard

    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "house", "stands", "near", "a", "river"]) for _ in range(80)) for _ in range(60)]
    bad = ["".join(rng.choice("xyzq#$% ") for _ in range(300)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id long, quality int")
    model = quality_zstd.train(docs, labels)
    got = {r["id"]: r["score"] for r in quality_zstd.scored(docs, model).collect()}
    for i, text in rows:
        raw, sizes = text.encode(), []
        for d in model.dictionaries:
            kind = zstandard.DICT_TYPE_FULLDICT if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            plain = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), level=quality_zstd.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(len(plain.compress(raw)))
        slope, shift = model.weights
        assert abs(got[i] - 1 / (1 + np.exp(-(slope * (sizes[0] - sizes[1]) / len(raw) + shift)))) < 1e-9
    again = {r["id"]: r["score"] for r in quality_zstd.scored(docs.repartition(5), model).collect()}
    assert got == again and min(got[i] for i in range(60)) > 0.5 > max(got[i] for i in range(60, 120))
