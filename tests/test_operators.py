"""Curation, evaluation, pair and contract operators on inline rows."""

from __future__ import annotations

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.functions import pandas_text as P
from tessera.functions import text as T
from tessera.functions.profiles import REFERENCE
from tessera.operators import contracts, curation, evaluation, isolation, pairs


def test_exact_dedup_keeps_the_first_spelling(spark):
    df = spark.createDataFrame([(1, " 新问题 "), (2, "新问题"), (3, "另一个问题"), (4, None), (5, None)], "pos int, t string")
    got = curation.exact_dedup(df, P.nfkc_key("t"), "pos").orderBy("pos").collect()
    assert [(r["pos"], r["t"], r["group_rows"]) for r in got] == [(1, " 新问题 ", 2), (3, "另一个问题", 1), (4, None, 2)]
    assert curation.exact_dedup(df.limit(0), P.nfkc_key("t"), "pos").count() == 0


def test_near_duplicates_and_greedy_pass_match_a_loop(spark):
    rng = random.Random(7)
    words = [rng.choice(["路灯", "公园", "散步", "今天", "朋友", "吃饭", "天气", "abc", "xyz"]) for _ in range(40)]
    texts = []
    for _ in range(90):
        base = "".join(rng.choice(words) for _ in range(rng.randint(5, 30)))
        texts.append(base)
        if rng.random() < 0.6:
            cut = list(base)
            for _ in range(rng.randint(0, 4)):
                cut[rng.randrange(len(cut))] = rng.choice("甲乙丙")
            texts.append("".join(cut))
    texts += texts[:12] + ["kurz", "kurz"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, t string")
    keys = [P.comparison_text(t) for t in texts]
    near = lambda i, j: len(keys[i]) >= 20 and len(keys[j]) >= 20 and SequenceMatcher(None, keys[i], keys[j]).ratio() >= 0.88
    want = {(i, j) for i in range(len(texts)) for j in range(i) if near(i, j)}
    edges = curation.near_duplicate_edges(df, "t", "pos")
    first = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    copies = {(i, first[k]) for i, k in enumerate(keys) if len(k) >= 20 and first[k] != i}
    between = {(i, j) for i, j in want if first[keys[i]] == i and first[keys[j]] == j}
    assert {(r["a"], r["b"], r["same"]) for r in edges.collect()} == {(*p, True) for p in copies} | {(*p, False) for p in between} and len(between) > 20 and copies
    accepted: list[int] = []
    for i in range(len(texts)):
        if not any((i, j) in want for j in accepted):
            accepted.append(i)
    got = {r["pos"] for r in curation.greedy_accept(df, edges).where("accepted").collect()}
    assert got == set(accepted)


def test_prompt_and_answer_issues(spark):
    df = spark.createDataFrame([(0, "评测目标是什么"), (1, "吾辈觉得好"), (2, "莲：你好"), (3, "莲跑了"), (4, "刚才说的那个"), (5, "你好")], "i int, t string")
    issue = curation.prompt_issue(F.col("t"), REFERENCE, "吾辈", "莲", ("觉得", "跑"), ("刚才说的那个",))
    assert [r[0] for r in df.orderBy("i").select(issue).collect()] == ["metadata_leak", "role_self_reference", "addresses_user_as_self", "third_person_user", "missing_context", None]
    rows = spark.createDataFrame([(0, " ", "stop"), (1, "a", "length"), (2, "哈哈哈哈", "stop"), (3, "a", None), (4, "ok", "stop")], "i int, t string, f string")
    assert [r[0] for r in rows.orderBy("i").select(curation.answer_issue(F.col("t"), F.col("f"))).collect()] == ["empty", "finish_reason=length", "contiguous_repetition", "finish_reason=missing", None]


def test_split_quota_and_ids(spark):
    assert curation.quota(11, 5) == [3, 2, 2, 2, 2]
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, s long")
    out = curation.stratified_split(df, "s", F.col("id"), [("a", 5), ("b", 3)], 1)
    assert {(r["s"], r["split"], r["count"]) for r in out.groupBy("s", "split").count().collect()} == {(s, x, n) for s in range(3) for x, n in (("a", 5), ("b", 3), (None, 12))}
    again = curation.stratified_split(df.repartition(3), "s", F.col("id"), [("a", 5), ("b", 3)], 1)
    assert {(r["id"], r["split"]) for r in again.collect()} == {(r["id"], r["split"]) for r in out.collect()}
    assert [r["record_id"] for r in curation.numbered(df.where("s = 0"), "dev", ["id"]).orderBy("id").collect()][:2] == ["dev_0001", "dev_0002"]


def test_summary_gate_and_grid(spark):
    rows = [(s, f"d{i}", "（点头）吾辈在。" if i else "", "stop" if i != 1 else "length") for s in (1, 2) for i in range(4)]
    df = spark.createDataFrame(rows, "seed int, id string, a string, f string")
    flags = evaluation.inspect(df, "a", "f", REFERENCE)
    got = {r["seed"]: r for r in evaluation.summarise(flags, "seed", F.col("id")).collect()}
    assert got[None]["records"] == 8 and got[1]["nonempty_count"] == 3 and got[1]["truncation_count"] == 1 and got[1]["strict_format_rate"] == 0.75
    assert got[1]["empty_ids"] == ["d0"] and got[2]["truncated_ids"] == ["d1"]
    summary = evaluation.summarise(flags)
    gate = evaluation.behaviour_gate(summary, summary, F.lit(8)).first()
    assert gate["stop_count_not_lower"] and not gate["complete_and_aligned"] and not gate["passed"]
    want = evaluation.grid_of(df.select("seed"), spark.createDataFrame([("d0",), ("d9",)], "id string"))
    issues = {(r["seed"], r["id"]): r["issue"] for r in evaluation.grid_issues(df.unionByName(df.where("id = 'd0' and seed = 1")), ["seed", "id"], want).collect()}
    assert issues[(1, "d0")] == "duplicate" and issues[(2, "d9")] == "missing" and issues[(1, "d3")] == "unexpected"
    other = df.withColumn("f", F.lit("x")).where("not (seed = 2 and id = 'd3')")
    wrong = {(r["seed"], r["id"]): r["mismatches"] for r in evaluation.alignment_issues(df, other, ["seed", "id"], ["f", "a"]).collect()}
    assert wrong[(1, "d1")] == ["f"] and wrong[(2, "d3")] == ["missing_candidate"]


def test_review_outcome(spark):
    scores = lambda v: {"generation_stability": v, "role_consistency": v, "dialogue_quality": v}
    results = [(f"r{i}", "A" if i < 6 else "tie", None, scores(8), scores(5), ["x"] if i == 0 else [], ["x"] if i == 0 else []) for i in range(10)]
    struct = "struct<generation_stability:int,role_consistency:int,dialogue_quality:int>"
    df = spark.createDataFrame(results, f"id string, winner string, clearly_worse string, scores_a {struct}, scores_b {struct}, severe_a array<string>, severe_b array<string>")
    key = spark.createDataFrame([(f"r{i}", "A") for i in range(10)], "id string, candidate_label string")
    first = evaluation.review_outcome(df, key, "id").first()
    assert (first["wins"], first["severe_pairs"], first["passed"]) == (6, 1, False)
    assert evaluation.review_outcome(df, key, "id", new_severe_only=True).first()["passed"]
    assert not evaluation.review_outcome(df.where("id != 'r9'"), key, "id", new_severe_only=True).first()["complete"]


def test_pairs(spark):
    rows = [
        ("g1", "A", "pass", 9, 1.0, False), ("g1", "B", "pass", 9, 2.0, False), ("g1", "C", "fail", 8, 5.0, False), ("g1", "D", "fail", 8, 2.5, False),
        ("g2", "A", "fail", 7, 1.0, False), ("g2", "B", "fail", 7, 3.0, False), ("g2", "C", "pass", 7, 3.0, False), ("g3", "A", "pass", 8, 0.0, True),
    ]
    df = spark.createDataFrame(rows, "g string, label string, status string, q int, r double, off boolean")
    got = {r["g"]: (r["chosen_label"], r["rejected_label"]) for r in pairs.choose_pairs(df, "g", "label", "status", "q", "r", F.col("off")).collect()}
    assert got == {"g1": ("B", "D"), "g2": (None, "B")}
    ranked = {r["label"]: r["rank_reward"] for r in pairs.tie_rewards(df.where("g = 'g1'"), "g", "q", "label").collect()}
    assert ranked == {"A": 5 * 2.5 / 3, "B": 5 * 2.5 / 3, "C": 5 * 0.5 / 3, "D": 5 * 0.5 / 3}
    texts = spark.createDataFrame([("p", 1, "c1", "x", False), ("p", 2, "c2", "x", True), ("p", 3, "c3", "x", True), ("p", 4, "c4", "y", True)], "g string, pos int, id string, t string, ok boolean")
    assert {r["id"]: r["duplicate_of"] for r in pairs.duplicate_pointer(texts, "g", F.col("t"), F.col("ok"), "pos", "id").collect()} == {"c1": None, "c2": None, "c3": "c2", "c4": None}
    seeds = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 1)], "p int, i int").select(pairs.candidate_seed(F.col("p"), F.col("i")))
    assert [r[0] for r in seeds.collect()] == [20260810, 20260811, 20260813, 20260910]


def test_contracts(spark):
    fields = (contracts.Field("id", "string"), contracts.Field("n", "int", low=0, high=10), contracts.Field("tags", "array", required=False, distinct=True), contracts.Field("ok", "bool", nullable=True))
    rows = [
        ({"id": "a", "n": 3, "ok": None}, []), ({"id": " ", "n": True, "ok": True}, ["invalid:id", "invalid:n"]), ({"id": "a", "n": 11, "ok": 1, "x": 0}, ["invalid:n", "invalid:ok", "unexpected:x"]),
        ({"n": 0, "tags": ["a", "a"], "ok": False}, ["missing:id", "invalid:tags"]), ([1], ["not_an_object"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(rows)] + [(9, "{")], "i int, raw string")
    got = [r["violations"] for r in contracts.validate(df, "raw", fields).orderBy("i").collect()]
    assert got == [w for _, w in rows] + [["not_an_object"]]
    with pytest.raises(Exception, match="contract broken"):
        contracts.validate(df, "raw", fields, mode="raise").collect()
    raws = ['{"prompts": ["a", {"user": " b "}, 3, {"user": "", "prompt": "c"}]}', '```json\n["x"]\n```', '{"data": ["y"], "prompts": []}', "no", '{"prompts": "z"}', None]
    lists = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").orderBy("i").select(contracts.prompt_list(F.col("raw"))).collect()
    assert [r[0] or [] for r in lists] == [["a", "b", "c"], ["x"], ["y"], [], [], []]
    ranks = spark.createDataFrame([('{"tiers": [["A"], ["B", "C"], ["D"]]}',), ('{"tiers": [["A"], []]}',), ('{"tiers": [["A", "A", "B", "C"]]}',), ("{}",)], "raw string")
    assert [r[0] for r in ranks.select(contracts.ranking_issue(F.col("raw"), ("A", "B", "C", "D"))).collect()] == [None, "empty_tier", "labels_incomplete", "tiers_missing"]


def test_copy_coverage_matches_a_loop(spark):
    rng = random.Random(3)
    ref = "".join(rng.choice("abcd") for _ in range(120))
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 20))) + ref[(k := rng.randint(0, 100)) : k + rng.randint(0, 20)] for _ in range(60)]

    def spec(t):
        grams = {ref[i : i + 8] for i in range(len(ref) - 7)}
        hit = [False] * len(t)
        for i in range(len(t) - 7):
            if t[i : i + 8] in grams:
                hit[i : i + 8] = [True] * 8
        return sum(hit) / len(t) if len(t) >= 8 else 0.0

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["coverage"] for r in isolation.copy_coverage(df, ["i"], "t", spark.createDataFrame([(ref,)], "r string"), "r").collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([spec(t) for t in texts])


def test_nested_users(spark):
    df = spark.createDataFrame([("u", [("system", "s"), ("user", "x"), ("user", None)])], "user string, messages array<struct<role:string,content:string>>")
    assert [r[0] for r in isolation.nested_users(df, "user", "messages").collect()] == ["u", "x"]
    assert df.select(F.size(T.ngrams(F.lit("abcd"), 3))).first()[0] == 2


def test_a_long_chain_is_decided(spark):
    edges = spark.createDataFrame([(i + 1, i, False) for i in range(12)], "a long, b long, same boolean")
    got = curation.greedy_accept(spark.range(13).withColumnRenamed("id", "pos"), edges).where("accepted").collect()
    assert {r["pos"] for r in got} == set(range(0, 13, 2))
