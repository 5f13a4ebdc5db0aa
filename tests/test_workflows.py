"""Row construction, review contracts, reports and the compositions on inline rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions.profiles import REFERENCE
from tessera.operators import reports, reviews, rows
from tessera.plans import workflows
from tessera.sources import publication


def test_rows(spark):
    df = spark.createDataFrame([("莫", ["a", "b"], [], None)], "name string, identity array<string>, facts array<string>, notes array<string>")
    text = rows.render_persona(F.col("name"), {n: F.col(n) for n in ("identity", "facts", "notes")}, "You are %s.")
    assert df.select(text).first()[0] == "You are 莫.\n\nidentity:\n- a\n- b\n\nfacts:\n- (none)"
    examples = spark.createDataFrame([(2, "u2", "a2"), (1, "u1", "a1")], "i int, user string, assistant string")
    assert rows.render_examples(examples, "i").first()[0] == "user: u1\nassistant: a1\nuser: u2\nassistant: a2"
    assert rows.render_examples(examples.limit(0), "i").first()[0] == "(no examples)"
    listed = examples.agg(F.array_sort(F.collect_list(F.struct("i", "user", "assistant"))).alias("e"))
    shots = listed.select(rows.few_shot(F.lit("s"), F.col("e"), F.lit("q"))).first()[0]
    assert [m["role"] for m in shots] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert [m["role"] for m in listed.select(rows.few_shot(None, None, F.lit("q"))).first()[0]] == ["user"]
    issue = lambda *a: spark.range(1).select(rows.preference_row_issue(F.array(*(rows.message(r, F.lit(c)) for r, c in a[:-1])), F.lit(a[-1]).cast("string"))).first()[0]
    good = (("system", "s"), ("user", "u"), ("assistant", "a"))
    assert issue(*good, "b") is None and issue(*good, "a") == "same_answers" and issue(*good, " ") == "blank_rejected" and issue(*good[::-1], "b") == "role_order"
    fixed = rows.with_constants(spark.createDataFrame([("daily",), ("odd",)], "scenario string"), "scenario", {"daily": {"goals": ["x"]}})
    assert {r["scenario"]: r["goals"] for r in fixed.collect()} == {"daily": ["x"], "odd": None}
    ids = spark.createDataFrame([("g", 1, True), ("g", 2, False), ("g", 3, True)], "g string, o int, ok boolean")
    assert [r["review_id"] for r in rows.review_ids(ids, "r-", F.col("ok"), "o", "g").orderBy("o").collect()] == ["r-01", None, "r-02"]
    assert rows.renamed_metrics(spark.createDataFrame([(1, 2)], "sft_wins int, n int"), "sft_", "dpo_").columns == ["dpo_wins", "n"]


def test_review_contracts(spark):
    good = {"identity_boundary_facts": 2, "personality_relationship": 1, "character_voice": 1, "response_effectiveness": 3, "expression_quality": 2, "violations": ["romanticization"], "reason": " ok "}
    raws = [good, {**good, "character_voice": True}, {**good, "violations": ["x"]}, {k: v for k, v in good.items() if k != "reason"}, {**good, "more": 1}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)] + [(9, "no json")], "i int, raw string").orderBy("i")
    got = [r[0] for r in df.select(reviews.judge_issues(F.col("raw"))).collect()]
    assert got == [[], ["invalid:character_voice"], ["unknown_code:x"], ["missing:reason"], ["unexpected:more"], ["not_an_object"]]
    scores = [r[0] for r in df.select(reviews.judge_scores(F.col("raw"))).collect()]
    assert scores[0]["reason"] == "ok" and scores[1:] == [None] * 5
    review = {"target_status": "pass", "non_target_quality": 8, "off_target_issues": ["a"], "evidence": "e"}
    one = spark.createDataFrame([(json.dumps(review),)], "raw string")
    assert one.select(reviews.candidate_review_issues(F.col("raw"), F.lit("b"))).first()[0] == []
    assert one.select(reviews.candidate_review_issues(F.col("raw"), F.lit("a"))).first()[0] == ["target_off_target"]
    audit = {"scores": {"s": 8}, "issues": [], "decision": "keep", "improved_assistant": "x", "final_checks": {"c": True}}
    check = lambda a, base: spark.createDataFrame([(json.dumps(a),)], "raw string").select(reviews.audit_issues(F.col("raw"), F.lit(base), ["s"], ["c"])).first()[0]
    assert check(audit, "x") == [] and check(audit, "y") == ["keep_but_changed"] and check({**audit, "decision": "rewrite"}, "x") == ["edit_but_unchanged"]
    assert check({**audit, "scores": {"s": 11}}, "x") == ["invalid:scores"] and check({**audit, "final_checks": {"c": 1}}, "x") == ["invalid:final_checks"]
    changed = reviews.frozen_issues(spark.createDataFrame([(1, 2), (2, 4)], "a int, b int"), {"b": F.col("a") + 1})
    assert [(r["a"], r["changed"]) for r in changed.collect()] == [(2, ["b"])]


def test_reports(spark):
    assert spark.range(1).select(reports.planned_steps(F.lit(62), 2, 2, 3)).first()[0] == 48
    before = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [1.0]), ("z", [1.0])], "k string, v array<float>")
    after = spark.createDataFrame([("x", [1.0, 2.5]), ("y", [1.0, 2.0])], "k string, v array<float>")
    got = {r["k"]: (r["issue"], r["changed"], r["max_abs"]) for r in reports.array_deltas(before, after, "k", "v").collect()}
    assert got["x"] == (None, 1, 0.5) and got["y"][0] == "shape" and got["z"][0] == "missing_after"
    asked = []

    def ask(n):
        asked.append(n)
        return [f"p{len(asked)}-{i}" for i in range(3)] if len(asked) != 2 else []

    assert len(reports.backfill(7, ask, lambda new, limit: new[:limit])) == 7 and asked == [12, 5, 5, 5]
    assert reports.backfill(2, lambda n: [], lambda new, limit: new) == []
    assert reports.config_issues({"a": 1, "b": True}, {"a": 1, "b": 1, "c": None}) == ["b"] and reports.failed_checks({"x": False, "y": True}) == ["x"]


def test_curation_and_publication(spark, tmp_path):
    texts = [f"问题编号{i}讨论今天的天气和晚饭要吃什么东西才比较好呢{i}" if i % 5 else f"完全不同的第{i}个话题：" + chr(0x4E00 + 37 * i) * 25 for i in range(20)] + ["完全不同的第0个话题：" + chr(0x4E00) * 25, "评测目标"]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "pos long, t string, s long")
    issue = F.when(F.col("t").contains("评测目标"), "metadata_leak")
    split, counts = workflows.curate(df, "t", "s", "pos", [("a", 1), ("b", 1)], 1, issue)
    n = {r["reason"]: r["n"] for r in counts.collect()}
    assert n["metadata_leak"] == 1 and n["exact_duplicate"] == 1 and n["near_duplicate"] >= 10
    got = split.collect()
    assert sorted(r["record_id"] for r in got) == ["a_0001", "a_0002", "b_0001", "b_0002"]
    workflows.publish_splits(spark, split, ["a", "b"], str(tmp_path / "out"))
    (a,) = publication.read_published(spark, str(tmp_path / "out"), "a")
    assert a.count() == 2


def test_split_contract(spark):
    good = spark.createDataFrame([("d_0001", "x", "u1"), ("d_0002", "y", "u2")], "id string, c string, user string")
    issues = lambda d: sorted((r["issue"], r["detail"]) for r in workflows.split_issues(d, "id", "user", "c", "d_", 2, {"x": 1, "y": 1}).collect())
    assert issues(good) == []
    bad = spark.createDataFrame([("d_0001", "x", "u 1"), ("d_0003", "x", "u  1"), ("d_0004", "z", "v")], "id string, c string, user string")
    assert issues(bad) == [("count", "3"), ("distribution", "x"), ("distribution", "y"), ("distribution", "z"), ("id", "d_0003"), ("id", "d_0004"), ("repeated_user", "d_0001")]
    found = workflows.data_issues({"a": good, "b": bad.withColumn("user", F.lit("u1 "))}, [(spark.createDataFrame([("u2",)], "t string"), "t")], "id", "user").collect()
    assert {(r["left"], r["right"], r["left_id"]) for r in found} == {("a", "b", "d_0001"), ("a", "other0", "d_0002")}


def test_preparation_and_finalisation(spark):
    c = (1, 1, 1, 2, 4, 20, 1, 1)
    answers = ["（点头）吾辈知道了。", "（点头）吾辈知道了。 ", "（摇头）吾辈不去。", "（坏"]
    df = spark.createDataFrame([("p1", i + 1, a, "stop", c, "u") for i, a in enumerate(answers)] + [("p2", 1, answers[0], "stop", c, "u")], f"prompt string, i int, raw string, f string, c {S.CONSTRAINTS}, u string")
    out = workflows.prepare_candidates(df, "prompt", "i", "raw", "f", "c", 7, profile=REFERENCE)
    got = {r["candidate_id"]: r for r in out.collect()}
    assert got["p1-c2"]["duplicate_of"] == "p1-c1" and not got["p1-c4"]["hard_valid"] and got["p2-c1"]["label"] is None
    assert sorted(r["label"] for r in got.values() if r["label"]) == ["A", "B"]
    judged = out.where("label is not null").select("prompt", "label", F.when(F.col("i") == 1, "pass").otherwise("fail").alias("status"), F.lit(8).alias("quality"), F.col("reward.total_reward").alias("reward"), F.lit(False).alias("off"))
    train, audit = workflows.finalise_pairs(out, judged, "prompt", F.lit("sys"), "u", F.col("off"))
    row = train.first()
    assert [m["content"] for m in row["messages"]] == ["sys", "u", answers[0]] and row["rejected_response"] == answers[2]
    assert {r["prompt"]: r["reason"] for r in audit.collect()} == {"p1": "pair", "p2": "not_reviewed"}


def test_rewards_by_name(spark):
    c = (1, 1, 1, 2, 4, 20, 1, 1)
    data = spark.createDataFrame([("r1", "（点头）吾辈知道了。", "stop"), ("r2", "（坏", "length")], "id string, t string, f string")
    known = spark.createDataFrame([("r1", c), ("r2", c)], f"id string, constraints {S.CONSTRAINTS}")
    got = {r["id"]: r["reward"]["total_reward"] for r in workflows.reward("rule")(data, known, "id", "t", "f", REFERENCE).collect()}
    assert got["r1"] > 0 > got["r2"]
    with pytest.raises(Exception, match="unknown record"):
        workflows.reward("rule")(data, known.where("id = 'r1'"), "id", "t", "f").collect()
    answer = {"identity_boundary_facts": 2, "personality_relationship": 2, "character_voice": 1, "response_effectiveness": 3, "expression_quality": 2, "violations": ["identity_break"], "reason": "x"}
    judge = spark.createDataFrame([("r1", json.dumps(answer))], "id string, raw string")
    rewards = {r["id"]: r["reward"] for r in workflows.reward("judge")(data, "t", "f", judge, "id", "raw").collect()}
    assert rewards == {"r1": 3.0, "r2": 0.0}
    with pytest.raises(ValueError):
        workflows.register_reward("rule")(lambda: None)


def test_comparison_and_submission(spark):
    base = spark.createDataFrame([(1, f"d{i}", "u", "（点头）吾辈在。", "stop") for i in range(10)], "seed int, id string, user string, a string, f string")
    out = workflows.compare(base, base, ["seed", "id"], "a", "f", ["user"], 1, F.col("id"), REFERENCE)
    assert out["mismatches"].count() == 0 and out["gate"].first()["passed"]
    packet = out["packet"].select("id", "candidate_label")
    dims = "struct<generation_stability:int,role_consistency:int,dialogue_quality:int>"
    schema = f"id string, winner string, clearly_worse string, scores_a {dims}, scores_b {dims}, severe_a array<string>, severe_b array<string>"
    none = spark.createDataFrame([], schema)
    assert workflows.submit_review(none, packet, packet, "id", True).first()["status"] == "awaiting_review"
    results = spark.createDataFrame([(r["id"], r["candidate_label"], None, (8, 8, 8), (8, 8, 8), [], []) for r in packet.collect()], schema)
    assert workflows.submit_review(results, packet, packet, "id", True).first()["status"] == "passed"
    assert workflows.submit_review(results, packet, packet, "id", False).first()["status"] == "failed"
    with pytest.raises(ValueError, match="missing:results"):
        workflows.submit_review(results.limit(9), packet, packet, "id", True)
    scored = S.rule_reward(base.withColumn("c", F.struct(*(F.lit(1).alias(f"{m}_{n}") for n in S.CONSTRAINT_NAMES for m in ("min", "max")))), "a", "c", "f", profile=REFERENCE)
    assert workflows.reward_not_worse(scored, scored, "reward").first()["passed"]
    rows_ = base.select(F.array(rows.message("system", F.lit("s")), rows.message("user", F.lit("u")), rows.message("assistant", F.col("a"))).alias("m"))
    assert workflows.training_row_issues(rows_, "m", REFERENCE).count() == 0
