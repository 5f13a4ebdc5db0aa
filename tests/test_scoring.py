"""Reward arithmetic against fixed cases and a plain Python sum of its parts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions.profiles import REFERENCE


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("x,low,high,want", [(1, 1, 2, 0), (2, 1, 2, 0), (0, 1, 2, 1), (5, 1, 2, 3), (99, None, None, 0)])
def test_range_distance(spark, x, low, high, want):
    bound = lambda v: F.lit(v).cast("int")
    assert one(spark, S.range_distance(F.lit(x), bound(low), bound(high))) == want


def test_violation_score(spark):
    assert [one(spark, S.violation_score(F.lit(float(v)))) for v in (0, 1, 3)] == [1.0, 0.0, -0.5]
    assert one(spark, S.violation_score(F.lit(10.0))) > -1


def test_rule_reward(spark):
    constraints = (1, 1, 1, 2, 4, 20, 1, 1)
    rows = [
        (0, "（点头）吾辈知道了。", "stop", constraints), (1, "", "stop", constraints), (2, "（点头吾辈知道了。", "stop", constraints), (3, "（点头）吾辈知道了。", "length", constraints),
        (4, "（点头）我知道了。", "stop", constraints), (5, "user: （点（头））<b>吾辈", "stop", constraints), (6, None, None, constraints),
    ]
    df = spark.createDataFrame(rows, f"i int, t string, f string, c {S.CONSTRAINTS}")
    got = {r["i"]: r["reward"] for r in S.rule_reward(df, "t", "c", "f", profile=REFERENCE).collect()}
    good = got[0]
    assert (good["normalized_length"], good["sentence_count"], good["signature_count"], good["action"]["count"], good["hard_invalid_reasons"]) == (10, 1, 1, 1, [])
    style = 0.4 * abs(10 - 12) / 12
    assert good["total_reward"] == pytest.approx(5 + 2 + (1 - style) / (1 + style))
    assert got[1]["hard_invalid_reasons"] == ["empty"] and got[6]["hard_invalid_reasons"] == ["empty"]
    assert got[2]["hard_invalid_reasons"] == ["unbalanced_parentheses"] and got[2]["total_reward"] == pytest.approx(-12 + 2 * (1 + 1 + 1 + 1 + 0.5) / 5)
    assert got[3]["hard_invalid_reasons"] == ["truncated"] and got[3]["total_reward"] < good["total_reward"]
    assert got[4]["wrong_self_count"] == 1 and got[4]["persona_violation"] == pytest.approx(0.8 + 0.4)
    assert got[5]["format_reasons"] == ["extra_tag", "speaker_label", "nested_parentheses"]


def test_penalties_and_caps(spark):
    assert [one(spark, S.length_penalty(F.lit(n))) for n in (100, 180, 210, 999)] == [0.0, 0.0, 0.5, 2.0]
    assert [one(spark, S.copy_penalty(F.lit(n), F.lit(c))) for n, c in ((39, 0.9), (40, 0.19), (40, 0.2), (40, 0.5))] == [0.0, 0.0, 2.0, 4.0]
    role = lambda *codes: one(spark, S.capped_role(F.lit(2), F.lit(2), F.lit(1), F.array(*map(F.lit, codes)).cast("array<string>")))
    assert (role(), role("identity_break", "romanticization"), role("romanticization"), role("wrong_self_reference")) == (5, 1, 2, 5)
    assert one(spark, S.judge_reward(F.lit(1), F.lit(5), F.lit(4), F.lit(2.0), F.lit(0.5))) == 2.0
