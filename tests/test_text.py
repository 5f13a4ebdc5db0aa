"""Text rules against fixed cases and against plain Python on random strings."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import pandas_text as P
from tessera.functions import text as T
from tessera.functions.profiles import REFERENCE


def apply(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").repartition(1)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def randoms(n, alphabet, most=40, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_normal_forms(spark):
    assert apply(spark, P.nfkc_key, "  ＡＢＣ\t 问题\n") == ["ABC 问题"]
    assert apply(spark, T.collapse, " a \t\n b　c ", "", "\x1c x \x1f") == ["a b c", "", "x"]
    assert apply(spark, T.drop_empty_think, " \n<think>\n</think>\n（点头）吾辈知道了。 ", "<THINK> </THINK>x", "<think>a</think>b") == ["（点头）吾辈知道了。", "x", "<think>a</think>b"]
    assert apply(spark, T.drop_code_fence, '```json\n{"a": 1}\n```', " plain ", "```\nx\ny\n```") == ['{"a": 1}', "plain", "x\ny"]
    assert apply(spark, T.copy_form, "a, b。c！ d") == ["abcd"]


def test_strict_format(spark):
    good = "（点头）吾辈知道了。"
    bad = ["吾辈知道了。", "（）好", "（点头）", "（ ）好", "（点（头））好", "（点头）好（笑）", "（点头）<b>好", "(点头)好"]
    assert apply(spark, lambda x: T.is_strict_format(x, REFERENCE), good, *bad) == [True] + [False] * 8


def test_repeats(spark):
    assert apply(spark, P.has_repeated_span, "abcdefghijkl" * 3, "哈" * 35, "哈哈哈哈", "", "abcdefghijkl" * 2) == [True, True, False, False, False]
    assert apply(spark, T.has_contiguous_repeat, "abab abab", "abcabc", "哈哈哈哈") == [True, False, True]

    def spec(text):
        c = "".join(text.split())
        if any(c.count(c[i : i + 12]) >= 3 for i in range(max(0, len(c) - 11))):
            return True
        for i in range(max(0, len(c) - 23)):
            for p in range(1, 7):
                end = i
                while p and c.startswith(c[i : i + p], end):
                    end += p
                if end - i >= 24 and (end - i) // p >= 6:
                    return True
        return False

    texts = randoms(400, "ab", 90) + [t * 3 for t in randoms(200, "abcd ", 16, 2)]
    assert apply(spark, P.has_repeated_span, *texts) == [spec(t) for t in texts]


def test_symbols_and_gibberish(spark):
    assert apply(spark, T.has_abnormal_symbols, "😀", "！！！！", "好。", "a\x07", "�", "a‍b", "a\tb") == [True, True, False, True, True, False, False]
    assert apply(spark, T.has_gibberish, "👩‍👩😀😀😀😀😀😀😀😀😀😀😀😀", "αβγδεζηθικλμ", "абв", "!" * 12, "！！！！") == [False, True, False, True, False]

    def control(c):
        return c == "�" or (unicodedata.category(c)[0] == "C" and not c.isspace() and c != "‍")

    def spec(text):
        run = 0
        for c in text:
            if control(c) or 0x1F000 <= ord(c) <= 0x1FAFF or 0x2600 <= ord(c) <= 0x27BF:
                return True
            run = run + 1 if unicodedata.category(c)[0] in "PS" else 0
            if run >= 4:
                return True
        return False

    texts = randoms(1500, "ab。，!?()+‍\t😀", 25)
    assert apply(spark, T.has_abnormal_symbols, *texts) == [spec(t) for t in texts]


def test_unclosed_brackets(spark):
    def spec(text):
        for a, b in ("（）", "()"):
            depth = 0
            for c in text:
                depth += (c == a) - (c == b)
                if depth < 0:
                    return True
            if depth:
                return True
        return False

    texts = ["（点头回答", "）点头（回答", "(a)(b)", "", *randoms(800, "()（）a", 12)]
    assert apply(spark, T.has_unclosed_brackets, *texts) == [spec(t) for t in texts]


def test_counts(spark):
    assert apply(spark, lambda x: T.sentence_count(x, REFERENCE), "好。走吧！", "好", " 。！") == [2, 1, 0]
    assert apply(spark, lambda x: T.signature_count(x, REFERENCE), "吾辈来了", "吾輩来了", "他说“吾辈”") == [1, 1, 0]
    assert apply(spark, lambda x: T.wrong_references(x, REFERENCE), "我和我，本大爷，本喵，我们，自我", "无") == [["本大爷", "本喵", "我", "我"], []]
    assert apply(spark, T.filled_length, " a　b\n", "") == [2, 0]
    assert apply(spark, lambda x: T.has_speaker_label(x, REFERENCE), "user: hi", "a\n 助手：好", "the user: x") == [True, True, False]
    assert apply(spark, T.named_user, "莲：朋友", "没有名字", "a b：c") == ["莲", None, None]


def test_self_references(spark):
    df = spark.createDataFrame([(["自称“吾辈”。", "不说'我'", "自称\"吾辈\"或自称'咱'"],)], "r array<string>")
    assert df.select(T.self_references(F.col("r"))).first()[0] == ["吾辈", "咱"]


def test_duration_and_versions(spark):
    df = spark.createDataFrame([(65.4,), (3605.0,), (None,), (-1.0,)], "s double")
    assert [r[0] for r in df.select(T.duration(F.col("s"))).collect()] == ["01:05", "01:00:05", "--:--", "--:--"]
    assert apply(spark, T.plain_version, "2.1.0+cu118", "1.0") == ["2.1.0", "1.0"]


def _actions(text):
    """Outermost spans, nested openings and unbalanced brackets, by a stack."""
    close, stack, spans, nested, wrong = {"（": "）", "(": ")"}, [], [], 0, 0
    for i, c in enumerate(text):
        if c in close:
            nested += bool(stack)
            stack.append((c, i))
        elif c in close.values():
            if not stack:
                wrong += 1
                continue
            o, at = stack.pop()
            wrong += close[o] != c
            if not stack:
                spans.append((at, i, text[at + 1 : i]))
    return spans, nested, wrong + len(stack)


def test_actions(spark):
    texts = ["（点头）（）（很长的一段动作）好。", "", "a(b", "((a)b)c）", "(x）y（z)", *randoms(600, "()（）a1 ", 16)]
    got = apply(spark, T.actions, *texts)
    for t, g in zip(texts, got):
        spans, nested, wrong = _actions(t)
        assert ([(s["first"], s["last"], s["body"]) for s in g["spans"]], g["nested"], g["unbalanced"]) == (spans, nested, wrong), t
    facts = apply(spark, lambda x: T.action_facts(x, T.actions(x)), *texts)
    for t, f in zip(texts, facts):
        spans, nested, wrong = _actions(t)
        gaps = [sum(unicodedata.category(c)[0] in "LN" for c in t[a[1] + 1 : b[0]]) for a, b in zip(spans, spans[1:])]
        assert f["count"] == len(spans) and f["minimum_gap"] == (min(gaps) if gaps else None) and f["invalid"] == sum(not any(c.isalpha() for c in s[2]) for s in spans), t
    assert facts[0]["count"] == 3 and facts[0]["invalid"] == 1


@pytest.mark.parametrize("text,want", [("", 0.0), ("abc", 0.0), ("abcabc", 3 / 6), ("aaaaaa", 1.0)])
def test_repetition(text, want):
    assert P.repetition(text) == pytest.approx(want)


def test_repetition_matches_a_count_of_every_span():
    def spec(text):
        c = "".join(text.split())
        best = 0.0
        for n in range(3, 13):
            if 2 * n <= len(c):
                spans = [c[i : i + n] for i in range(len(c) - n + 1)]
                best = max(best, (max(spans.count(s) for s in set(spans)) - 1) * n / len(c))
        return min(best, 1.0)

    for t in randoms(300, "ab c", 60) + randoms(100, "日本abé ", 80, 3) + ["abc " * 30, "x"]:
        assert P.repetition(t) == pytest.approx(spec(t))
