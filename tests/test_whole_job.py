"""Queries over documents against plain Python on a small fixture: whole texts and every rule."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from tessera.functions import pandas_text as P
from tessera.plans import queries

from .test_text import apply, randoms

SPAN = "abcdefghijkl"
#: In pairs: base (even id), candidate (odd id).
TEXTS = ["plain words here", f"{SPAN} one {SPAN} two {SPAN}", "x" * 24, "other words", f"{SPAN} {SPAN}", "", "y" * 23, "(open the door", "ab " * 12, "some answer"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents.parquet of TEXTS."""

    def write(texts, name):
        folder = tmp_path_factory.mktemp(name)
        rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        return str(folder)

    return write


def slow_repeated(text):
    """The rule as the reference states it, by counting every span."""
    c = "".join(text.split())
    if any(c.count(c[i : i + 12]) >= 3 for i in range(len(c) - 11)):
        return True
    return any(c[i : i + p] * -(-24 // p) == c[i : i + p * -(-24 // p)] for p in range(1, 5) for i in range(len(c) - 23)) or any(c[i : i + p] * 6 == c[i : i + p * 6] for p in (5, 6) for i in range(len(c) - p * 6 + 1))


def test_repeated_span(spark):
    texts = TEXTS + randoms(400, "ab", 90) + [t * 3 for t in randoms(200, "abcd 😀", 16, 2)] + ["😀" * 24, "😀" * 23]
    want = [slow_repeated(t) for t in texts]
    assert apply(spark, P.has_repeated_span, *texts) == want and 20 < sum(want) < len(texts)


def test_repeated_span_of_long_texts():
    """Linear in the text, and exact where groups of spans are large or hashes would meet."""
    words = [f"w{i % 977}x{i % 1009}" for i in range(60_000)]
    assert not P.recurs("".join(f"{i:07d}" for i in range(60_000))) and P.recurs(" ".join(words * 3))
    assert P.recurs("ab" * 200_000) and not P.recurs("abcdefghijklmn" * 2)
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(5000))  # polynomial hashes modulo 2 ** 64 meet on such texts
    assert P.recurs(thue[:40]) == slow_repeated(thue[:40]) and P.recurs(thue) == slow_repeated(thue)
    assert P.recurs("x" * 11) is False and P.recurs("") is False and P.recurs("a\x00" * 24) is True


def test_flags_summary_and_gate_see_repeated_spans(spark, tables):
    sf = tables(TEXTS, "flags")
    repeated = {i for i, t in enumerate(TEXTS) if slow_repeated(t)}
    assert repeated == {1, 2, 8}
    flags = {r["doc_id"]: r["degenerate"] for r in queries.q_inspect_flags(spark, sf).collect()}
    assert {i for i, bad in flags.items() if bad} == repeated | {7}  # 7 leaves a bracket open
    for r in queries.q_quality_summary(spark, sf).collect():
        assert (r["repetition_count"], r["degeneration_count"]) == (3, 4)
    gate = queries.q_compare_gate(spark, sf).first()
    assert not gate["no_repeated_spans"] and not gate["passed"]
    clean = queries.q_compare_gate(spark, tables(["plain", "words"], "clean")).first()
    assert clean["no_repeated_spans"] and clean["passed"]
    more = queries.q_compare_gate(spark, tables(["plain", "z" * 24], "more")).first()
    assert not more["degeneration_count_not_higher"]


def test_preference_rows_compare_whole_answers(spark, tables):
    def issue(pair, chosen, rejected):
        if pair % 5 == 0 or not chosen.strip(" "):
            return "blank_message"
        rejected = chosen if pair % 7 == 0 else rejected
        return "blank_rejected" if not rejected.strip(" ") else "same_answers" if rejected == chosen else "ok"

    sides = [("a", "b"), ("same nine, then this", "same nine, then that"), ("equal answers", "equal answers"), (" " * 9 + "late start", "b"), ("a", " " * 9 + "late start"), ("a", "b"), ("a", " " * 12), ("a", "b"), (" " * 12, "b")]
    sf = tables([t for pair in sides for t in pair], "preferences")
    got = {r["issue"]: r["n"] for r in queries.q_preference_rows(spark, sf).collect()}
    assert got == Counter(issue(i, *pair) for i, pair in enumerate(sides)) == {"blank_message": 3, "ok": 3, "same_answers": 2, "blank_rejected": 1}


def test_answer_reasons_name_contiguous_repetition(spark, tables):
    def reason(i, text):
        if not text.strip():
            return "empty"
        return "finish_reason=length" if i % 10 == 0 else "contiguous_repetition" if re.search(r"(.{1,20}?)\1{3,}", re.sub(r"\s+", "", text)) else "ok"

    texts = ["ab ab ab ab", "ab ab ab ab", "ab ab ab", " ", "twenty characters it " * 4, "one two three", "aaa", "a a a a", "12345678901234567890x" * 4, "ok", "aaaa"]
    got = {r["reason"]: r["n"] for r in queries.q_answer_reasons(spark, tables(texts, "reasons")).collect()}
    assert got == Counter(reason(i, t) for i, t in enumerate(texts)) and got["contiguous_repetition"] == 3
