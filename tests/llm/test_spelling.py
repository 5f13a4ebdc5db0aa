"""Spelling variants against all pairs of words in plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import spelling

from .odd import none, odd


def slow_counts(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows):
    words = slow_counts(rows)
    out, forms = {}, {}
    for w, n in words.items():
        others = sorted((x for x in words if x != w and near(w, x)), key=lambda x: (-words[x], x))
        if others and words[others[0]] >= 10 * n:
            forms[w] = others[0]
        out[w] = [forms.get(w), None, n, len(others), words[forms[w]] if w in forms else None]
    for w in out:
        root = w
        while root in forms:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_edits_at_every_place(spark):
    rng, rows = random.Random(3), []
    for base in ("aaaaaaaa", "abcdefgh", "straßenbahn", "édition×s", "zyxwvut"):
        near_ones = [base[:i] + c + base[i + k :] for i in range(len(base) + 1) for c in ("", "a", "ÿ") for k in (0, 1)] + [base[::-1], base[1:] + base[0]]
        for w in {base, *near_ones}:
            rows += [(len(rows) + j, f"{w}, {w.upper() if rng.random() < 0.3 else w}") for j in range(rng.choice((1, 1, 6)))]
        rows += [(9000 + i, base) for i in range(60)]
    want = slow_variants(rows)
    assert sum(v[3] for v in want.values()) > 500 and any(v[0] for v in want.values())
    assert got(spelling.variants(made(spark, rows))) == want


def test_chains_ties_and_hot_words(spark):
    chain = [(i, w) for w, n in (("abcdefgx", 2), ("abcdefgh", 25), ("abcdefghi", 300), ("bcdefghi", 3100)) for i in range(n)]
    ties = [(i, w) for w, n in (("mnopqrst", 2), ("mnopqrs", 40), ("mnopqrstu", 40)) for i in range(n)]
    rows = [(i * 7, w) for i, w in chain + ties]
    want = slow_variants(rows)
    assert want["abcdefgx"][1] == "bcdefghi" and want["mnopqrst"][0] == "mnopqrs"
    assert got(spelling.variants(made(spark, rows))) == want


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).select("doc_id", "text").collect()]
    assert got(spelling.variants(odd(spark))) == slow_variants(rows)
    assert spelling.variants(none(spark)).collect() == []
    long = [(1, "x" * 100_000), (2, "x" * 100_000), (3, None), (None, "Abcdefghij abcdefghij"), (4, "short words only")]
    assert got(spelling.variants(made(spark, long))) == slow_variants(long)


@pytest.mark.parametrize("extra", ["word", "n", "run", "id"])
def test_columns_of_clashing_names(spark, extra):
    rows = [(i, "several variant variants") for i in range(5)]
    df = made(spark, rows).selectExpr("*", f"'x' AS {extra}")
    assert got(spelling.variants(df)) == slow_variants(rows)
