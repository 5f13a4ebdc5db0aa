"""Rows that every operator must bear: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r_id int, rules_kept string, mix_h long, ids string, size string, key int"


def odd_rows() -> list[tuple]:
    word = "the cat of and to is in that was for with on as by at from a it be this are an house tree river stone "
    long = " ".join(word.split()[(i * 7) % 22] + ("x" * (i % 5)) for i in range(40_000))
    texts = [None, "", " ", "a b", "a  b", "a\tb", "A b", word * 4, word * 4, word * 4 + "end", long, "é ü 日本 😀 " * 30, "\n\n x \n x", None]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None]
    rows = [(i, t, "en" if n % 3 else None, None if n % 4 == 0 else f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(zip(ids, texts))]
    rows += [rows[7], rows[7], (None, "a b", None, None, 3), (None, word * 4, "fr", "s1", 9)]
    return [r + (0, "x", 1, "y", "z", 2) for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
