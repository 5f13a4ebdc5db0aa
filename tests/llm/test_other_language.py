"""A document of a language without a reference is held to the base rules only."""

from __future__ import annotations

import random

from tessera.llm import quality_rules


def test_a_language_without_a_reference_is_not_divergent(spark):
    rng = random.Random(2)
    english = [" ".join(rng.choice("the of and to a in is that it for was on with as be by this are at from river garden winter letter".split()) for _ in range(120)) for _ in range(30)]
    russian = " ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(120))
    rows = [(i, t, "en") for i, t in enumerate(english)] + [(50, russian, "ru"), (51, russian, "en"), (52, russian, None), (53, "слово " * 120, "ru"), (54, "мало слов", "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["id"] for r in quality_rules.judged(docs).where("kept").collect()}
    assert {i for i in kept if i >= 50} == {50} and len(kept) > 25
    assert {r["doc_id"] for r in quality_rules.filter_documents(docs).collect()} == kept


def test_every_named_language_gets_its_own_reference(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    sets = {"ru": "абвгдежзиклмнопрст", "xx": "qwzxkvj", "en": "etaoinshr"}
    rows = []
    for lang, letters in sets.items():
        often = [word(letters) for _ in range(12)]
        rows += [(lang, " ".join(rng.choice(often) if rng.random() < 0.4 else word(letters) for _ in range(150))) for _ in range(40)]
    rows += [("ru", " ".join(word("qwzxkvj") for _ in range(150))), ("en", "".join(f"{word('etaoinshr')} 123456 " for _ in range(100)))]
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    dropped = {r["id"] for r in quality_rules.judged(docs).where("not kept").collect()}
    assert {120, 121} <= dropped and len(dropped) <= 4
    likely = quality_rules.likely_words(docs.select("lang", "text"))
    measured = docs.selectExpr("doc_id id", "0L th", "lang", "text").mapInArrow(quality_rules._measured(likely), "id long, th long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, common array<int>")
    common = quality_rules.common_words(measured, likely)
    from collections import Counter

    for lang in sets:
        words = [w for k, t in rows if k == lang for w in t.split()]
        want = sorted(w for w, n in Counter(words).items() if 250 * n >= len(words) and w.isalpha())
        assert [likely[lang][i] for i in common[lang]] == want and len(want) >= 12


def test_chunks_miss_no_common_word(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "CHUNK_WORDS", 7)
    rows = [("en", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for _ in range(3)) + " often") for i in range(200)]
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist([{"lang": k, "text": t}]) for k, t in rows]
    found = [r for b in quality_rules._counted(iter(batches)) for r in b.to_pylist()]
    assert sum(r["n"] for r in found if r["word"] == "often") == 200 and sum(r["n"] for r in found if r["word"] == "") == 800
