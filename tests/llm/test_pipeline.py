"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import os
import re

import pytest

import corpus_pipeline
from tessera.llm import exact_dedup, quality_rules, registry, simhash, store

from ..compare import assert_same, duck
from .odd import none, odd

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], duck(SF))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_one_row_per_input_row_and_reruns_agree(spark, name):
    q = registry.queries()[name]
    rows = q(spark, SF).collect()
    read = lambda table: spark.read.parquet(f"{SF}/{table}.parquet")
    if name.startswith("op11_"):  # a row for each word
        assert len({r["word"] for r in rows}) == len(rows) > 0
    elif name.startswith("op12_"):  # a row for each conversation
        assert len(rows) == read("conversations").select("conv_id").distinct().count()
    else:
        assert len(rows) == read("pages" if name.startswith("op4_") else "documents").count()
    assert sorted(map(repr, rows)) == sorted(map(repr, q(spark, SF).collect()))


def test_stages_have_their_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        if name == "quality rules":
            want = {r["id"] for r in quality_rules.judged(before).where("kept").collect()}
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)
        elif name == "exact dedup":
            normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            assert sorted(normal(r["text"]) for r in after.collect()) == sorted({normal(r["text"]) for r in before.collect()})
            assert {r["doc_id"] for r in after.collect()} == {r["id"] for r in exact_dedup.exact_groups(before).where("kept").collect()}
        elif name == "near dedup":
            assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in simhash.near_groups(before, similarity=0.8).collect()}
        if name != "sentencepiece":
            assert after.columns == columns
        else:
            assert all(r["decoded"] == (r["text"] or "") for r in after.collect())
        before = after
    assert corpus_pipeline.run(spark, SF).count() == before.count()


def test_stages_bear_odd_rows(spark):
    """Each stage on rows with nulls, empty and very long texts, repeats and clashing names: what it returns are rows of its input, and the right ones."""
    docs = odd(spark)
    rows = [tuple(r) for r in docs.collect()]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = [tuple(r) for r in out.collect()]
        if name == "sentencepiece":
            clash = docs.columns.index("ids")
            assert sorted(map(repr, (r[:clash] for r in rows))) == sorted(map(repr, (tuple(r)[:clash] for r in out.select(docs.columns[:clash]).collect())))
            assert all(r["decoded"] == (r["text"] or "") for r in out.collect())
            continue
        assert out.columns == docs.columns and set(got) <= set(rows)
        if name == "quality rules":
            assert len(got) == sum(len(words(r[1])) >= 50 for r in got) and not any(r[1] is None for r in got)
        elif name == "exact dedup":
            normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            assert sorted(normal(r[1]) for r in got) == sorted({normal(r[1]) for r in rows})
        elif name == "mixing":
            assert all(words(r[1]) for r in got)
        assert stage(spark, none(spark), SF).collect() == []


def test_the_pipeline_leaves_no_scratch_of_its_stages(spark):
    before = set(store._made)
    corpus_pipeline.run(spark, SF)
    left = [p for p in store._made if p not in before]
    assert len(left) == len(corpus_pipeline.STAGES) - 1 and all("/pipeline-" in p for p in left)
