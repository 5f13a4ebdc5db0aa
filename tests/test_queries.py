"""Every query with SQL against DuckDB on the smallest tables; the others for rows and a stable schema."""

from __future__ import annotations

import os

import pytest

from tessera import cli
from tessera.plans import queries

from .compare import assert_same, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], duck(SF))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs_and_repeats(spark, name):
    q = queries.queries()[name]
    first, again = q(spark, SF), q(spark, SF)
    assert first.schema == again.schema
    assert sorted(map(repr, first.collect())) == sorted(map(repr, again.collect()))


def test_native_queries_run_no_python(spark):
    for name in ("q_exact_dedup", "q_dup_pointer", "q_best_pairs", "q_contamination_ngrams", "q_action_spans"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "EvalPython" not in plan and "CartesianProduct" not in plan, name


def test_cli_lists(capsys):
    assert cli.main(["list"]) == 0 and "q_compare_gate" in capsys.readouterr().out


def test_flags_take_one_arrow_pass(spark):
    """The repeated-span rule is the only one that leaves the JVM, in Arrow batches."""
    for name in ("q_inspect_flags", "q_quality_summary"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan and "CartesianProduct" not in plan, name
