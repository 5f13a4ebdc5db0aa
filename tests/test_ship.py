from __future__ import annotations

from .elsewhere import counts


def test_queries_run_from_any_folder(tmp_path):
    got = counts(["q_repetition_cases", "q_near_dup_pairs"], "/root/testdata/sf0.001", tmp_path)
    assert got["q_repetition_cases"] > 0
