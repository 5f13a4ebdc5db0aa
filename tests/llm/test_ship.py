from __future__ import annotations

from ..elsewhere import counts


def test_operators_and_pipeline_run_from_any_folder(tmp_path):
    got = counts(["op5_quality_zstd", "op12_conversation_repair", "pipeline"], "/root/testdata/sf0.001", tmp_path)
    assert got["op5_quality_zstd"] == 200 and got["pipeline"] > 0
