"""Loaders under closed contracts."""

from __future__ import annotations

import json

import pytest

from tessera.sources import loaders


def write(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_prompts(spark, tmp_path):
    full = {"id": "sft_0001", "scenario": "daily", "target_goals": ["a", "b"], "user": "你好"}
    assert loaders.load_prompts(spark, write(tmp_path / "a.jsonl", [full, {"user": "x"}])).count() == 2
    for rows in ([full, {**full, "more": 1}], [full, full], [{**full, "target_goals": ["a", "a"]}], [{"user": " "}], []):
        with pytest.raises(loaders.RecordError):
            loaders.load_prompts(spark, write(tmp_path / "b.jsonl", rows))


def test_examples(spark, tmp_path):
    rows = [{"user": f"u{i}", "assistant": "a"} for i in range(10)]
    assert loaders.load_examples(spark, write(tmp_path / "e.jsonl", rows)).count() == 10
    with pytest.raises(loaders.RecordError, match="9 rows"):
        loaders.load_examples(spark, write(tmp_path / "f.jsonl", rows[:9]))


def test_persona(spark, tmp_path):
    good = {"name": "n", **{s: ["x"] for s in loaders.SECTION_NAMES}, "facts": []}
    path = tmp_path / "p.json"
    path.write_text(json.dumps(good, indent=1))
    assert loaders.load_persona(spark, str(path)).first()["identity"] == ["x"]
    for bad in ({**good, "extra": []}, {**good, "name": " "}, {**good, "facts": [" "]}, {k: v for k, v in good.items() if k != "facts"}):
        path.write_text(json.dumps(bad))
        with pytest.raises(loaders.RecordError):
            loaders.load_persona(spark, str(path))


def test_manifest_and_snapshot(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a = write(tmp_path / "in/a.jsonl", [{"v": 1}, {"v": 2}])
    manifest = loaders.snapshot_inputs([a], str(tmp_path / "copy"))
    df = spark.createDataFrame([(m["path"], m["bytes"], m["sha256"], 2) for m in manifest], "path string, bytes long, sha256 string, records long")
    assert sorted(r["v"] for r in loaders.load_manifested(spark, str(tmp_path / "copy"), df, "v int").collect()) == [1, 2]
    with pytest.raises(loaders.RecordError, match="rows"):
        loaders.load_manifested(spark, str(tmp_path / "copy"), df.selectExpr("path", "bytes", "sha256", "3L as records"), "v int")
    with pytest.raises(loaders.RecordError, match="changed"):
        loaders.load_manifested(spark, str(tmp_path / "copy"), df.selectExpr("path", "bytes + 1 as bytes", "sha256"), "v int")
    write(tmp_path / "in/b.jsonl", [{"v": 3}])
    assert loaders.load_others(spark, str(tmp_path / "in"), ["a.jsonl"]).count() == 1
