"""Sources, sinks and streams on small local files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import records, sinks
from tessera.streaming import logs


def test_jsonl(spark, tmp_path):
    good, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"id": "x", "n": 1}\n\n  \n{"id": "y", "n": 2}\n', encoding="utf-8")
    bad.write_text('{"id": "x"}\n[1]\nnope\n', encoding="utf-8")
    assert {r["id"] for r in records.read_jsonl(spark, str(good), "id string, n int").collect()} == {"x", "y"}
    with pytest.raises(Exception, match="not a JSON object"):
        records.read_jsonl(spark, str(bad), "id string").collect()
    assert [r["id"] for r in records.read_jsonl(spark, str(bad), "id string", strict=False).collect()] == ["x"]
    assert records.read_jsonl(spark, str(tmp_path / "none.jsonl"), "id string", missing="empty").count() == 0
    facts = records.file_facts(spark, str(tmp_path), "*.jsonl")
    assert records.manifest_issues(facts, facts).count() == 0
    changed = facts.withColumn("bytes", F.col("bytes") + F.when(F.col("path").endswith("a.jsonl"), 1).otherwise(0))
    assert [r["issue"] for r in records.manifest_issues(facts, changed).collect()] == ["changed"]
    with pytest.raises(ValueError):
        records.pinned(spark, str(good), "0" * 64)


def test_in_order_and_metrics(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 4)], "id string, v int")
    assert [r["v"] for r in records.in_order(rows, "id", ["b", "a"]).collect()] == [2, 1]
    for ids in (["a", "z"], ["c"]):
        with pytest.raises(Exception, match="no single row"):
            records.in_order(rows, "id", ids).collect()
    (tmp_path / "x").mkdir()
    (tmp_path / "x/one.log").write_text('{"loss": 1.5}\nbroken\n{"loss": true}\n{"loss": 2}\n')
    (tmp_path / "two.log").write_text('{"loss": 9}\n')
    assert sorted(r["value"] for r in records.longest_series(spark, str(tmp_path), "loss").collect()) == [1.5, 2.0]
    lines = spark.createDataFrame([("{'loss': 1.5, 'lr': 2e-5}",), ("loss: 3",)], "t string")
    assert [(r["loss"], r["lr"]) for r in records.progress_lines(lines, "t", ["loss", "lr"]).collect()] == [(1.5, 2e-5)]


def test_bundles(spark, tmp_path):
    files = {"a/x.txt": b"one", "b.txt": b"two"}
    path = str(tmp_path / "bundle.tar.gz")
    assert sinks.write_bundle(files, path) and not sinks.write_bundle(files, path)
    with pytest.raises(FileExistsError):
        sinks.write_bundle({"c": b""}, path)
    sinks.extract_bundle(path, sinks.manifest_of(files), str(tmp_path / "out"))
    assert (tmp_path / "out/a/x.txt").read_bytes() == b"one"
    with pytest.raises(ValueError):
        sinks.extract_bundle(path, sinks.manifest_of({"b.txt": b"two"}), str(tmp_path / "other"))
    members = {r["path"]: r["bytes"] for r in records.bundle_members(spark, path).collect()}
    assert members == {"a/x.txt": 3, "b.txt": 3}
    assert sinks.folder_issues(str(tmp_path / "out"), ["b.txt", "z"], ["a/x.txt"]) == (["z"], [], ["a/x.txt"])
    assert sinks.prune_folder(str(tmp_path / "out"), ["b.txt"], ["a/x.txt"]) == ["a/x.txt"]


def test_json_objects(tmp_path):
    sinks.write_json_object(str(tmp_path / "o/x.json"), {"k": "值"})
    assert json.loads((tmp_path / "o/x.json").read_text(encoding="utf-8")) == {"k": "值"}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 3}", float(i)) for i in range(10)], "id long, k string, v double").withColumn("ts", F.current_timestamp())
    rows.repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    stats = logs.drain(logs.running_stats(logs.read_stream(spark, str(tmp_path), "events"), "k", "v"), "complete", "t")
    assert {r["k"]: (r["n"], r["total"]) for r in stats.collect()} == {"k0": (4, 18.0), "k1": (3, 12.0), "k2": (3, 15.0)}
    seen = logs.first_seen(logs.read_stream(spark, str(tmp_path), "events"), ["k"], "ts", "1 day").select("k")
    assert sorted(r["k"] for r in logs.drain(seen, "append", "s").collect()) == ["k0", "k1", "k2"]
    query = logs.append_log(logs.read_stream(spark, str(tmp_path), "events").select("id"), str(tmp_path / "log"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 10


def test_resume_and_retry(spark):
    plan = spark.createDataFrame([(i, f"p{i}") for i in range(1, 6)], "pos long, user string")
    assert logs.resume_point(plan.where("pos <= 3"), plan, "pos", ["user"]) == 3
    with pytest.raises(ValueError):
        logs.resume_point(plan.where("pos >= 3"), plan, "pos", ["user"])
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("later")
        return x * 2

    assert logs.retried(flaky, sleep=lambda s: None)(4) == (8, 3, None)
    assert logs.retried(lambda x: 1 / 0, sleep=lambda s: None)(4)[2].startswith("ZeroDivisionError")
    out = logs.call_external(plan, "user", str.upper).orderBy("pos").first()
    assert (out["response"], out["attempts"], out["error"]) == ("P1", 1, None)
    assert logs.generate(plan, "pos", "user", 3).count() == 15
    assert logs.contract_hash({"b": 1, "a": 2}) == logs.contract_hash({"a": 2, "b": 1})
