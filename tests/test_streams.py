"""A status machine, items and calls: killed between two batches, limits that are observed, waits that are seen."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.streaming import logs

ALLOWED = {"running": ("review", "failed"), "review": ("passed", "failed")}
SCHEMA = "run string, status string, no long, at timestamp"


def events():
    """Batches of (run, status, no, second)."""
    return [
        [("a", "running", 1, 10), ("b", "review", 1, 12), ("a", "review", 2, 14)],
        [("a", "passed", 4, 20), ("b", "running", 2, 21), ("a", "review", 3, 19), ("c", "running", 1, 22)],
        [("c", "passed", 2, 30), ("a", "running", 5, 31), ("c", "passed", 2, 30)],
        [("d", "running", 1, 500)], [("d", "failed", 2, 900)], [("d", "failed", 3, 1500)], [("a", "review", 9, 1600)],
    ]


def stream(spark, folder, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(r, s, n, t) for r, s, n, t in rows], "run string, status string, no long, t long").select("run", "status", "no", F.timestamp_seconds("t").alias("at"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def machine(s):
    return logs.status_machine(s, "run", "status", "no", "at", ALLOWED, "0 seconds", "300 seconds")


def found(df):
    return sorted((r["run"], -1 if r["no"] is None else r["no"], r["before"] or "", r["status"], r["issue"] or "") for r in df.collect())


def test_status_machine_and_a_killed_stream(spark, tmp_path, monkeypatch):
    s = stream(spark, str(tmp_path), events())
    whole = found(logs.drain(machine(s), "append", "whole"))
    assert ("a", 4, "review", "passed", "") in whole or ("a", 4, "running", "passed", "transition") in whole
    assert ("b", 2, "review", "running", "transition") in whole and ("c", 2, "running", "passed", "transition") in whole and ("c", 2, "passed", "passed", "late") in whole
    assert {("a", -1, "running", "running", "expired"), ("b", -1, "running", "running", "expired"), ("c", -1, "passed", "passed", "expired")} <= set(whole)
    assert ("a", 9, "", "review", "") in whole  # its state had gone
    root = str(tmp_path / "killed")
    seen = []

    class Killed(Exception):
        pass

    def run(kill_at):
        def put(batch, number):
            batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
            seen.append(number)
            if number == kill_at:
                raise Killed

        q = machine(s).writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    for kill_at in (1, 3):
        with pytest.raises(Exception, match="Killed"):
            run(kill_at)
    assert found(logs.drain(machine(s), "append", "again", root)) == whole
    assert seen.count(1) == 2  # the batch that was killed ran again and replaced what it had written


def test_items_are_committed_in_portions(spark, tmp_path):
    plan = spark.range(25).select(F.col("id").alias("item"), F.concat(F.lit("t"), "id").alias("text"))
    out, tries = str(tmp_path / "items"), []

    def work(rows):
        tries.append(1)
        if len(tries) == 3:
            raise OSError("killed")
        return rows.withColumn("n", F.length("text"))

    with pytest.raises(OSError, match="killed"):
        logs.process_items(plan, "item", work, out, 10)
    assert logs.processed(spark, out).count() == 20
    assert logs.process_items(plan, "item", work, out, 10) == 1 and logs.process_items(plan, "item", work, out, 10) == 0
    rows = logs.processed(spark, out).collect()
    assert sorted(r["item"] for r in rows) == list(range(25)) and len(rows) == 25


def test_calls_under_one_limit(spark, tmp_path):
    """Over several tasks of one executor no more than two calls at a time, attempts counted, waits that take place, all rows logged before the error."""
    path = str(tmp_path / "calls")

    def ask(text):
        began = time.time()
        time.sleep(0.1)
        with open(path, "a") as f:
            f.write(f"{text} {began} {time.time()}\n")
        number = int(text)
        with open(path) as f:
            before = sum(line.split()[0] == text for line in f)
        if number % 5 == 0 or number % 5 == 1 and before < 2:
            raise ValueError(f"refused {number}")
        return f"answer {number}"

    rows = spark.range(0, 20, 1, 4).select("id", F.col("id").cast("string").alias("t"))
    called = logs.call_external(rows, "t", ask, attempts=3, at_once=3, waits=(0.2, 0.3), executor_limit=2, group=str(tmp_path))
    log = str(tmp_path / "log")
    with pytest.raises(logs.CallsFailed, match="4 calls failed, such as: ValueError: refused"):
        logs.logged_calls(called, log)
    got = {r["id"]: r for r in spark.read.parquet(log).collect()}
    assert len(got) == 20
    assert {i: r["attempts"] for i, r in got.items()} == {i: 3 if i % 5 == 0 else 2 if i % 5 == 1 else 1 for i in range(20)}
    assert all((r["error"] is None) == (i % 5 != 0) and (r["response"] == f"answer {i}") == (i % 5 != 0) for i, r in got.items())
    lines = [line.split() for line in open(path).read().splitlines()]
    spans = [(float(a), float(b)) for _, a, b in lines]
    assert len(spans) == 4 * 3 + 4 * 2 + 12
    assert max(sum(a <= x < b for a, b in spans) for x, _ in spans) <= 2
    of = sorted(a for t, a, b in ((t, float(a), float(b)) for t, a, b in lines) if t == "5")
    assert of[1] - of[0] >= 0.3 and of[2] - of[1] >= 0.4  # a call of 0.1 s and the waits


def test_slots_are_given_back():
    held = []

    def hold():
        with logs.slot("given-back", 1):
            held.append(time.time())

    threads = [threading.Thread(target=hold) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(10)
    assert len(held) == 4
    with pytest.raises(ZeroDivisionError), logs.slot("given-back", 1):
        1 / 0
    with logs.slot("given-back", 1):
        pass
