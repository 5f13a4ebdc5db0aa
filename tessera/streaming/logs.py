"""Reward logs as streams: append, running statistics, dedup across batches, a status machine with expiry, resumable runs and items, retried calls under one limit."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import random
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators import ordinals
from ..sources.publication import Store
from ..sources.scratch import shared_dir


def read_stream(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A folder's Parquet table as a stream; a single file by its name."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}/{name}.parquet*")


def append_log(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each batch to JSON lines; the sink's log of committed batches makes it exactly once."""
    return stream.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def drain(stream: DataFrame, mode: str, label: str, root: str | None = None) -> DataFrame:
    """Run a stream over what is available and return what it leaves: the last state in mode 'complete', all rows in mode 'append'.

    Each batch is written under its own number, so a batch that is run again after a failure replaces what it wrote before. With the ``root`` of a run that was
    killed, its checkpoint goes on where it stopped.
    """
    spark = stream.sparkSession
    root = root or f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{label}-{time.time_ns()}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{root}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == F.lit(last if last is not None else -1))
    return rows.drop("batch")


def running_stats(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Counts, sums and extremes by key, kept as state from batch to batch."""
    v = F.col(value)
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))


def first_seen(stream: DataFrame, keys: list[str], event_time: str, horizon: str) -> DataFrame:
    """Rows whose key wasn't seen before, within a watermark that bounds the state."""
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)


def contract_hash(settings: dict[str, Any]) -> str:
    """What a resumed run must have in common with the one it resumes."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def resume_point(done: DataFrame, plan: DataFrame, pos: str, fields: list[str]) -> int:
    """How many rows of the plan are done: the done ones must be its first, unchanged; else ValueError."""
    n = done.count()
    met = done.select(pos, *(F.col(f).alias(f"_d_{f}") for f in fields)).join(plan.select(pos, *fields), pos, "left")
    bad = F.col(pos) > n
    for f in fields:
        bad = bad | ~F.col(f).eqNullSafe(F.col(f"_d_{f}"))
    wrong = met.where(bad | F.col(pos).isNull()).count()
    if wrong or done.select(pos).distinct().count() != n:
        raise ValueError(f"{wrong} finished rows aren't the plan's first {n}")
    return n


def last_status(events: DataFrame, run: str, status: str, order: str) -> DataFrame:
    """The latest status of each run."""
    return events.groupBy(run).agg(F.max_by(status, order).alias("status"), F.max(order).alias("at"))


def status_issues(events: DataFrame, run: str, status: str, order: str, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Events whose status may not follow the run's status before: rows (run, order, before, status). A run begins with any status."""
    before = F.lag(status).over(Window.partitionBy(run).orderBy(order))
    known = F.create_map(*(x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = events.select(run, order, before.alias("before"), status)
    return own.where(F.col("before").isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(known, F.col("before")), F.col(status)), F.lit(False)))


def status_machine(stream: DataFrame, run: str, status: str, order: str, at: str, allowed: Mapping[str, Sequence[str]], lateness: str, idle: str) -> DataFrame:
    """A stream of status events as one of steps: rows (run, order, before, status, issue), one for each event and one for each run that falls silent.

    State is one row a run: its last status, its place and time. The issue is ``transition`` where a status may not follow the one before, ``late`` for an event that comes after one of a higher
    place (it changes nothing), ``expired`` for a run without an event for ``idle`` of event time, whose state then goes (its row has no order). A run begins with any status, and anew
    after it expired. Events that are behind the latest of the batches before by more than ``lateness`` are dropped.
    """
    types = dict(stream.dtypes)
    own = stream.select(run, status, order, F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", lateness)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    follows = {k: set(v) for k, v in allowed.items()}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            before, _, _ = state.get
            state.remove()
            yield pd.DataFrame({run: [key[0]], order: pd.array([None], "Int64"), "before": [before], status: [before], "issue": ["expired"]})
            return
        before, last, seen = state.get if state.exists else (None, None, 0)
        rows = []
        for _, name, place, when in pd.concat(batches)[[run, status, order, "_at"]].sort_values([order, "_at"], kind="stable").itertuples(index=False):
            if last is not None and place <= last:
                rows.append((place, before, name, "late"))
                continue
            rows.append((place, before, name, "transition" if before is not None and name not in follows.get(before, ()) else None))
            before, last, seen = name, int(place), max(seen, int(when.timestamp() * 1000))
        if last is not None:
            state.update((before, last, seen))
            state.setTimeoutTimestamp(max(seen + wait, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(rows, columns=[order, "before", status, "issue"])
        out.insert(0, run, key[0])
        yield out.astype({order: "Int64"})

    schema = f"`{run}` {types[run]}, `{order}` long, before string, `{status}` string, issue string"
    return own.groupBy(run).applyInPandasWithState(step, schema, "before string, last long, seen long", "append", "EventTimeTimeout")


def process_items(plan: DataFrame, ident: str, work: Callable[[DataFrame], DataFrame], out: str, portion: int) -> int:
    """``work`` over the rows of a plan in portions, each committed by one rename, in the order of ``ident``; returns how many portions this run did.

    A portion is written aside, then renamed to its place, which names it done. A run that is killed leaves whole portions only, and the next one goes on with the plan's rows that aren't
    among them, so each row is worked off and kept once. ``work`` must keep the column ``ident``.
    """
    spark = plan.sparkSession
    store = Store(spark, out)
    done = [n for n in store.names("") if n.startswith("portion-")]
    rest = plan
    if done:
        rest = plan.join(spark.read.parquet(*(f"{out}/{n}" for n in done)).select(ident), ident, "left_anti")
    placed = ordinals.ranked(rest, [F.col(ident)], "_place").withColumn("_portion", F.floor((F.col("_place") - 1) / portion))
    portions = placed.agg(F.max("_portion")).first()[0]
    for n in range(0 if portions is None else portions + 1):
        name = f"{len(done) + n:08d}-{uuid.uuid4().hex}"
        work(placed.where(F.col("_portion") == n).drop("_place", "_portion")).write.parquet(f"{out}/.aside-{name}")
        store.rename(f".aside-{name}", f"portion-{name}")
    return 0 if portions is None else portions + 1


def processed(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all committed portions."""
    return spark.read.parquet(f"{out}/portion-*")


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a folder of log files as a stream."""
    return spark.readStream.format("text").load(path)


def retried(call: Callable[[Any], Any], attempts: int = 3, waits: tuple[float, ...] = (1.0, 2.0), sleep: Callable[[float], None] = time.sleep) -> Callable[[Any], tuple[Any, int, str | None]]:
    """``call`` with retries: (result, attempts, error)."""

    def run(item: Any) -> tuple[Any, int, str | None]:
        for n in range(1, attempts + 1):
            try:
                return call(item), n, None
            except Exception as e:  # noqa: BLE001  any failure of an external call is retried and then reported
                error = f"{type(e).__name__}: {e}"
                if n < attempts:
                    sleep(waits[min(n - 1, len(waits) - 1)])
        return None, attempts, error

    return run


@contextmanager
def slot(group: str, limit: int, pause: float = 0.01) -> Iterator[None]:
    """One of ``limit`` places of an executor, shared by all its Python workers: a lock on one of so many empty files in its own temporary folder.

    The system gives a lock back when its holder ends, however it ends. The files hold no data and are nobody else's business.
    """
    folder = os.path.join(tempfile.gettempdir(), f"tessera-slots-{os.getuid()}-{hashlib.sha256(f'{os.getcwd()}:{group}'.encode()).hexdigest()[:16]}")
    os.makedirs(folder, exist_ok=True)
    while True:
        for n in random.sample(range(limit), limit):
            with open(os.path.join(folder, str(n)), "w") as place:
                try:
                    fcntl.flock(place, fcntl.LOCK_EX | fcntl.LOCK_NB)
                except BlockingIOError:
                    continue
                yield
                return
        time.sleep(pause)


def call_external(
    rows: DataFrame, text: str, call: Callable[[str], str], out: str = "response", attempts: int = 3, at_once: int = 1, waits: tuple[float, ...] = (1.0, 2.0), executor_limit: int | None = None, group: str = "calls"
) -> DataFrame:
    """``rows`` with what an external function answers to a text, the attempts and the last error; the function is the plug-in for models and judges.

    A task has at most ``at_once`` calls under way, and all tasks of an executor together at most ``executor_limit`` of one ``group``. A call that fails is tried again after ``waits``, while its
    place is free for others.
    """

    def limited(item: Any) -> Any:
        if executor_limit is None:
            return call(item)
        with slot(group, executor_limit):
            return call(item)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = retried(limited, attempts, waits)
        for pdf in batches:
            with ThreadPoolExecutor(at_once) as pool:
                got = list(pool.map(ask, pdf[text]))
            yield pdf.assign(**{out: [g[0] for g in got], "attempts": [g[1] for g in got], "error": [g[2] for g in got]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, `{out}` string, attempts int, error string")


class CallsFailed(RuntimeError):
    """Some calls had no answer; all rows are in the log all the same."""


def logged_calls(called: DataFrame, log: str) -> DataFrame:
    """The rows of ``call_external``, from a log that is written whole before the first error is raised: so no answer that was paid for is lost to another row's failure."""
    called.write.mode("errorifexists").parquet(log)
    rows = called.sparkSession.read.schema(called.schema).parquet(log)
    bad = rows.where("error is not null").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("first")).first()
    if bad["n"]:
        raise CallsFailed(f"{bad['n']} calls failed, such as: {bad['first']} (all rows are in {log})")
    return rows


def generate(prompts: DataFrame, ident: str, text: str, k: int, make: Callable[[str, int], str] | None = None) -> DataFrame:
    """K candidates to each prompt (prompt, candidate_index, raw). Without a generator a fixed one that turns the prompt's words."""
    make = make or (lambda t, i: " ".join(t.split()[i:] + t.split()[:i]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, n, make(t or "", n)) for i, t in zip(pdf[ident], pdf[text]) for n in range(1, k + 1)], columns=["prompt", "candidate_index", "raw"])

    return prompts.select(ident, text).mapInPandas(run, f"prompt {dict(prompts.dtypes)[ident]}, candidate_index int, raw string")


class ProgressLog:
    """Lines of a run's progress, shown and written to a new local file of the driver."""

    def __init__(self, path: str, show: Callable[[str], None] = print):
        self._file, self._show = open(path, "x", encoding="utf-8"), show  # noqa: SIM115  closed by close()

    def __call__(self, line: str) -> None:
        self._show(line)
        self._file.write(line + "\n")
        self._file.flush()

    def close(self) -> None:
        self._file.close()
