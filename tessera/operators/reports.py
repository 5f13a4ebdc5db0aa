"""Reports and plans: pilot and editability reports, series checks, step plans, checkpoints, progress."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pilot_report(items: DataFrame, decisions: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """One row over items (scenario, decision, score columns, passed): counts by decision, mean scores to two places, distinct scenarios, status."""
    counts = [F.count_if(F.col("decision") == d).alias(f"{d}_count") for d in decisions]
    means = [F.round(F.avg(s), 2).alias(f"mean_{s}") for s in scores]
    status = F.when(F.coalesce(F.bool_and("passed"), F.lit(False)), "automatic_checks_passed").otherwise("manual_review_required")
    return items.agg(F.count(F.lit(1)).alias("sample_count"), F.count_distinct("scenario").alias("scenario_count"), *counts, *means, status.alias("status"))


def editability_report(items: DataFrame, least: int, strong: int) -> DataFrame:
    """One row over items (successful, similarity, length_ratio): counts, means of the successful ones, and the outcome."""
    ok = F.col("successful")
    agg = items.agg(
        F.count(F.lit(1)).alias("prompts"), F.count_if(ok).alias("successful"), F.round(F.avg(F.when(ok, F.col("similarity"))), 6).alias("mean_similarity"), F.round(F.avg(F.when(ok, F.col("length_ratio"))), 6).alias("mean_length_ratio"),
    )
    n = F.col("successful")
    return agg.withColumn("outcome", F.when(n >= strong, "strong").when(n >= least, "viable").otherwise("insufficient"))


def reason_counts(items: DataFrame, reasons: str) -> DataFrame:
    """How often each reason of a list column is named."""
    return items.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def reason_counts_by(items: DataFrame, by: str, reasons: str) -> DataFrame:
    """How often each reason of a list column is named, for each value of ``by``."""
    return items.select(by, F.explode(reasons).alias("reason")).groupBy(by, "reason").agg(F.count(F.lit(1)).alias("n"))


def planned_steps(rows: Column, batch: int, accumulate: int, epochs: int) -> Column:
    """Optimizer steps of a training run."""
    return (F.ceil(F.ceil(rows / batch) / accumulate) * epochs).cast("long")


def series_ok(rows: DataFrame, group: str, value: str, planned: int | None = None) -> DataFrame:
    """By group: whether all values are finite and positive, and as many as planned."""
    v = F.col(value)
    good = v.isNotNull() & ~F.isnan(v) & (v > 0) & (v != float("inf"))
    agg = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("ok"))
    return agg if planned is None else agg.withColumn("ok", F.col("ok") & (F.col("n") == planned))


def array_deltas(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """By key: elements that changed and the largest change of two arrays of numbers; ``issue`` where a side lacks the key or lengths differ."""
    a = before.select(key, F.col(value).cast("array<double>").alias("_a"))
    b = after.select(key, F.col(value).cast("array<double>").alias("_b"))
    met = a.join(b, key, "full").withColumn("_d", F.zip_with("_a", "_b", lambda x, y: y - x))
    issue = F.when(F.col("_a").isNull(), "missing_before").when(F.col("_b").isNull(), "missing_after").when(F.size("_a") != F.size("_b"), "shape")
    return met.select(key, issue.alias("issue"), F.size(F.filter("_d", lambda v: v != 0)).alias("changed"), F.array_max(F.transform("_d", F.abs)).alias("max_abs"))


def newest(rows: DataFrame, group: str, path: str, step: str, time: str) -> DataFrame:
    """The checkpoint of the highest step of each run, the latest of those."""
    return rows.groupBy(group).agg(F.max_by(path, F.struct(step, time)).alias(path))


def reported_steps(rows: DataFrame, group: str, step: str, total: Column) -> DataFrame:
    """The steps of each run that a progress report names: the first, the last, and each that begins a new fifth of the run."""
    fifth = F.greatest(F.ceil(total / 5), F.lit(1))
    before = F.lag(step).over(Window.partitionBy(group).orderBy(step))
    own = rows.withColumn("_before", before)
    crosses = F.floor((F.col(step) - 1) / fifth) > F.floor((F.col("_before") - 1) / fifth)
    return own.where((F.col(step) == 1) | (F.col(step) == total) | F.coalesce(crosses, F.lit(False))).drop("_before")


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds that remain at the mean pace so far, null before the first step."""
    return F.when(done > 0, elapsed / done * (total - done))


def backfill(wanted: int, ask: Callable[[int], list[str]], accept: Callable[[list[str], int], list[str]], extra: int = 5, max_empty: int = 5) -> list[str]:
    """Ask an external generator until ``wanted`` are accepted: first for some more than that, then for what is missing, in batches of ``extra`` at least.

    ``accept(new, limit)`` returns what of the new ones is taken. Ends early after ``max_empty`` rounds in a row without any.
    """
    taken: list[str] = []
    empty, size = 0, wanted + extra
    while len(taken) < wanted and empty < max_empty:
        got = accept(ask(size), wanted - len(taken))
        taken += got
        empty = 0 if got else empty + 1
        size = max(extra, wanted - len(taken))
    return taken


def failed_checks(checks: dict[str, bool]) -> list[str]:
    """The names of what doesn't hold, of an environment or a configuration."""
    return sorted(k for k, ok in checks.items() if not ok)


def config_issues(actual: dict, expected: dict) -> list[str]:
    """Keys whose value isn't the expected one."""
    return sorted(k for k, v in expected.items() if actual.get(k) != v or type(actual.get(k)) is not type(v))
