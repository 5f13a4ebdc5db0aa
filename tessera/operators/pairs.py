"""Preference pairs: candidates, within-group dedup and labels, ordered choices, gates and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import rank_reward
from .curation import seeded_rank

# Fixed values.
SCORE_FLOORS = {"generation_stability": 8, "role_consistency": 7, "dialogue_quality": 7}
MIN_REJECTED_STABILITY, MIN_GAP, MAX_REGRESSION = 7, 2, 1
MIN_CHOSEN_QUALITY, MIN_REJECTED_QUALITY = 8, 7


def candidate_id(prompt: Column, index: Column) -> Column:
    return F.concat(prompt.cast("string"), F.lit("-c"), index.cast("string"))


def candidate_seed(prompt_number: Column, index: Column, base: int = 20260810, stride: int = 100) -> Column:
    return F.lit(base) + (prompt_number - 1) * stride + index - 1


def messages(*parts: tuple[str, Column]) -> Column:
    """An array of (role, content)."""
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in parts))


def last_user(rows: DataFrame, group: Sequence[str], role: str, content: str, turn: str, skip_blank: bool = True) -> DataFrame:
    """The content of the last user row of each group: blank ones are passed over, or stand."""
    own = rows.where(F.col(role) == "user")
    if skip_blank:
        own = own.where(F.trim(F.col(content)) != "")
    return own.groupBy(*group).agg(F.max_by(content, turn).alias("last_user"))


def duplicate_pointer(rows: DataFrame, group: str, text: Column, valid: Column, pos: str, ident: str) -> DataFrame:
    """``rows`` with duplicate_of: the first valid row of the group with the same text, where it comes before a valid row; else null.

    First rows come from a partial aggregate that is joined back, so a text with very many rows is in no single task.
    """
    own = rows.withColumns({"_t": F.xxhash64(text), "_s": F.sha2(text, 256), "_ok": valid})
    first = own.where("_ok").groupBy(group, "_s").agg(F.min(F.struct(F.col(pos).alias("pos"), F.col(ident).alias("ident"))).alias("_first"))
    met = own.join(first, [group, "_s"], "left")
    hit = F.col("_ok") & (F.col("_first.pos") < F.col(pos))
    return met.withColumn("duplicate_of", F.when(hit, F.col("_first.ident"))).drop("_t", "_s", "_ok", "_first")


def position_labels(rows: DataFrame, group: str, key: Column, seed: int) -> DataFrame:
    """``rows`` with label A, B, ... in a seeded order within the group."""
    return rows.withColumn("label", F.char(F.lit(64) + seeded_rank(seed, key, group)))


def tie_rewards(rows: DataFrame, group: str, score: str, ident: str, labels: int = 4) -> DataFrame:
    """``rows`` with mean_position and rank_reward: tied rows of a group share the mean of their positions, from 0 for the best.

    The mean follows from counts: better rows plus half of the other tied ones. Counts by (group, score) keep the window small.
    """
    tiers = rows.groupBy(group, score).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy(F.desc(score)))
    placed = tiers.withColumn("mean_position", upto - F.col("_n") + (F.col("_n") - 1) / F.lit(2.0)).drop("_n")
    return rows.join(placed, [group, score]).withColumn("rank_reward", rank_reward(F.col("mean_position"), labels))


def first_of(rows: DataFrame, group: Sequence[str], order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """The fields of the least row of each group by a composite order, through a partial aggregate instead of a sort."""
    picked = rows.groupBy(*group).agg(F.min_by(F.struct(*fields), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("_row"))
    return picked.select(*group, *(F.col("_row").getField(f).alias(f) for f in fields))


def choose_pairs(reviews: DataFrame, group: str, label: str, status: str, quality: str, reward: str, off_target: Column) -> DataFrame:
    """Per group: chosen_label, chosen_reward, rejected_label, rejected_reward.

    Chosen: passes the target, quality at 8 at least, nothing off target; by quality, then reward, then label. Rejected: fails it, quality at
    7 at least, nothing off target; by quality, then nearness of reward to the chosen one's, then label; without a chosen one by quality, reward, label.
    """
    fields = [label, reward]
    ok = (F.col(status) == "pass") & (F.col(quality) >= MIN_CHOSEN_QUALITY) & ~off_target
    bad = (F.col(status) == "fail") & (F.col(quality) >= MIN_REJECTED_QUALITY) & ~off_target
    chosen = first_of(reviews.where(ok), [group], [-F.col(quality), -F.col(reward), F.col(label)], fields).select(group, F.col(label).alias("chosen_label"), F.col(reward).alias("chosen_reward"))
    near = reviews.where(bad).join(chosen, group, "left")
    rank = F.when(F.col("chosen_reward").isNull(), -F.col(reward)).otherwise(F.abs(F.col(reward) - F.col("chosen_reward")))
    rejected = first_of(near, [group], [-F.col(quality), rank, F.col(label)], fields).select(group, F.col(label).alias("rejected_label"), F.col(reward).alias("rejected_reward"))
    return chosen.join(rejected, group, "full")


def preference_issue(chosen: dict[str, Column], chosen_issues: Column, rejected: dict[str, Column], rejected_unstable: Column) -> Column:
    """The first reason to refuse a pair, or null."""
    low = F.lit(False)
    for d, floor in SCORE_FLOORS.items():
        low = low | (chosen[d] < floor)
    gap = F.greatest(*(chosen[d] - rejected[d] for d in ("role_consistency", "dialogue_quality")))
    worse = F.lit(False)
    for d in SCORE_FLOORS:
        worse = worse | (chosen[d] < rejected[d] - MAX_REGRESSION)
    return (
        F.when(low | chosen_issues, "chosen_below_floor").when((rejected["generation_stability"] < MIN_REJECTED_STABILITY) | rejected_unstable, "rejected_unstable")
        .when(gap < MIN_GAP, "gap_too_small").when(worse, "other_dimension_regressed")
    )


def teacher_share_ok(teacher: Column, pairs: Column, times: int) -> Column:
    """Integer arithmetic: at most one in ``times`` pairs is the teacher's."""
    return teacher * times <= pairs


def readiness(pairs: DataFrame, issue: str, included: str, teacher: str, least: int, most: int, per_issue: int, n_issues: int, times: int = 4) -> DataFrame:
    """One row: pairs, teacher_pairs, issues that have enough, and the status."""
    by = pairs.where(F.col(included)).groupBy(issue).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(teacher)).alias("t"))
    agg = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("t"), F.lit(0)).alias("teacher_pairs"), F.count_if(F.col("n") >= per_issue).alias("issues_ready"))
    ready = F.col("pairs").between(least, most) & (F.col("issues_ready") == n_issues)
    status = F.when(~teacher_share_ok(F.col("teacher_pairs"), F.col("pairs"), times), "too_many_teacher_pairs").when(ready, "ready").otherwise("insufficient_pairs")
    return agg.withColumn("status", status)


def group_size_issues(rows: DataFrame, group: Sequence[str], exactly: int | None = None, at_least: int | None = None) -> DataFrame:
    """Groups whose number of rows isn't as it must be."""
    n = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    bad = F.lit(False)
    if exactly is not None:
        bad = bad | (F.col("n") != exactly)
    if at_least is not None:
        bad = bad | (F.col("n") < at_least)
    return n.where(bad)


def set_digest(rows: DataFrame, group: Sequence[str], order: str, ident: Column, text: Column) -> DataFrame:
    """sha256 of the ordered list of (id, sha256 of text) of each group: the digest follows every id and every text, and gathers no text."""
    line = F.concat(ident.cast("string"), F.lit(":"), F.sha2(text, 256))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("\n", F.transform(listed, lambda x: x["l"])), 256).alias("digest"))


def repeated_answers(rows: DataFrame, group: str, text: Column) -> DataFrame:
    """Groups that hold an answer more than once: rows (group, n, distinct)."""
    n = rows.select(group, F.sha2(text, 256).alias("_k")).groupBy(group, "_k").agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(group).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("distinct")).where("n > distinct")
