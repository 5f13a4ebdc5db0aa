"""Compositions: prompt curation, split and data contracts, aligned comparisons, preference preparation and finalisation, review submission."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pandas_text as P
from ..functions import scoring as S
from ..functions import text as T
from ..functions.profiles import DRIVER, RuleProfile
from ..operators import curation, evaluation, isolation, ordinals, pairs, reviews, rows
from ..sources import publication
from ..sources.scratch import materialise


def curate(candidates: DataFrame, text: str, stratum: str, pos: str, shares: Sequence[tuple[str, int]], seed: int, issue: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Quality reasons, then exact dedup, then greedy near dedup, then the seeded split. Returns (rows with split and record_id, counts of reasons)."""
    own = candidates.withColumn("_issue", issue if issue is not None else F.lit(None).cast("string"))
    good = own.where("_issue is null").drop("_issue")
    keyed = materialise(good.withColumn("_key", P.nfkc_key(text)).where("_key <> ''"), "curated")
    unique = curation.exact_dedup(keyed, F.col("_key"), pos).drop("_key", "group_rows")
    unique = materialise(unique.withColumn("_row", F.monotonically_increasing_id()), "unique")
    accepted = curation.greedy_accept(unique, curation.near_duplicate_edges(unique, text, pos), pos).where("accepted")
    kept = unique.join(accepted.select(F.col("pos").alias(pos)), pos, "left_semi")
    # Ranks need no texts: only the rows of the splits get theirs back.
    split = curation.stratified_split(kept.select(pos, stratum, "_row"), stratum, F.col(pos), shares, seed).where("split is not null").drop("split_rank")
    placed = ordinals.ranked(split, curation.seeded_order(seed, F.col(pos)), "_place", ["split"])
    numbered = placed.select("_row", "split", F.concat(F.col("split"), F.format_string("_%04d", "_place")).alias("record_id"))
    out = unique.join(numbered, "_row").drop("_row")
    counts = own.where("_issue is not null").groupBy(F.col("_issue").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    for reason, left, right in (("exact_duplicate", keyed, unique), ("near_duplicate", unique, kept)):
        counts = counts.unionByName(left.agg(F.count(F.lit(1)).alias("l")).crossJoin(right.agg(F.count(F.lit(1)).alias("r"))).select(F.lit(reason).alias("reason"), (F.col("l") - F.col("r")).alias("n")))
    return out, counts


def publish_splits(spark: SparkSession, split: DataFrame, names: Sequence[str], root: str) -> None:
    """One JSON-lines table to each split, published together."""
    publication.publish_tables(spark, {n: split.where(F.col("split") == n).drop("split") for n in names}, root)


def split_issues(split: DataFrame, ident: str, user: str, category: str, prefix: str, count: int, per_category: dict[str, int]) -> DataFrame:
    """Rows (issue, detail) of what a finished split breaks: number of rows, contiguous ids, repeated users, distribution."""
    n = split.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != count).select(F.lit("count").alias("issue"), F.col("n").cast("string").alias("detail"))
    ids = rows.contiguous_issues(split.withColumn("_g", F.lit(0)), ident, prefix, ident, "_g").select(F.lit("id").alias("issue"), F.col(ident).alias("detail"))
    repeated = split.groupBy(T.collapse(F.col(user)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("first")).where("n > 1").select(F.lit("repeated_user").alias("issue"), F.col("first").alias("detail"))
    want = split.sparkSession.createDataFrame(list(per_category.items()), "c string, want long")
    have = split.groupBy(F.col(category).alias("c")).agg(F.count(F.lit(1)).alias("have"))
    off = want.join(have, "c", "full").where("not want <=> coalesce(have, 0)").select(F.lit("distribution").alias("issue"), F.col("c").alias("detail"))
    return n.unionByName(ids).unionByName(repeated).unionByName(off)


def data_issues(splits: dict[str, DataFrame], others: Sequence[tuple[DataFrame, str]], ident: str, user: str) -> DataFrame:
    """Users that two splits share, or a split and another table: rows (left, right, left_id, right_id)."""
    found = None
    names = list(splits)
    key = lambda c: T.collapse(F.col(c))
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            hit = isolation.overlaps(splits[a], splits[b], key(user), key(user), ident, ident).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "left_id", F.col("right_id").cast("string").alias("right_id"))
            found = hit if found is None else found.unionByName(hit)
        for k, (other, column) in enumerate(others):
            hit = isolation.overlaps(splits[a], other, key(user), key(column), ident, column).select(F.lit(a).alias("left"), F.lit(f"other{k}").alias("right"), "left_id", F.md5("right_id").alias("right_id"))
            found = hit if found is None else found.unionByName(hit)
    return found.distinct()


def training_row_issues(data: DataFrame, messages: str, profile: RuleProfile = DRIVER) -> DataFrame:
    """Fine-tuning rows that break their contract: role order, or an answer without the signature or with a wrong name for itself."""
    m = F.col(messages)
    roles = F.transform(m, lambda x: x["role"]) == F.array(*map(F.lit, ("system", "user", "assistant")))
    answer = F.element_at(m, -1)["content"]
    issue = F.when(~F.coalesce(roles, F.lit(False)), "role_order").when(~answer.contains(profile.inspected_signature), "no_signature").when(T.contains_any(answer, profile.inspected_wrong), "wrong_alias")
    return data.withColumn("issue", issue).where("issue is not null")


def compare(base: DataFrame, candidate: DataFrame, keys: Sequence[str], text: str, finish: str, fields: Sequence[str], seed: int, key: Column, profile: RuleProfile = DRIVER) -> dict[str, DataFrame]:
    """An aligned comparison: mismatches, the gate, and the blind packet with its answer key."""
    sides = [evaluation.inspect(x, text, finish, profile) for x in (base, candidate)]
    expected = F.greatest("b_records", "c_records")
    return {
        "mismatches": evaluation.alignment_issues(base, candidate, keys, fields),
        "gate": evaluation.behaviour_gate(evaluation.summarise(sides[0]), evaluation.summarise(sides[1]), expected),
        "packet": evaluation.review_packet(base, candidate, keys, text, seed, key),
    }


def reward_not_worse(base: DataFrame, candidate: DataFrame, reward: str) -> DataFrame:
    """Three checks of two scored sides: mean reward, hard-invalid rows and wrong self-references aren't worse."""
    def agg(df: DataFrame, p: str) -> DataFrame:
        r = F.col(reward)
        return df.agg(F.avg(r["total_reward"]).alias(f"{p}_mean"), F.count_if(F.size(r["hard_invalid_reasons"]) > 0).alias(f"{p}_hard"), F.sum(r["wrong_self_count"]).alias(f"{p}_wrong"))

    both = agg(base, "b").crossJoin(agg(candidate, "c"))  # one row each
    checks = {"mean_not_lower": F.col("c_mean") >= F.col("b_mean"), "hard_invalid_not_higher": F.col("c_hard") <= F.col("b_hard"), "wrong_self_not_higher": F.col("c_wrong") <= F.col("b_wrong")}
    passed = checks["mean_not_lower"] & checks["hard_invalid_not_higher"] & checks["wrong_self_not_higher"]
    return both.select("*", *(c.alias(n) for n, c in checks.items()), passed.alias("passed"))


def prepare_candidates(candidates: DataFrame, prompt: str, pos: str, raw: str, finish: str, constraints: str, seed: int, at_least: int = 2, profile: RuleProfile = DRIVER) -> DataFrame:
    """Candidates with their reward, hard validity, duplicate pointer, eligibility and a blind label.

    Labels go to the hard-valid candidates that don't repeat an earlier one, in prompts that have ``at_least`` of them.
    """
    own = candidates.withColumn("assistant", T.drop_empty_think(F.col(raw))).withColumn("candidate_id", pairs.candidate_id(F.col(prompt), F.col(pos)))
    scored = S.rule_reward(own, "assistant", constraints, finish, profile=profile).withColumn("hard_valid", F.size("reward.hard_invalid_reasons") == 0)
    marked = pairs.duplicate_pointer(scored, prompt, T.collapse(F.col("assistant")), F.col("hard_valid"), pos, "candidate_id")
    marked = materialise(marked.withColumn("eligible", F.col("hard_valid") & F.col("duplicate_of").isNull()), "candidates")
    enough = marked.where("eligible").groupBy(prompt).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least).select(prompt)
    labelled = pairs.position_labels(marked.where("eligible").join(enough, prompt), prompt, F.col("candidate_id"), seed).select("candidate_id", "label")
    return marked.join(labelled, "candidate_id", "left")


def finalise_pairs(candidates: DataFrame, judged: DataFrame, prompt: str, system: Column, user: str, off_target: Column) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected answers of judged prompts as preference rows, and an audit row for every prompt, the unjudged ones too.

    ``judged`` has prompt, label, status, quality and reward; ``candidates`` prompt, label, assistant and ``user``.
    """
    picked = pairs.choose_pairs(judged, prompt, "label", "status", "quality", "reward", off_target)
    answers = candidates.where("label is not null").select(prompt, "label", "assistant", user)
    side = lambda n: answers.select(prompt, F.col("label").alias(f"{n}_label"), F.col("assistant").alias(f"{n}_answer"), F.col(user).alias(f"{n}_user"))
    both = picked.join(side("chosen"), [prompt, "chosen_label"]).join(side("rejected"), [prompt, "rejected_label"])
    train = both.select(prompt, *rows.preference_row(system, F.col("chosen_user"), F.col("chosen_answer"), F.col("rejected_answer")))
    train = train.where(rows.preference_row_issue(F.col("messages"), F.col("rejected_response")).isNull())
    every = candidates.select(prompt).distinct()
    audit = every.join(picked, prompt, "left").join(train.select(prompt, F.lit(True).alias("included")), prompt, "left").withColumn("included", F.coalesce("included", F.lit(False)))
    reason = F.when(F.col("included"), "pair").when(F.col("chosen_label").isNull() & F.col("rejected_label").isNull(), "not_reviewed").when(F.col("chosen_label").isNull(), "no_chosen").when(F.col("rejected_label").isNull(), "no_rejected").otherwise("row_refused")
    return train, audit.withColumn("reason", reason)


def submit_review(results: DataFrame, key: DataFrame, packet: DataFrame, on: str, automatic: bool, new_severe_only: bool = False) -> DataFrame:
    """One row: the manual gate and the status of the run. Without results it stays awaiting review; an incomplete submission fails the query."""
    if results.isEmpty():
        return results.sparkSession.createDataFrame([("awaiting_review",)], "status string")
    faults = reviews.triple_issues(packet, key, results, on)
    broken = faults.limit(1).collect()  # one row at most
    if broken:
        raise ValueError(f"review {broken[0][on]}: {broken[0]['issue']}")
    out = evaluation.review_outcome(results, key, on, new_severe_only)
    return out.withColumn("status", F.when(F.col("passed") & F.lit(automatic), "passed").otherwise("failed"))


#: Reward plug-ins by name: each takes rows with text, constraints and finish columns and returns them with a reward.
_rewards: dict[str, Callable[..., DataFrame]] = {}


def register_reward(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a reward by name; a name is given once."""
    def put(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _rewards:
            raise ValueError(f"reward {name} is registered already")
        _rewards[name] = fn
        return fn

    return put


def reward(name: str) -> Callable[..., DataFrame]:
    return _rewards[name]


@register_reward("rule")
def rule_batch(data: DataFrame, constraints: DataFrame, record: str, text: str, finish: str, profile: RuleProfile = DRIVER) -> DataFrame:
    """The rule reward of completions whose constraints are found by record id; an unknown id fails the query."""
    met = data.join(constraints.select(record, "constraints"), record, "left")
    fault = F.raise_error(F.concat(F.lit("unknown record "), F.col(record).cast("string"))).cast(S.CONSTRAINTS)
    return S.rule_reward(met.withColumn("constraints", F.coalesce("constraints", fault)), text, "constraints", finish, profile=profile)


@register_reward("judge")
def judge_batch(data: DataFrame, text: str, finish: str, answers: DataFrame, ident: str, raw: str) -> DataFrame:
    """Local components and a judge's answers: unreadable rows need none; an answer that breaks its contract gives no reward but its issues."""
    own = data.withColumn("_rep", P.has_repeated_span(F.col(text))).withColumn("readable", S.readable(F.col(text), F.col(finish), F.col("_rep"))).drop("_rep")
    met = own.join(answers.select(ident, F.col(raw).alias("_raw")), ident, "left")
    met = met.withColumns({"_s": reviews.judge_scores(F.col("_raw")), "issues": F.when(F.col("readable") == 1, reviews.judge_issues(F.coalesce("_raw", F.lit(""))))})
    s = F.col("_s")
    role = S.capped_role(s["identity_boundary_facts"], s["personality_relationship"], s["character_voice"], s["violations"])
    total = S.judge_reward(F.col("readable"), role, s["response_effectiveness"] + s["expression_quality"], F.lit(0.0), S.length_penalty(T.filled_length(F.col(text))))
    return met.withColumn("reward", F.when((F.col("readable") == 0) | s.isNotNull(), total)).drop("_raw", "_s")
