"""Grid evaluation: inspection flags, summaries, alignment, gates and blind reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pandas_text as P
from ..functions import text as T
from ..functions.profiles import DRIVER, TRUNCATED, RuleProfile

# Fixed values of the manual gate.
MIN_WINS, MAX_CLEAR_LOSSES = 6, 2
DIMENSIONS = ("generation_stability", "role_consistency", "dialogue_quality")
#: Flag and whether the issue is that it is false.
ISSUES = {
    "empty_ids": ("nonempty", True),
    "non_stop_ids": ("stop", True),
    "strict_format_issue_ids": ("strict_format", True),
    "truncated_ids": ("truncated", False),
    "repetition_issue_ids": ("repeated_span", False),
    "abnormal_symbol_ids": ("abnormal_symbols", False),
    "gibberish_ids": ("gibberish", False),
    "unclosed_bracket_ids": ("unclosed_brackets", False),
    "extra_tag_ids": ("extra_tags", False),
    "wrong_self_reference_ids": ("wrong_self_reference", False),
    "degeneration_ids": ("degenerate", False),
}


def inspect(rows: DataFrame, text: str, finish: str, profile: RuleProfile = DRIVER) -> DataFrame:
    """``rows`` with the inspection flags of an answer."""
    own = rows.withColumn("_s", T.strip(F.coalesce(F.col(text), F.lit(""))))
    s, f = F.col("_s"), F.col(finish)
    own = own.withColumns({
        "nonempty": s != "", "stop": F.coalesce(f == "stop", F.lit(False)), "strict_format": T.is_strict_format(s, profile), "truncated": F.coalesce(f.isin(*TRUNCATED), F.lit(False)),
        "repeated_span": P.has_repeated_span(s), "abnormal_symbols": T.has_abnormal_symbols(s), "gibberish": T.has_gibberish(s), "unclosed_brackets": T.has_unclosed_brackets(s),
        "extra_tags": T.has_tag(s), "signature": s.contains(profile.inspected_signature), "wrong_self_reference": T.contains_any(s, profile.inspected_wrong),
    })
    return own.withColumn("degenerate", F.col("repeated_span") | F.col("abnormal_symbols") | F.col("unclosed_brackets")).drop("_s")


def stable(text: Column, finish: Column, repeated: Column) -> Column:
    """Not blank, ended by itself, readable, not repeated, brackets closed."""
    return (T.strip(text) != "") & F.coalesce(finish == "stop", F.lit(False)) & ~T.has_gibberish(text) & ~repeated & ~T.has_unclosed_brackets(text)


def summarise(flags: DataFrame, by: str | None = None, ids: Column | None = None) -> DataFrame:
    """Counts and rates of the flags, for each value of ``by`` and over all (``by`` null). With ``ids`` the sorted ids of each issue too.

    One pass with grouping sets. The id lists are as long as the issues are many: leave them out for a large grid.
    """
    n = F.count(F.lit(1))
    count = lambda c: F.count_if(F.col(c))
    metrics = [
        n.alias("records"), count("nonempty").alias("nonempty_count"), count("stop").alias("stop_count"), count("strict_format").alias("strict_format_count"),
        F.round(count("strict_format") / n, 6).alias("strict_format_rate"), count("truncated").alias("truncation_count"), count("degenerate").alias("degeneration_count"), count("gibberish").alias("gibberish_count"),
        count("unclosed_brackets").alias("unclosed_bracket_count"), count("abnormal_symbols").alias("abnormal_symbol_count"), count("repeated_span").alias("repetition_count"), count("extra_tags").alias("extra_tag_count"),
        count("signature").alias("signature_count"), F.round(count("signature") / n, 6).alias("signature_rate"), count("wrong_self_reference").alias("wrong_self_reference_count"), F.round(count("wrong_self_reference") / n, 6).alias("wrong_self_reference_rate"),
    ]
    if ids is not None:
        flags = flags.withColumn("_id", ids)
        metrics += [F.array_sort(F.collect_list(F.when(F.col(f) != neg, F.col("_id")))).alias(name) for name, (f, neg) in ISSUES.items()]
    if by is None:
        return flags.agg(*metrics)
    return flags.groupingSets([[by], []], by).agg(*metrics)


def grid_issues(rows: DataFrame, axes: Sequence[str], expected: DataFrame) -> DataFrame:
    """Cells of the grid that are missing, unexpected or repeated: rows (axes, issue, n)."""
    actual = rows.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))
    both = actual.join(expected.select(*axes).distinct().withColumn("_e", F.lit(True)), list(axes), "full")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.withColumn("issue", issue).where("issue is not null").select(*axes, "issue", F.coalesce("n", F.lit(0)).alias("n"))


def grid_of(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every cell of two axes: a product of two distinct value lists, which is the grid's own size."""
    return first.distinct().crossJoin(second.distinct())


def alignment_issues(base: DataFrame, candidate: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys that either side lacks, or whose fields differ: rows (keys, mismatches)."""
    a = base.select(*keys, *(F.col(f).alias(f"_a_{f}") for f in fields), F.lit(True).alias("_a"))
    b = candidate.select(*keys, *(F.col(f).alias(f"_b_{f}") for f in fields), F.lit(True).alias("_b"))
    both = a.join(b, list(keys), "full")
    wrong = [F.when(F.col("_a").isNull(), "missing_base"), F.when(F.col("_b").isNull(), "missing_candidate")]
    wrong += [F.when(F.col("_a") & F.col("_b") & ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), f) for f in fields]
    return both.select(*keys, F.array_compact(F.array(*wrong)).alias("mismatches")).where(F.size("mismatches") > 0)


def behaviour_gate(base: DataFrame, candidate: DataFrame, expected: Column) -> DataFrame:
    """The nine checks of two summaries of one row each, and whether all pass."""
    b, c = (x.select(*(F.col(k).alias(f"{p}_{k}") for k in x.columns)) for p, x in (("b", base), ("c", candidate)))
    v = F.col
    checks = {
        "complete_and_aligned": (v("b_records") == expected) & (v("c_records") == expected) & (v("b_nonempty_count") == expected) & (v("c_nonempty_count") == expected),
        "stop_count_not_lower": v("c_stop_count") >= v("b_stop_count"),
        "truncation_count_not_higher": v("c_truncation_count") <= v("b_truncation_count"),
        "degeneration_count_not_higher": v("c_degeneration_count") <= v("b_degeneration_count"),
        "unclosed_bracket_count_not_higher": v("c_unclosed_bracket_count") <= v("b_unclosed_bracket_count"),
        "abnormal_symbol_count_not_higher": v("c_abnormal_symbol_count") <= v("b_abnormal_symbol_count"),
        "wrong_self_reference_count_not_higher": v("c_wrong_self_reference_count") <= v("b_wrong_self_reference_count"),
        "no_repeated_spans": v("c_repetition_count") == 0,
        "no_gibberish": v("c_gibberish_count") == 0,
    }
    passed = None
    for check in checks.values():
        passed = check if passed is None else passed & check
    # One row each.
    return b.crossJoin(c).select(*(x.alias(n) for n, x in checks.items()), passed.alias("passed"))


def coin(seed: int, key: Column) -> Column:
    """0 or 1 by the parity of md5 of seed and key."""
    return F.conv(F.right(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), F.lit(1)), 16, 10).cast("int") % 2


def review_packet(base: DataFrame, candidate: DataFrame, keys: Sequence[str], text: str, seed: int, key: Column) -> DataFrame:
    """Blind pairs: keys, answer_a, answer_b and candidate_label (the answer key)."""
    both = base.select(*keys, F.col(text).alias("_b")).join(candidate.select(*keys, F.col(text).alias("_c")), list(keys))
    both = both.withColumn("candidate_label", F.when(coin(seed, key) == 0, "A").otherwise("B"))
    first = F.col("candidate_label") == "A"
    return both.select(*keys, F.when(first, F.col("_c")).otherwise(F.col("_b")).alias("answer_a"), F.when(first, F.col("_b")).otherwise(F.col("_c")).alias("answer_b"), "candidate_label")


def review_outcome(results: DataFrame, key: DataFrame, on: str, new_severe_only: bool = False) -> DataFrame:
    """The manual gate over results (winner, clearly_worse, scores_a/b structs of DIMENSIONS, severe_a/b arrays) and the key (candidate_label).

    With ``new_severe_only`` a candidate's severe issue counts only if the base answer of the pair hasn't it. ``complete``: results and key name the same reviews.
    """
    met = results.join(key.select(on, "candidate_label", F.lit(True).alias("_k")), on, "full")
    first = F.col("candidate_label") == "A"
    side = lambda name, own: F.when(first == own, F.col(f"{name}_a")).otherwise(F.col(f"{name}_b"))
    severe = F.array_except(side("severe", True), side("severe", False)) if new_severe_only else side("severe", True)
    n = F.count(F.lit(1))
    means = [F.avg(side("scores", own)[d]).alias(f"{who}_{d}") for who, own in (("base", False), ("candidate", True)) for d in DIMENSIONS]
    agg = met.agg(
        n.alias("reviewed_pairs"), F.bool_and(F.col("_k").isNotNull() & F.col("winner").isNotNull()).alias("complete"), F.count_if(F.col("winner") == F.col("candidate_label")).alias("wins"),
        F.count_if(F.col("clearly_worse") == F.col("candidate_label")).alias("clear_losses"), F.count_if(F.size(severe) > 0).alias("severe_pairs"), *means,
    )
    checks = [F.col("wins") >= MIN_WINS, F.col("clear_losses") <= MAX_CLEAR_LOSSES, F.col("severe_pairs") == 0] + [F.col(f"candidate_{d}") >= F.col(f"base_{d}") for d in DIMENSIONS]
    passed = F.col("complete")
    for c in checks:
        passed = passed & c
    return agg.withColumn("passed", F.coalesce(passed, F.lit(False)))


def reward_delta(base: DataFrame, candidate: DataFrame, keys: Sequence[str], reward: str) -> DataFrame:
    """Aligned rows with both rewards, their difference and the winner."""
    both = base.select(*keys, F.col(reward).alias("base_reward")).join(candidate.select(*keys, F.col(reward).alias("candidate_reward")), list(keys))
    delta = F.col("candidate_reward") - F.col("base_reward")
    return both.withColumn("reward_delta", delta).withColumn("winner", F.when(delta > 0, "candidate").when(delta < 0, "base").otherwise("tie"))


def reward_gate(deltas: DataFrame, min_mean: float = 0.3, min_wins: int = 6) -> DataFrame:
    """Mean difference and wins against their floors."""
    agg = deltas.agg(F.count(F.lit(1)).alias("pairs"), F.avg("reward_delta").alias("mean_delta"), F.count_if(F.col("winner") == "candidate").alias("wins"))
    return agg.withColumn("passed", (F.col("mean_delta") >= min_mean) & (F.col("wins") >= min_wins))


def log_stats(log: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, smallest, mean and largest value of a reward log by key, and whether all are finite."""
    v = F.col(value)
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min(v).alias("minimum"), F.avg(v).alias("mean"), F.max(v).alias("maximum"), F.bool_and(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).alias("finite"))


def reward_summary(rows: DataFrame, reward: str, by: str) -> DataFrame:
    """Mean total reward, hard-invalid rows and occurrences of wrong names for oneself, for each value of ``by``."""
    r = F.col(reward)
    return rows.groupBy(by).agg(
        F.round(F.avg(r["total_reward"]), 6).alias("mean_total"), F.count_if(F.size(r["hard_invalid_reasons"]) > 0).alias("hard_invalid"), F.sum(r["wrong_self_count"]).cast("long").alias("wrong_self"),
    )


#: The gate of behaviour under its older name.
legacy_gate = behaviour_gate
