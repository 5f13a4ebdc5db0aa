"""Reward arithmetic as columns: the continuous rule reward, the local and judge rewards, penalties and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pandas_text as P
from . import text as T
from .profiles import DRIVER, TRUNCATED, RuleProfile

# Fixed values of the reward.
INSTRUCTION_WEIGHT, PERSONA_WEIGHT, STYLE_WEIGHT = 5.0, 2.0, 1.0
HARD_INVALID_BASE, RECOVERY_RANGE = -12.0, 2.0
MAX_ACTION_LENGTH, MIN_ACTION_GAP, MAX_ACTION_RATIO = 30, 12, 0.5
CONSTRAINT_NAMES = ("actions", "sentences", "chars", "signatures")
CONSTRAINTS = "struct<" + ",".join(f"min_{n}:int,max_{n}:int" for n in CONSTRAINT_NAMES) + ">"
CAP_ONE = ("identity_break", "perspective_shift", "ordinary_pet_self_identification")
CAP_TWO = ("fabricated_person_or_major_experience", "romanticization", "servile_submission")
VIOLATION_CODES = (*CAP_ONE, *CAP_TWO, "wrong_self_reference", "missing_signature_self_reference")


def range_distance(x: Column, low: Column, high: Column) -> Column:
    """How far x lies outside of low..high; 0 where neither is set."""
    far = F.greatest(low - x, F.lit(0)) + F.greatest(x - high, F.lit(0))
    return F.when(low.isNull() & high.isNull(), F.lit(0.0)).otherwise(far.cast("double"))


def violation_score(v: Column) -> Column:
    return (1 - v) / (1 + v)


def instruction_violation(actions: Column, sentences: Column, length: Column, c: Column) -> Column:
    d = {n: range_distance(x, c[f"min_{n}"], c[f"max_{n}"]) for n, x in (("actions", actions), ("sentences", sentences), ("chars", length))}
    return d["actions"] + 0.7 * d["sentences"] + 0.3 * d["chars"] / 30.0


def persona_violation(signatures: Column, pronouns: Column, aliases: Column, c: Column) -> Column:
    return 0.8 * range_distance(signatures, c["min_signatures"], c["max_signatures"]) + 0.4 * pronouns + 0.8 * aliases


def length_distance(length: Column, c: Column) -> Column:
    middle = (c["min_chars"] + c["max_chars"]) / F.lit(2.0)
    return F.abs(length - middle) / F.greatest(middle, F.lit(1.0))


def style_violation(length: Column, repetition: Column, a: Column, n_format: Column, c: Column) -> Column:
    excess = F.aggregate(a["lengths"], F.lit(0).cast("long"), lambda s, n: s + F.greatest(n - MAX_ACTION_LENGTH, F.lit(0)))
    gap = F.coalesce(F.greatest(MIN_ACTION_GAP - a["minimum_gap"], F.lit(0)) / F.lit(float(MIN_ACTION_GAP)), F.lit(0.0))
    return (
        0.4 * length_distance(length, c) + 0.5 * repetition + 0.3 * excess / F.lit(float(MAX_ACTION_LENGTH))
        + 0.3 * F.greatest(a["ratio"] - MAX_ACTION_RATIO, F.lit(0.0)) / F.lit(MAX_ACTION_RATIO) + 0.2 * gap + 0.3 * n_format + 0.3 * a["invalid"] + 0.2 * a["nested"]
    )


def rule_reward(rows: DataFrame, text: str, constraints: str, finish: str, truncated: str | None = None, profile: RuleProfile = DRIVER) -> DataFrame:
    """``rows`` with the struct ``reward``: every component of the rule reward of a completion.

    The stages are columns of their own, so each is computed once.
    """
    own = rows.withColumn("_t", T.drop_empty_think(F.coalesce(F.col(text), F.lit(""))))
    own = own.withColumn("_a", T.action_facts(F.col("_t"), T.actions(F.col("_t")))).withColumns({"_rep": P.repetition_ratio("_t"), "_span": P.has_repeated_span(F.col("_t"))})
    t, a, c = F.col("_t"), F.col("_a"), F.col(constraints)
    cut = F.coalesce(F.col(finish).isin(*TRUNCATED), F.lit(False)) | (F.coalesce(F.col(truncated), F.lit(False)) if truncated else F.lit(False))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    own = own.withColumns({
        "_cut": cut, "_gib": T.has_gibberish(t), "_len": T.filled_length(t), "_sent": T.sentence_count(t, profile), "_sig": T.signature_count(t, profile),
        "_pro": T.wrong_pronoun_count(t, profile), "_ali": T.wrong_alias_count(t, profile),
        "_form": F.concat(F.array_compact(F.array(flag(T.has_tag(t), "extra_tag"), flag(T.has_speaker_label(t, profile), "speaker_label"))), F.array_repeat(F.lit("nested_parentheses"), a["nested"].cast("int"))),
    })
    own = own.withColumn("_hard", F.array_compact(F.array(flag(t == "", "empty"), flag(F.col("_cut"), "truncated"), flag(F.col("_gib"), "gibberish"), flag(F.col("_span"), "repeated_span"), flag(a["unbalanced"] > 0, "unbalanced_parentheses"))))
    own = own.withColumns({
        "_iv": instruction_violation(a["count"], F.col("_sent"), F.col("_len"), c),
        "_pv": persona_violation(F.col("_sig"), F.col("_pro"), F.col("_ali"), c),
        "_sv": style_violation(F.col("_len"), F.col("_rep"), a, F.size("_form"), c),
        "_rec": ((t != "").cast("double") + (~F.col("_cut")).cast("double") + (~F.col("_gib")).cast("double") + F.when(F.col("_span"), 1 - F.col("_rep")).otherwise(F.lit(1.0)) + 1 / (1 + a["unbalanced"].cast("double"))) / 5,
    })
    own = own.withColumn("_raw", INSTRUCTION_WEIGHT * violation_score(F.col("_iv")) + PERSONA_WEIGHT * violation_score(F.col("_pv")) + STYLE_WEIGHT * violation_score(F.col("_sv")))
    total = F.when(F.size("_hard") > 0, HARD_INVALID_BASE + RECOVERY_RANGE * F.col("_rec")).otherwise(F.col("_raw"))
    names = {"_len": "normalized_length", "_sent": "sentence_count", "_sig": "signature_count", "_pro": "wrong_pronouns", "_ali": "wrong_aliases", "_a": "action", "_iv": "instruction_violation", "_pv": "persona_violation", "_sv": "style_violation", "_form": "format_reasons", "_hard": "hard_invalid_reasons", "_rec": "recoverability", "_raw": "raw_reward"}
    scores = [violation_score(F.col(k)).alias(n) for k, n in (("_iv", "instruction_score"), ("_pv", "persona_score"), ("_sv", "style_score"))]
    reward = F.struct(*(F.col(k).alias(n) for k, n in names.items()), *scores, (F.col("_pro") + F.col("_ali")).alias("wrong_self_count"), total.alias("total_reward"))
    return own.withColumn("reward", reward).select(*rows.columns, "reward")


def copy_penalty(length: Column, coverage: Column) -> Column:
    return F.when((length < 40) | (coverage < 0.2), 0.0).when(coverage < 0.5, 2.0).otherwise(4.0)


def length_penalty(length: Column) -> Column:
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), (length - 180) / F.lit(60.0)))


def readable(x: Column, finish: Column, repeated: Column) -> Column:
    """1 for a text that isn't blank, gibberish, repeated, open in its brackets or cut."""
    bad = (T.strip(x) == "") | T.has_gibberish(x) | repeated | T.has_unclosed_brackets(x) | F.coalesce(finish == "length", F.lit(False))
    return (~bad).cast("int")


def capped_role(identity: Column, personality: Column, voice: Column, violations: Column) -> Column:
    """The sum of the role scores, at most 1 or 2 where a violation of that gravity is named, else 5."""
    cap = F.when(F.arrays_overlap(violations, F.array(*map(F.lit, CAP_ONE))), 1).when(F.arrays_overlap(violations, F.array(*map(F.lit, CAP_TWO))), 2).otherwise(5)
    return F.least(identity + personality + voice, cap)


def judge_reward(readable: Column, role: Column, dialogue: Column, copied: Column, long: Column) -> Column:
    return readable * (F.coalesce(role, F.lit(0)) + F.coalesce(dialogue, F.lit(0))) / F.lit(2.0) - copied - long


def rank_reward(mean_position: Column, labels: int = 4) -> Column:
    """The reward of a mean position from 0, on 5 to 0."""
    return 5.0 * (labels - 1 - mean_position) / (labels - 1)
