"""Contracts of what reviewers and judges return, completeness of keyed triples, and the minimal-edit gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scoring import VIOLATION_CODES
from .contracts import Field, violations

# Fixed values.
DIMENSIONS = ("generation_stability", "role_consistency", "dialogue_quality")
JUDGE_SCORES = {"identity_boundary_facts": 2, "personality_relationship": 2, "character_voice": 1, "response_effectiveness": 3, "expression_quality": 2}
MIN_SIMILARITY, MIN_LENGTH_RATIO, MAX_LENGTH_RATIO = 0.65, 0.8, 1.2

JUDGE_FIELDS = (*(Field(n, "int", low=0, high=h) for n, h in JUDGE_SCORES.items()), Field("violations", "array", distinct=True), Field("reason", "string"))
CANDIDATE_REVIEW_FIELDS = (Field("target_status", "string", words=("pass", "fail", "unclear")), Field("non_target_quality", "int", low=0, high=10), Field("off_target_issues", "array", distinct=True), Field("evidence", "string"))
AUDIT_FIELDS = (Field("scores", "object"), Field("issues", "array"), Field("decision", "string"), Field("improved_assistant", "string"), Field("final_checks", "object"))


def _v(raw: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(raw), path, kind)


def judge_issues(raw: Column) -> Column:
    """What a judge's answer breaks: the contract, then codes that aren't known."""
    unknown = F.array_except(_v(raw, "$.violations", "array<string>"), F.array(*map(F.lit, VIOLATION_CODES)))
    extra = F.transform(F.array_sort(F.coalesce(unknown, F.array().cast("array<string>"))), lambda c: F.concat(F.lit("unknown_code:"), c))
    return F.concat(violations(raw, JUDGE_FIELDS), extra)


def judge_scores(raw: Column) -> Column:
    """The scores of an answer that keeps its contract, as a struct; else null."""
    fields = [_v(raw, f"$.{n}", "int").alias(n) for n in JUDGE_SCORES]
    whole = F.struct(*fields, _v(raw, "$.violations", "array<string>").alias("violations"), F.trim(_v(raw, "$.reason", "string")).alias("reason"))
    return F.when(F.size(judge_issues(raw)) == 0, whole)


def candidate_review_issues(raw: Column, target: Column) -> Column:
    """What a candidate's review breaks; its off-target issues must not name the target."""
    named = F.coalesce(F.array_contains(_v(raw, "$.off_target_issues", "array<string>"), target), F.lit(False))
    return F.concat(violations(raw, CANDIDATE_REVIEW_FIELDS), F.array_compact(F.array(F.when(named, "target_off_target"))))


def score_map_issue(raw: Column, path: str, dimensions: Sequence[str], low: int = 0, high: int = 10) -> Column:
    """Why an object of scores isn't exactly the dimensions with integers within bounds, or null."""
    scores = _v(raw, path, "variant")
    keys = F.array_sort(F.map_keys(F.try_variant_get(scores, "$", "map<string,variant>")))
    bad = F.lit(False)
    for d in dimensions:
        kind = F.schema_of_variant(F.try_variant_get(scores, f"$.{d}", "variant"))
        bad = bad | ~F.coalesce((kind == "BIGINT") & F.try_variant_get(scores, f"$.{d}", "int").between(low, high), F.lit(False))
    whole = F.coalesce(keys == F.array(*(F.lit(d) for d in sorted(dimensions))), F.lit(False))
    return F.when(~whole, "dimensions").when(bad, "score")


def audit_issues(raw: Column, baseline: Column, score_names: Sequence[str], check_names: Sequence[str], decisions: Sequence[str] = ("keep", "light_edit", "rewrite")) -> Column:
    """What a teacher's audit of an answer breaks: fields, scores, decision, checks, and that keep means unchanged and the rest changed."""
    body = T.drop_code_fence(raw)
    improved, decision = _v(body, "$.improved_assistant", "string"), _v(body, "$.decision", "string")
    checks = F.lit(False)
    for c in check_names:
        checks = checks | ~F.coalesce(F.schema_of_variant(_v(body, f"$.final_checks.{c}", "variant")) == "BOOLEAN", F.lit(False))
    own = [
        F.when(score_map_issue(body, "$.scores", score_names).isNotNull(), "invalid:scores"), F.when(~F.coalesce(decision.isin(*decisions), F.lit(False)), "invalid:decision"), F.when(checks, "invalid:final_checks"),
        F.when((decision == "keep") & (improved != baseline), "keep_but_changed"), F.when((decision != "keep") & (improved == baseline), "edit_but_unchanged"),
    ]
    return F.array_distinct(F.concat(violations(body, AUDIT_FIELDS), F.array_compact(F.array(*own))))


def triple_issues(packet: DataFrame, key: DataFrame, results: DataFrame, on: str) -> DataFrame:
    """Review ids that one of packet, key and results lacks or repeats: rows (id, issue)."""
    counts = [d.groupBy(on).agg(F.count(F.lit(1)).alias(n)) for d, n in ((packet, "packet"), (key, "key"), (results, "results"))]
    met = counts[0].join(counts[1], on, "full").join(counts[2], on, "full")
    issue = F.array_compact(F.array(*(F.when(F.col(n).isNull(), f"missing:{n}").when(F.col(n) > 1, f"repeated:{n}") for n in ("packet", "key", "results"))))
    return met.select(on, F.array_join(issue, ",").alias("issue")).where("issue <> ''")


def unknown_references(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows that refer to what isn't there."""
    return rows.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


def frozen_issues(rows: DataFrame, recomputed: dict[str, Column]) -> DataFrame:
    """Rows one of whose derived fields differs from what it is computed from now, with the names."""
    wrong = F.array_compact(F.array(*(F.when(~F.col(n).eqNullSafe(c), n) for n, c in recomputed.items())))
    return rows.withColumn("changed", wrong).where(F.size("changed") > 0)


def minimal_edit_issue(source: dict[str, Column], improved: dict[str, Column], target: Column, similarity: Column, length_ratio: Column, stable: Column) -> Column:
    """Why an edit isn't a minimal one that mends a single fault, or null.

    The source is stable (8), just below the floor in the target dimension (7) and not in the other; the edit is 8 in all, better in the target and
    equal elsewhere, stable, and near to its source in length and text.
    """
    role = target == "role_consistency"
    pick = lambda s, own: F.when(role == own, s["role_consistency"]).otherwise(s["dialogue_quality"])
    hard = (source["generation_stability"] < 8) | (pick(source, True) != 7) | (pick(source, False) < 8)
    low = (improved["generation_stability"] < 8) | (improved["role_consistency"] < 8) | (improved["dialogue_quality"] < 8)
    single = (pick(improved, True) < pick(source, True) + 1) | (pick(improved, False) != pick(source, False)) | (improved["generation_stability"] != source["generation_stability"])
    return (
        F.when(hard, "source_not_single_fault").when(low, "improved_below_floor").when(single, "other_dimension_changed").when(~stable, "unstable")
        .when(similarity < MIN_SIMILARITY, "too_different").when(~length_ratio.between(MIN_LENGTH_RATIO, MAX_LENGTH_RATIO), "length_changed")
    )
