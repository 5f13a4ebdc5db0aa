"""Row sets on their way into training: positional joins, appended suffixes, limits and quotas, capped lengths, editability packets and exports, reruns over frozen baselines."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.window import Window

from ..functions import pandas_text as P
from ..functions import text as T
from ..functions.profiles import DRIVER, RuleProfile
from ..sources.scratch import materialise, short_batches
from . import curation, evaluation, ordinals, pairs, rows


#: Letters that a tokenizer encodes at once.
AT_ONCE = 1 << 17
#: Ranges that a pass with a limit doubles through, at most.
PORTIONS = 12


@dataclass(frozen=True)
class ChatTemplate:
    """What stands before a role, between role and content, and after the content; and the role that answers."""

    before: str = "<|im_start|>"
    between: str = "\n"
    after: str = "<|im_end|>\n"
    answer: str = "assistant"


CHAT = ChatTemplate()

# --- joins ------------------------------------------------------------------------------------------


def zip_rows(left: DataFrame, right: DataFrame, pos: str) -> DataFrame:
    """Rows of two tables by their position, strictly: ``issue`` names a side that lacks a position."""
    a = left.withColumn("_l", F.lit(True))
    b = right.withColumn("_r", F.lit(True))
    issue = F.when(F.col("_l").isNull(), "missing_left").when(F.col("_r").isNull(), "missing_right")
    return a.join(b, pos, "full").withColumn("issue", issue).drop("_l", "_r")


def enriched(packet: DataFrame, facts: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``packet`` with fields of its key, null where they aren't known."""
    return packet.join(facts.select(key, *fields), key, "left")


def appended(base: DataFrame, extra: DataFrame, pos: str) -> DataFrame:
    """``base`` and then ``extra``, whose positions begin after the last of ``base``."""
    upto = base.agg(F.coalesce(F.max(pos), F.lit(0)).alias("_n"))
    after = extra.crossJoin(upto).withColumn(pos, F.col(pos) + F.col("_n")).drop("_n")  # one row
    return base.unionByName(after)


def suffix_issues(combined: DataFrame, base: DataFrame, extra: DataFrame, pos: str, fields: Sequence[str]) -> DataFrame:
    """Positions at which a table isn't ``base`` followed by ``extra``: rows (pos, issue)."""
    want = appended(base.select(pos, *fields), extra.select(pos, *fields), pos).select(pos, F.struct(*fields).alias("_w"), F.lit(True).alias("_in_w"))
    have = combined.select(pos, F.struct(*fields).alias("_h"), F.lit(True).alias("_in_h"))
    issue = F.when(F.col("_in_h").isNull(), "missing").when(F.col("_in_w").isNull(), "unexpected").when(~F.col("_h").eqNullSafe(F.col("_w")), "changed")
    return have.join(want, pos, "full").select(pos, issue.alias("issue")).where("issue is not null")


# --- sets, limits, quotas ---------------------------------------------------------------------------


def distribution_issues(data: DataFrame, category: str, expected: Mapping[str, int]) -> DataFrame:
    """Categories whose number of rows isn't the expected one: rows (category, have, want)."""
    want = data.sparkSession.createDataFrame(list(expected.items()), f"{category} string, want long")
    have = data.groupBy(F.col(category).cast("string").alias(category)).agg(F.count(F.lit(1)).alias("have"))
    met = have.join(want, category, "full").select(category, F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("want", F.lit(0)).alias("want"))
    return met.where("have <> want")


def uniqueness_issues(data: DataFrame, key: Column) -> DataFrame:
    """Keys of more than one row, by digest: rows (key, n)."""
    return data.groupBy(F.sha2(key, 256).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def placed(data: DataFrame, order: Sequence[str]) -> DataFrame:
    """``data`` with ``place``, from 1, in an order over all rows."""
    return ordinals.ranked(data, [F.col(c) for c in order], "place")


def first_accepted(data: DataFrame, accepted: Column, order: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """What a pass in order that stops at ``limit`` accepted rows takes, and one row of what it has seen: (accepted, refused).

    Rows are taken in ranges of the order, each as large as all before it, and the test is made in a range only if those before it didn't suffice: so it sees at most about twice the rows that the
    pass sees, and a costly test, such as a call, isn't paid for the rest. The ranges come from quantiles of a number or time, for which one scan of that column is read; another kind of
    order is one range. Nulls come first.
    """
    o, cuts = F.col(order), []
    if isinstance(data.schema[order].dataType, (types.NumericType, types.DateType, types.TimestampType)):
        cuts = sorted(set(data.agg(F.percentile_approx(order, [2.0**-k for k in range(PORTIONS, 0, -1)], 10_000)).first()[0] or []))
    portions, n, low = [], 0, None
    for cut in [*cuts, None]:
        own = data if low is None else data.where(o > F.lit(low))
        own = own if cut is None else own.where((o <= F.lit(cut)) | (o.isNull() if low is None else F.lit(False)))
        tested = own.withColumn("_ok", F.coalesce(accepted, F.lit(False)))
        portions.append(materialise(tested.select(o.alias("_o"), "_ok", F.when(F.col("_ok"), F.struct(*(F.col(f"`{c}`") for c in data.columns))).alias("_row")), "accepted"))
        n += portions[-1].where("_ok").count()
        if n >= limit:
            break
        low = cut
    rows_ = reduce(DataFrame.unionByName, portions)
    taken = rows_.where("_ok").orderBy("_o").limit(limit).select("_o", "_row")
    end = taken.agg(F.max("_o").alias("_end"), F.count(F.lit(1)).alias("_n"))
    seen = rows_.crossJoin(F.broadcast(end)).where((F.col("_n") < limit) | F.coalesce(F.col("_o") <= F.col("_end"), F.lit(True)))  # one row
    return taken.select("_row.*"), seen.agg(F.count_if("_ok").alias("accepted"), F.count_if(~F.col("_ok")).alias("refused"))


def quotas(categories: DataFrame, category: str, total: int) -> DataFrame:
    """``categories`` (one row each) with their share of ``total`` rows, the remainder to the first by name."""
    n = categories.agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.orderBy(category))  # a row per category
    own = categories.withColumn("_i", rank).crossJoin(n)
    return own.withColumn("quota", (F.floor(F.lit(total) / F.col("_n")) + F.when(F.col("_i") <= F.lit(total) % F.col("_n"), 1).otherwise(0)).cast("long")).drop("_i", "_n")


def pool_quota(shares: DataFrame, category: str, count: str) -> DataFrame:
    """What a pool must hold of each category to serve every split."""
    return shares.groupBy(category).agg(F.sum(count).cast("long").alias("wanted"))


# --- columns ----------------------------------------------------------------------------------------


def batch_seed(base: int, number: Column, limit: int) -> Column:
    """The seed of batch ``number``, from 1; null outside of 1 to ``limit``."""
    return F.when(number.between(1, limit), F.lit(base) + number - 1)


def with_default(value: Column, default: object) -> Column:
    return F.coalesce(value, F.lit(default))


def log_record(reward: Column, totals: Mapping[str, Column]) -> Column:
    """A reward's struct and totals as one JSON line of a log; null fields stay."""
    return F.to_json(F.struct(reward.alias("reward"), *(c.alias(n) for n, c in totals.items())), {"ignoreNullFields": "false"})


def rekeyed(key: Column, prefixes: Mapping[str, str], transposed: Sequence[str] = ()) -> Column:
    """struct(key, transposed): a tensor's name under another prefix, null where none fits, and whether its kind is stored transposed."""
    out = F.lit(None).cast("string")
    for old, new in prefixes.items():
        out = F.coalesce(out, F.when(key.startswith(old), F.concat(F.lit(new), F.substring(key, len(old) + 1, 10_000))))
    turned = F.lit(False)
    for suffix in transposed:
        turned = turned | key.endswith(suffix)
    return F.struct(out.alias("key"), turned.alias("transposed"))


def release_name(prefix: Column, run: Column) -> Column:
    """Tag of a release; its bundle has the same name."""
    return F.concat_ws("-", prefix, run)


def with_vocabulary(document: Column, codes: Sequence[str]) -> Column:
    """A packet's document (struct) with the codes a reviewer may give."""
    return document.withField("severe_codes", F.array(*map(F.lit, codes)))


def canonical_json(value: Mapping[str, Any]) -> str:
    """A record of the driver with sorted keys and no blanks, as digests are taken of."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def run_manifest(quota: Mapping[str, int], near: Mapping[str, float], filters: Sequence[str], seed: int) -> dict[str, Any]:
    """What a curation run was asked for."""
    return {"quotas": dict(quota), "near_duplicates": dict(near), "filters": list(filters), "seed": seed}


# --- contracts --------------------------------------------------------------------------------------


def word_cap_issues(data: DataFrame, ident: str, columns: Sequence[str], most: int, count=None) -> DataFrame:
    """Rows one of whose texts has more than ``most`` tokens: (ident, n). ``count`` makes a column of token counts of a text; without one words count."""
    count = count or (lambda x: F.regexp_count(x, F.lit(rf"(?U)[^{T.WS[1:-1]}]+")))
    return data.select(ident, F.array_max(F.array(*(F.coalesce(count(F.col(c)), F.lit(0)) for c in columns))).cast("long").alias("n")).where(F.col("n") > most)


@lru_cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_count(path: str):
    """Token counts by a tokenizer file, for ``word_cap_issues``; each worker loads the file once, and holds the encodings, of over 100 bytes a token, of AT_ONCE letters or one text."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        texts = x.fillna("")
        portion = (texts.str.len().cumsum() // AT_ONCE).to_numpy()
        encoded = (_tokenizer(path).encode_batch_fast(list(own), add_special_tokens=False) for _, own in texts.groupby(portion))
        return pd.Series([len(e.ids) for batch in encoded for e in batch], dtype="int64")

    return run


def chat_text(messages: Column, add_prompt: bool = False, template: ChatTemplate = CHAT) -> Column:
    """Messages (role, content) as the one text that a model is trained on; with ``add_prompt`` it ends where an answer begins."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(template.before), F.coalesce(m["role"], F.lit("")), F.lit(template.between), F.coalesce(m["content"], F.lit("")), F.lit(template.after))), "")
    return F.concat(body, F.lit(template.before + template.answer + template.between)) if add_prompt else body


def pair_lengths(pairs_: DataFrame, ident: str, messages: str, rejected: str, most: int, count, template: ChatTemplate = CHAT) -> DataFrame:
    """Rows (ident, prompt_tokens, chosen_tokens, rejected_tokens, issue) of preference pairs: lengths of the rendered prompt and of it with either answer, and which of the two is over ``most``.

    ``messages`` ends with the chosen answer, which ``rejected`` stands in for. ``count`` counts the tokens of a text column (tokenizer_count).
    """
    short_batches(pairs_.sparkSession, 500)
    prompt = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    other = F.concat(prompt, F.array(rows.message("assistant", F.col(rejected))))
    own = pairs_.select(F.col(ident), chat_text(prompt, True, template).alias("_p"), chat_text(F.col(messages), False, template).alias("_c"), chat_text(other, False, template).alias("_r"))
    counted = own.select(ident, count(F.col("_p")).alias("prompt_tokens"), count(F.col("_c")).alias("chosen_tokens"), count(F.col("_r")).alias("rejected_tokens"))
    over = F.array_compact(F.array(*(F.when(F.col(f"{n}_tokens") > most, n) for n in ("chosen", "rejected"))))
    return counted.withColumn("issue", F.when(F.size(over) > 0, F.array_join(over, ",")))


def reward_rows(prompts: DataFrame, ident: str, user: str, system: str, exactly: int | None = None) -> DataFrame:
    """Rows of reward training (id, messages) from prompts whose ids and users are unique, ``exactly`` so many; else the query fails."""
    facts = prompts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(ident).alias("ids"), F.count_distinct(T.collapse(F.col(user))).alias("users"), F.count_if(F.trim(user) == "").alias("blank"))
    bad = (F.col("ids") != F.col("n")) | (F.col("users") != F.col("n")) | (F.col("blank") > 0) | (F.lit(False) if exactly is None else F.col("n") != exactly)
    checked = facts.select(F.when(bad, F.raise_error(F.lit("prompts break their contract")).cast("int")).otherwise(0).alias("_ok"))
    built = prompts.select(F.col(ident).alias("id"), F.array(rows.message("system", F.lit(system)), rows.message("user", F.col(user))).alias("messages"))
    return built.crossJoin(F.broadcast(checked)).where("_ok = 0").drop("_ok")  # one row


def addition_issue(user: Column, assistant: Column, finish: Column, profile: RuleProfile = DRIVER) -> Column:
    """Why a targeted addition is refused, or null: a blank user, an answer that the answer gate refuses, a missing signature or a wrong name for itself."""
    return (
        F.when(F.coalesce(T.strip(user), F.lit("")) == "", "blank_user").when(curation.answer_issue(F.coalesce(assistant, F.lit("")), finish).isNotNull(), "answer")
        .when(~assistant.contains(profile.inspected_signature), "no_signature").when(T.contains_any(assistant, profile.inspected_wrong), "wrong_alias")
    )


def targeted_additions(data: DataFrame, ident: str, user: str, assistant: str, finish: str, system: str, profile: RuleProfile = DRIVER) -> DataFrame:
    """Additions that pass their gate, as messages, with ``issue`` for the others; of one user's the first by id passes."""
    own = data.withColumn("issue", addition_issue(F.col(user), F.col(assistant), F.col(finish), profile)).withColumn("_u", F.sha2(T.collapse(F.col(user)), 256))
    first = own.where("issue is null").groupBy("_u").agg(F.min(ident).alias("_first"))
    met = own.join(first, "_u", "left").withColumn("issue", F.coalesce("issue", F.when(F.col(ident) != F.col("_first"), "repeated_user")))
    messages = F.array(rows.message("system", F.lit(system)), rows.message("user", F.col(user)), rows.message("assistant", F.col(assistant)))
    return met.select(F.col(ident).alias("id"), "issue", F.when(F.col("issue").isNull(), messages).alias("messages"))


def teacher_rerun(frozen: DataFrame, answers: DataFrame, pos: str, digest: str, baseline: str, improved: str) -> DataFrame:
    """A teacher's new answers beside frozen baselines, by position: a baseline must have the digest it was frozen with. Rows (pos, issue, decision)."""
    met = zip_rows(frozen.select(pos, digest, baseline), answers.select(pos, improved), pos)
    issue = F.coalesce("issue", F.when(F.sha2(F.col(baseline), 256) != F.col(digest), "baseline_changed"), F.when(F.coalesce(T.strip(F.col(improved)), F.lit("")) == "", "empty_answer"))
    return met.select(pos, issue.alias("issue"), F.when(issue.isNull(), F.when(F.col(improved) == F.col(baseline), "keep").otherwise("edit")).alias("decision"))


def editability_packet(candidates: DataFrame, prompt: str, ident: str, text: str, finish: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Stable candidates under blind labels (prompt, ident, label, text), and the prompts that have none."""
    ok = evaluation.stable(F.col(text), F.col(finish), P.has_repeated_span(F.col(text)))
    good = candidates.where(ok)
    labelled = pairs.position_labels(good, prompt, F.col(ident), seed).select(prompt, ident, "label", text)
    lost = candidates.select(prompt).distinct().join(good.select(prompt).distinct(), prompt, "left_anti")
    return labelled, lost


def editability_export(edits: DataFrame, reviewed: DataFrame, ident: str, digest: str, similarity: float, lengths: tuple[float, float], system: str) -> DataFrame:
    """Preference rows of reviewed edits: the ids of both tables are the same, each text has the digest that was reviewed, and the thresholds hold again.

    ``edits`` has the id, user, source and improved text, similarity and length_ratio; ``reviewed`` the id and the digest of both texts. Rows (ident, issue, messages,
    rejected_response); those with an issue have no messages.
    """
    both = edits.join(reviewed.select(ident, F.col(digest).alias("_d"), F.lit(True).alias("_r")), ident, "full")
    own = F.sha2(F.concat("source", F.lit("\n"), "improved"), 256)
    issue = (
        F.when(F.col("_r").isNull(), "not_reviewed").when(F.col("source").isNull(), "unknown_review").when(own != F.col("_d"), "changed").when(F.col("similarity") < similarity, "too_different")
        .when(~F.col("length_ratio").between(*lengths), "length_changed")
    )
    messages, rejected = rows.preference_row(F.lit(system), F.col("user"), F.col("improved"), F.col("source"))
    done = both.withColumn("issue", issue)
    return done.select(ident, "issue", F.when(F.col("issue").isNull(), messages).alias("messages"), F.when(F.col("issue").isNull(), rejected).alias("rejected_response"))


def review_semantics(decision: Column, target: Column, quality: Column, evidence: Column) -> Column:
    """What a review's decision asks of its fields, or null: an exclusion says why and scores nothing, an inclusion names a target and a quality."""
    return (
        F.when(~F.coalesce(decision.isin("include", "exclude"), F.lit(False)), "decision").when((decision == "exclude") & (F.coalesce(T.strip(evidence), F.lit("")) == ""), "exclusion_without_evidence")
        .when((decision == "exclude") & quality.isNotNull(), "exclusion_with_quality").when((decision == "include") & (target.isNull() | quality.isNull()), "inclusion_incomplete")
    )


def setting_issues(actual: Column, expected: Mapping[str, str]) -> Column:
    """Names of the settings of a map that aren't the expected ones, sorted."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~F.element_at(actual, k).eqNullSafe(F.lit(v)), k) for k, v in expected.items()))))


# --- requests ---------------------------------------------------------------------------------------


def request(task: str, parts: Mapping[str, Column], answer: str) -> Column:
    """A request to an external model: the task, the data as JSON of one object so that nothing in it reads as a task, and the form of the answer."""
    data = F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())), {"ignoreNullFields": "false"})
    return F.concat_ws("\n\n", F.lit(task), F.concat(F.lit("Data:\n"), data), F.lit(answer))


def teacher_request(persona: Column, user: Column, answer: Column, scores: Sequence[str]) -> Column:
    return request("Audit the answer and mend only what is wrong.", {"persona": persona, "user": user, "answer": answer}, "Answer with a JSON object: scores (" + ", ".join(scores) + "), issues, decision, improved_assistant, final_checks.")


def judge_prompt(user: Column, answer: Column, scores: Mapping[str, int]) -> Column:
    return request("Judge the answer.", {"user": user, "answer": answer}, "Answer with a JSON object: " + ", ".join(f"{n} (0 to {m})" for n, m in scores.items()) + ", violations, reason.")


def group_judge_prompt(user: Column, answers: Sequence[Column], labels: Sequence[str]) -> Column:
    return request("Rank the answers in tiers, the best first.", {"user": user, **dict(zip(labels, answers))}, "Answer with a JSON object: tiers, a list of lists that holds each of " + ", ".join(labels) + " once.")


def generation_request(category: Column, goals: Column, n: int) -> Column:
    return request(f"Write {n} user messages.", {"category": category, "goals": goals}, "Answer with a JSON array of objects with the field user.")


def reward_spec(weights: Mapping[str, float], constants: Mapping[str, float], codes: Sequence[str]) -> dict[str, Any]:
    """A reward's formula as data: weights of its scores, constants and the codes that it knows."""
    return {"score": "(1 - v) / (1 + v)", "weights": dict(weights), "constants": dict(constants), "codes": list(codes)}
