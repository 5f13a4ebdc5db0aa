"""Every query of the engine over the driver's tables. Each takes (spark, sf_dir) and runs over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import pandas_text as P
from ..functions import text as T
from ..operators import contracts, curation, evaluation, isolation, pairs, reports, reviews, rows
from ..streaming import logs
from . import bindings as B
from . import oracles, record_queries, workflows

Query = Callable[[SparkSession, str], DataFrame]


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.inspect(B.documents(spark, sf_dir), "text", "finish_reason")


def q_compare_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir)
    whole = flags.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("pair")
    flags = flags.join(whole, "pair")
    expected = F.col("b_records")  # both sides hold a row of every whole pair
    return evaluation.behaviour_gate(evaluation.summarise(flags.where("side = 0")), evaluation.summarise(flags.where("side = 1")), expected)


def q_inspect_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("nonempty", "stop", "strict_format", "truncated", "abnormal_symbols", "gibberish", "unclosed_brackets", "extra_tags", "signature", "wrong_self_reference", "degenerate")
    return _flags(spark, sf_dir).select("doc_id", *names)


def q_repeated_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.conversations(spark, sf_dir).select("conv_id", "turn", P.has_repeated_span(F.col("text")).alias("repeated_span"))


def q_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summarise(_flags(spark, sf_dir), "lang").withColumn("lang", F.coalesce("lang", F.lit("all")))


def q_grid_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.conversations(spark, sf_dir)
    return evaluation.grid_issues(c, ["conv_id", "turn"], evaluation.grid_of(c.select("conv_id"), c.select("turn")))


def q_align_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir)
    found = evaluation.alignment_issues(d.where("side = 0"), d.where("side = 1"), ["pair"], ["lang", "source"])
    return found.select("pair", F.array_join("mismatches", ",").alias("mismatches"))


def q_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents")
    return curation.exact_dedup(d.select("doc_id", F.sha2(T.collapse(F.col("text")), 256).alias("key")), F.col("key"), "doc_id").select("doc_id", "group_rows")


def q_dup_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents").select("doc_id", "source", (~T.has_unclosed_brackets(F.col("text"))).alias("ok"), F.sha2("text", 256).alias("digest"))
    found = pairs.duplicate_pointer(d, "source", F.col("digest"), F.col("ok"), "doc_id", "doc_id")
    return found.select("doc_id", "source", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


def _user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns, and after every fourth a near copy of it: the turns themselves have none."""
    p = B.prompts(spark, sf_dir)
    copies = p.where("id % 4 = 0").select((F.col("id") * 2 + 1).alias("pos"), F.regexp_replace("user", "ndth|is ", "dnht").alias("user"))
    return p.select((F.col("id") * 2).alias("pos"), "user").unionByName(copies)


def q_near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(curation.near_duplicate_edges(_user_turns(spark, sf_dir), "user", "pos"), 6, "ratio")


def q_greedy_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _user_turns(spark, sf_dir)
    return curation.greedy_accept(turns, curation.near_duplicate_edges(turns, "user", "pos"))


def q_similarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.conversations(spark, sf_dir)
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked")).join(answers, ["conv_id", "turn"])
    return _round(curation.similarity_gate(both, "asked", "answer", 0.5, 1.5, 0.4).select("conv_id", "turn", "length_ratio", "similarity", "gate"), 6, "length_ratio", "similarity")


def q_answer_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir)
    reason = F.coalesce(curation.answer_issue(F.col("text"), F.col("finish_reason")), F.lit("ok"))
    return d.groupBy("lang", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_contiguous_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir)
    return d.select("doc_id", T.has_contiguous_repeat(F.col("text")).alias("repeats"))


def q_prompt_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = curation.prompt_issue(F.col("user"), self_reference="hea", user_name="The", verbs=("th", "nd"), openers=("And ", "Of "))
    return B.prompts(spark, sf_dir).groupBy("scenario", F.coalesce(issue, F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curation.stratified_split(B.prompts(spark, sf_dir), "scenario", F.col("id"), [("train", 20), ("dev", 5), ("eval", 5)], 20260806)
    return out.select("id", "scenario", "split_rank", F.coalesce("split", F.lit("rest")).alias("split"))


def q_split_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir)
    key = T.collapse(F.col("text"))
    return isolation.isolated(d.where("side = 0"), [d.where("side = 1")], key, [key]).select("doc_id")


def q_contamination_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.contamination(B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def q_copy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = isolation.copy_coverage(B.conversations(spark, sf_dir), ["conv_id", "turn"], "text", B.table(spark, sf_dir, "benchmark"), "text")
    return _round(out.withColumn("penalty", S.copy_penalty(F.col("normalized_length"), F.col("coverage"))), 6, "coverage")


def q_sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return B.conversations(spark, sf_dir).select("conv_id", "turn", T.filled_length(t).alias("filled_length"), T.sentence_count(t).alias("sentences"))


def q_bracket_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.documents(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.has_unclosed_brackets(F.col("text"))).alias("unclosed"))


def q_alias_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return B.conversations(spark, sf_dir).select("conv_id", "turn", T.signature_count(t).alias("signatures"), T.wrong_alias_count(t).alias("wrong_aliases"), T.wrong_pronoun_count(t).alias("wrong_pronouns"))


def q_action_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.documents(spark, sf_dir).withColumn("parsed", T.actions(F.col("text"))).withColumn("facts", T.action_facts(F.col("text"), F.col("parsed")))
    return own.select("doc_id", *(F.col(f"facts.{n}").alias(f"{n}_value") for n in ("count", "total_length", "minimum_gap", "nested", "unbalanced", "invalid")))


def _constraints() -> Column:
    n = F.col("conv_id")
    some = n % 3 != 0
    return F.struct(
        F.when(some, 0).alias("min_actions"), F.when(some, 2).alias("max_actions"), F.lit(2).alias("min_sentences"), F.lit(6).alias("max_sentences"),
        F.lit(40).alias("min_chars"), (F.lit(200) + (n % 5) * 50).cast("int").alias("max_chars"), F.lit(1).alias("min_signatures"), F.lit(4).alias("max_signatures"),
    )


def q_rule_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.conversations(spark, sf_dir).withColumn("constraints", _constraints())
    r = S.rule_reward(c, "text", "constraints", "finish_reason")
    names = ("normalized_length", "sentence_count", "signature_count", "wrong_self_count", "instruction_score", "persona_score", "style_score", "recoverability", "raw_reward", "total_reward")
    out = r.select("conv_id", "turn", *(F.col(f"reward.{n}").alias(n) for n in names), F.array_join("reward.hard_invalid_reasons", ",").alias("hard_invalid_reasons"), F.array_join("reward.format_reasons", ",").alias("format_reasons"))
    return _round(out, 6, "instruction_score", "persona_score", "style_score", "recoverability", "raw_reward", "total_reward")


def q_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.filled_length(F.col("text"))
    return _round(B.documents(spark, sf_dir).select("doc_id", S.length_penalty(n).alias("length_penalty"), S.copy_penalty(n, (F.col("doc_id") % 10) / 10).alias("copy_penalty")), 6, "length_penalty")


def q_local_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.conversations(spark, sf_dir).withColumn("repeated", P.has_repeated_span(F.col("text")))
    key = F.col("conv_id") * 100 + F.col("turn")
    own = c.withColumn("readable", S.readable(F.col("text"), F.col("finish_reason"), F.col("repeated")))
    reward = S.judge_reward(F.col("readable"), B.drawn("role", key, 6), B.drawn("dialogue", key, 6), F.lit(0.0), S.length_penalty(T.filled_length(F.col("text"))))
    return _round(own.select("conv_id", "turn", "readable", reward.alias("reward")), 6, "reward")


def q_role_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array_compact(F.array(F.when(F.col("toxic") == 1, "identity_break"), F.when(F.col("quality") == 0, "romanticization")))
    k = F.col("doc_id")
    return B.table(spark, sf_dir, "labels").select("doc_id", S.capped_role(B.drawn("identity", k, 3), B.drawn("personality", k, 3), B.drawn("voice", k, 2), codes).alias("role"))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    d = B.documents(spark, sf_dir).select("pair", "side", F.round(T.sentence_count(t) - S.length_penalty(T.filled_length(t)), 6).alias("reward"))
    out = evaluation.reward_delta(d.where("side = 0"), d.where("side = 1"), ["pair"], "reward")
    return _round(out, 6, "reward_delta")


def q_reward_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir)


def q_reward_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluation.reward_gate(_deltas(spark, sf_dir)), 6, "mean_delta")


def q_rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.conversations(spark, sf_dir).select("conv_id", "turn", B.drawn("tier", F.col("conv_id") * 100 + F.col("turn"), 4).alias("score"))
    return _round(pairs.tie_rewards(c, "conv_id", "score", "turn").select("conv_id", "turn", "mean_position", "rank_reward"), 6, "mean_position", "rank_reward")


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return B.table(spark, sf_dir, "documents").select(
        F.floor(k / 8).alias("grp"), F.char(65 + k % 8).alias("label"), F.when(B.drawn("status", k, 2) == 0, "pass").otherwise("fail").alias("status"),
        B.drawn("quality", k, 11).alias("quality"), (B.drawn("reward", k, 1000) / 100.0).alias("reward"), (B.drawn("off", k, 5) == 0).alias("off"),
    )


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.choose_pairs(_reviews(spark, sf_dir), "grp", "label", "status", "quality", "reward", F.col("off"))


def q_best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = [x for s in ("chosen", "rejected") for x in (F.coalesce(f"{s}_label", F.lit("")).alias(f"{s}_label"), F.round(F.coalesce(f"{s}_reward", F.lit(-1.0)), 6).alias(f"{s}_reward"))]
    return _chosen(spark, sf_dir).select("grp", *side)


def q_pair_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _chosen(spark, sf_dir).select((F.col("grp") % 3).alias("issue"), (F.col("chosen_label").isNotNull() & F.col("rejected_label").isNotNull()).alias("included"), (F.col("grp") % 7 == 0).alias("teacher"))
    return pairs.readiness(p, "issue", "included", "teacher", 10, 1_000_000, 2, 3)


def _pairs_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.documents(spark, sf_dir).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("pair")


def q_preference_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pair")
    c, r = ({d: B.drawn(d + w, k, 11) for d in evaluation.DIMENSIONS} for w in ("c", "r"))
    issue = pairs.preference_issue(c, B.drawn("ci", k, 4) == 0, r, B.drawn("ru", k, 6) == 0)
    return _pairs_of_documents(spark, sf_dir).groupBy(F.coalesce(issue, F.lit("ok")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def q_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.conversations(spark, sf_dir)
    return c.select("conv_id").distinct().join(c.where("role = 'assistant' and turn >= 3").select("conv_id").distinct(), "conv_id", "left_anti")


def _review_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("pair")
    whole = _pairs_of_documents(spark, sf_dir)
    key = whole.select("pair", F.when(evaluation.coin(20260807, k) == 0, "A").otherwise("B").alias("candidate_label"))
    score = lambda s: F.struct(*(B.drawn(d + s, k, 11).alias(d) for d in evaluation.DIMENSIONS))
    severe = lambda s: F.array_compact(F.array(F.when(B.drawn("sev" + s, k, 9) == 0, "unreadable"), F.when(B.drawn("brk" + s, k, 7) == 0, "role_break")))
    winner = F.element_at(F.array(*map(F.lit, ("A", "B", "tie"))), (B.drawn("winner", k, 3) + 1).cast("int"))
    worse = F.when(B.drawn("worse", k, 8) == 0, "A").when(B.drawn("worse", k, 8) == 1, "B")
    results = whole.select("pair", winner.alias("winner"), worse.alias("clearly_worse"), *(x for s in "ab" for x in (score(s).alias(f"scores_{s}"), severe(s).alias(f"severe_{s}"))))
    return results, key


def _review(spark: SparkSession, sf_dir: str, new_only: bool) -> DataFrame:
    out = evaluation.review_outcome(*_review_rows(spark, sf_dir), "pair", new_only)
    return _round(out, 6, *(f"{w}_{d}" for w in ("base", "candidate") for d in evaluation.DIMENSIONS))


def q_ab_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir, False)


def q_ab_review_new_severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir, True)


def q_review_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, key = _review_rows(spark, sf_dir)
    out = workflows.submit_review(results, key, key, "pair", automatic=True)
    return _round(out, 6, *(f"{w}_{d}" for w in ("base", "candidate") for d in evaluation.DIMENSIONS))


def q_blind_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir).withColumn("digest", F.md5("text"))
    return evaluation.review_packet(d.where("side = 0"), d.where("side = 1"), ["pair"], "digest", 20260807, F.col("pair"))


def q_group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.group_size_issues(B.conversations(spark, sf_dir), ["conv_id"], exactly=2)


def q_last_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.last_user(B.conversations(spark, sf_dir), ["conv_id"], "role", "text", "turn")


def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.conversations(spark, sf_dir)
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    built = c.groupBy("conv_id").agg(listed.alias("messages"))
    return built.select("conv_id", F.size("messages").cast("long").alias("n"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"), 256).alias("digest"))


def q_json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (contracts.Field("k", "int", low=10, high=60), contracts.Field("user", "string"))
    v = contracts.validate(B.table(spark, sf_dir, "events"), "props", fields)
    return v.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


def q_prompt_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.prompts(spark, sf_dir)
    raw = F.concat(F.lit("```json\n"), F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.array(F.struct("user"), F.struct(F.lit(" ").alias("user"))).alias("prompts")))).otherwise(F.to_json(F.array("user"))), F.lit("\n```"))
    return c.select("id", F.size(contracts.prompt_list(raw)).alias("n"), F.md5(F.element_at(contracts.prompt_list(raw), 1)).alias("first_md5"))


def q_candidate_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.set_digest(B.conversations(spark, sf_dir), ["conv_id"], "turn", F.col("conv_id") * 100 + F.col("turn"), F.col("text"))


def q_first_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.first_of(B.table(spark, sf_dir, "documents"), ["lang"], [F.col("doc_id")], ["doc_id", "source"])


def q_label_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.position_labels(B.conversations(spark, sf_dir), "conv_id", F.col("conv_id") * 100 + F.col("turn"), 20260810).select("conv_id", "turn", "label")


def q_candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    n = B.conversations(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return n.select("conv_id", "turn", pairs.candidate_id(F.col("conv_id"), F.col("i")).alias("candidate_id"), pairs.candidate_seed(F.col("conv_id"), F.col("i")).alias("seed"))


def q_embedding_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    a = e.where("vec_id % 2 = 0").select(F.floor(F.col("vec_id") / 2).alias("pair"), F.col("v").alias("x"))
    b = e.where("vec_id % 2 = 1").select(F.floor(F.col("vec_id") / 2).alias("pair"), F.col("v").alias("y"))
    d = a.join(b, "pair").select("pair", F.zip_with("x", "y", lambda x, y: y - x).alias("d"))
    finite = F.forall("d", lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    return d.select("pair", F.size(F.filter("d", lambda v: v != 0)).cast("long").alias("changed"), F.round(F.array_max(F.transform("d", F.abs)), 6).alias("max_abs"), finite.alias("finite"))


def q_reward_log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluation.log_stats(B.table(spark, sf_dir, "events"), "event_type", "value"), 6, "minimum", "mean", "maximum")


def q_stream_reward_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = logs.running_stats(logs.read_stream(spark, sf_dir, "events"), "event_type", "value")
    return _round(_round(logs.drain(stats, "complete", "reward-stats"), 6, "minimum", "maximum"), 4, "total")


def q_stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = logs.first_seen(logs.read_stream(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "3650 days")
    return logs.drain(seen.select("user_id", "event_type"), "append", "first-seen")


def q_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.documents(spark, sf_dir).agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count_distinct("source").alias("sources"))


def q_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return B.documents(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t.contains("the")).alias("with_signature"), F.count_if(T.contains_any(t, ("idiot", "scum"))).alias("with_wrong"),
        F.round(F.avg(F.length(t)), 2).alias("mean_length"), F.max(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("max_tokens"),
    )


def q_training_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.documents(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("steps", (F.ceil(F.ceil(F.col("n") / 2) / 8) * 3).cast("long"))


def q_last_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.last_status(B.table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


def q_generated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = logs.generate(B.prompts(spark, sf_dir), "id", "user", 4)
    return made.select("prompt", "candidate_index", F.md5("raw").alias("raw_md5"))


def q_preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir)
    chosen, rejected = (d.where(f"side = {k}").select("pair", F.col("text").alias(n), F.col("lang").alias(f"{n}_lang")) for k, n in ((0, "chosen"), (1, "rejected")))
    messages, answer = rows.preference_row(F.lit("system"), F.when(F.col("pair") % 5 != 0, F.col("chosen_lang")), F.col("chosen"), F.when(F.col("pair") % 7 == 0, F.col("chosen")).otherwise(F.col("rejected")))
    built = chosen.join(rejected, "pair").select("pair", messages, answer)
    return built.groupBy(F.coalesce(rows.preference_row_issue(F.col("messages"), F.col("rejected_response")), F.lit("ok")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def q_persona_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    r = B.table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    none = F.array().cast("array<string>")
    text = rows.render_persona(F.col("r_name"), {"identity": F.col("names"), "facts": none, "notes": F.when(F.col("r_regionkey") % 2 == 0, F.slice("names", 1, 1))}, "You are %s.", ("Stay in character.",))
    return r.select("r_regionkey", text.alias("prompt"))


def q_unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = B.table(spark, sf_dir, "customer").where("c_acctbal > 0")
    lost = reviews.unknown_references(B.table(spark, sf_dir, "orders"), "o_custkey", known, "c_custkey")
    return lost.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def q_contiguous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.conversations(spark, sf_dir).where("role = 'assistant'").withColumn("ident", F.format_string("c_%04d", F.floor(F.col("turn") / 2) + 1))
    return rows.contiguous_issues(c, "ident", "c_", "turn", "conv_id").select("conv_id", "turn", "ident", "expected_id")


def q_minimal_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pair")
    s, i = ({d: B.drawn(d + w, k, 3) + (6 if w == "s" else 7) for d in evaluation.DIMENSIONS} for w in ("s", "i"))
    target = F.when(B.drawn("target", k, 2) == 0, "role_consistency").otherwise("dialogue_quality")
    issue = reviews.minimal_edit_issue(s, i, target, B.drawn("sim", k, 101) / 100.0, B.drawn("len", k, 200) / 100.0, B.drawn("st", k, 5) > 0)
    return _pairs_of_documents(spark, sf_dir).groupBy(F.coalesce(issue, F.lit("ok")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def q_series_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.series_ok(B.table(spark, sf_dir, "events"), "user_id", "value", 10)


def q_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest(B.table(spark, sf_dir, "events"), "user_id", "event_type", "value", "event_id")


def q_reported_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    last = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("total"))
    return reports.reported_steps(lines.join(last, "l_orderkey"), "l_orderkey", "l_linenumber", F.col("total")).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def q_judge_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    scores = [B.drawn(n, k, high + 2).alias(n) for n, high in reviews.JUDGE_SCORES.items() if n != "character_voice"]
    voice = (B.drawn("character_voice", k, 2) == 0).alias("character_voice")  # a boolean, where a number belongs
    codes = F.when(B.drawn("code", k, 3) == 0, F.array(F.lit("identity_break"))).when(B.drawn("code", k, 3) == 1, F.array(F.lit("rude"))).otherwise(F.array().cast("array<string>")).alias("violations")
    raw = F.to_json(F.struct(*scores, voice, codes, F.when(k % 4 == 0, " ").otherwise("why").alias("reason")))
    issues = reviews.judge_issues(raw)
    return B.documents(spark, sf_dir).select("doc_id", F.size(issues).cast("long").alias("n_issues"), F.array_join(issues, ",").alias("issues"))


def q_pilot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    decision = F.element_at(F.array(*map(F.lit, ("keep", "light_edit", "rewrite"))), (B.drawn("decision", k, 3) + 1).cast("int"))
    items = B.table(spark, sf_dir, "labels").select((k % 5).alias("scenario"), decision.alias("decision"), (F.col("toxic") == 0).alias("passed"), *(B.drawn(d, k, 11).alias(d) for d in evaluation.DIMENSIONS))
    return reports.pilot_report(items, ("keep", "light_edit", "rewrite"), evaluation.DIMENSIONS)


def q_editability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    items = B.table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("successful"), (B.drawn("sim", k, 101) / 100.0).alias("similarity"), (B.drawn("len", k, 200) / 100.0).alias("length_ratio"))
    return reports.editability_report(items, 10, 25)


def q_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents").select("doc_id")
    return reviews.triple_issues(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"), d.where("doc_id % 5 = 0").unionByName(d.where("doc_id % 10 = 0")), "doc_id")


def q_constraint_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    bound = lambda n: F.when(B.drawn(n + "null", k, 5) > 0, B.drawn(n, k, 9)).cast("int")
    c = F.struct(*(bound(f"{m}_{n}").alias(f"{m}_{n}") for n in S.CONSTRAINT_NAMES for m in ("min", "max")))
    issue = contracts.paired_range_issue(F.col("c"), S.CONSTRAINT_NAMES, ("chars", "signatures"))
    return B.documents(spark, sf_dir).select("doc_id", c.alias("c")).groupBy(F.coalesce(issue, F.lit("ok")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def q_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.array(rows.message("system", F.lit("s")), rows.message("user", F.col("lang")), rows.message("assistant", F.col("text")))
    d = B.documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.reverse(m)).otherwise(m).alias("messages"))
    return workflows.training_row_issues(d, "messages").groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def q_curation_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _user_turns(spark, sf_dir).withColumn("scenario", F.col("pos") % 5)
    split, _ = workflows.curate(turns, "user", "scenario", "pos", [("train", 20), ("dev", 5)], 20260806, curation.prompt_issue(F.col("user"), self_reference="hea", verbs=("th", "nd")))
    return split.select("pos", "scenario", "split", "record_id")


def q_prepared_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = logs.generate(B.prompts(spark, sf_dir).withColumn("user", F.concat("user", F.lit(" (nods) yes."))), "id", "user", 4).withColumn("finish_reason", F.lit("stop"))
    made = made.withColumn("conv_id", F.floor(F.col("prompt") / 100)).withColumn("constraints", _constraints())
    out = workflows.prepare_candidates(made, "prompt", "candidate_index", "raw", "finish_reason", "constraints", 20260810)
    return out.select("prompt", "candidate_id", "hard_valid", "duplicate_of", "eligible", "label", F.round("reward.total_reward", 6).alias("total_reward"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("q_")} | record_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES | record_queries.SQL
