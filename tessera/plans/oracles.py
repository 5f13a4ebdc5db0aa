"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from .bindings import drawn_sql as drawn

_STRIP = "trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31))"
_VISIBLE = "regexp_replace({x}, '[\\t-\\r\\x1c-\\x1f\\x{{85}}\\x{{200d}}]', '', 'g')"
_WS = "[\\t-\\r \\x1c-\\x1f]"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


def _control(x: str) -> str:
    return f"regexp_matches({_VISIBLE.format(x=x)}, '[\\x{{FFFD}}\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]')"


def _abnormal(x: str) -> str:
    return f"({_control(x)} OR regexp_matches({x}, '[\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]|[\\pP\\pS]{{4}}'))"


def _gibberish(x: str) -> str:
    return f"({_control(x)} OR regexp_matches({x}, '(?:\\p{{Greek}}|\\p{{Cyrillic}}){{12}}|[\\pP\\pS]{{12}}'))"


def _open(x: str) -> str:
    parts = []
    for a, b in (("(", ")"), ("（", "）")):
        only = f"regexp_replace({x}, '[^{a}{b}]', '', 'g')"
        parts.append(f"(length(replace({only}, '{a}', '')) <> length(replace({only}, '{b}', '')) OR len(list_filter(range(1, length({only}) + 1), lambda i: length(replace(({only})[1:i], '{a}', '')) > length(replace(({only})[1:i], '{b}', '')))) > 0)")
    return "(" + " OR ".join(parts) + ")"


def _compact(x: str) -> str:
    return f"regexp_replace({x}, '{_WS}', '', 'g')"


def _repeated(c: str) -> str:
    loops = " OR ".join(f"substr({c}, i, {p * k}) = repeat(substr({c}, i, {p}), {k})" for p in range(1, 7) for k in [max(6, -(-24 // p))])
    # A unit at the very end is cut short by substr, so lengths must agree too; repeat() of a whole unit makes sure of that.
    return (
        f"(len(list_filter(range(1, greatest(length({c}) - 10, 1)), lambda i: length({c}) >= 12 AND (length({c}) - length(replace({c}, substr({c}, i, 12), ''))) // 12 >= 3)) > 0"
        f" OR len(list_filter(range(1, greatest(length({c}) - 22, 1)), lambda i: {loops})) > 0)"
    )


def _same_at(chars: str, p: int, length: int) -> str:
    """Whether so many characters in a row equal the one ``p`` places on, in a list of characters: one pass, and a search in a string of 0 and 1."""
    flags = f"list_transform(range(1, greatest(len({chars}) - {p}, 0) + 1), lambda j: CASE WHEN {chars}[j] = {chars}[j + {p}] THEN '1' ELSE '0' END)"
    return f"contains(array_to_string({flags}, ''), repeat('1', {length}))"


def _loops(chars: str) -> str:
    return "(" + " OR ".join(_same_at(chars, p, (max(6, -(-24 // p)) - 1) * p) for p in range(1, 7)) + ")"


def _contiguous(chars: str) -> str:
    return "(" + " OR ".join(_same_at(chars, p, 3 * p) for p in range(1, 21)) + ")"


def _repeats(key: str, table: str, text: str) -> str:
    """CTEs rp(key, repeated): a span of 12 characters with three occurrences apart, or a loop. Of a span's places the first, the last and one 12 or more from both will do."""
    return f"""lc AS (SELECT {key}, string_split({_compact(text)}, '') AS l FROM {table}),
gs AS (SELECT {key}, list_transform(range(1, greatest(len(l) - 10, 1)), lambda i: {" || ".join(f"l[i + {k}]" for k in range(12))}) AS gs FROM lc WHERE len(l) >= 12),
gp AS (SELECT {key}, g, list(i) AS places FROM (SELECT {key}, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM gs) GROUP BY {key}, g HAVING count(*) >= 3),
gr AS (SELECT DISTINCT {key} FROM gp WHERE len(list_filter(places, lambda x: x >= list_min(places) + 12 AND x <= list_max(places) - 12)) > 0),
rp AS (SELECT {key}, {key} IN (SELECT {key} FROM gr) OR {_loops('l')} AS repeated FROM lc)"""


def _without_quotes(x: str) -> str:
    for p in ("“[^”]*”", "‘[^’]*’", '"[^"\\r\\n]*"', "''[^''\\r\\n]*''"):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return x


def _occurrences(x: str, s: str) -> str:
    return f"((length({x}) - length(replace({x}, '{s}', ''))) // {len(s)})"


DOCS = "d AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, doc_id // 2 AS pair, doc_id % 2 AS side FROM documents)"
CONV = "c AS (SELECT *, CASE WHEN (conv_id + turn) % 10 = 0 THEN 'length' ELSE 'stop' END AS finish_reason FROM conversations)"
PROMPTS = "p AS (SELECT conv_id * 100 + turn AS id, conv_id % 5 AS scenario, text AS \"user\" FROM conversations WHERE role = 'user')"

_S = "s"
_STRICT = "\\(([^()（）\\r\\n]+)\\)([^()（）]+)"
FLAGS = f"""{DOCS}, t AS (SELECT *, {_strip("coalesce(text, '')")} AS s FROM d),
f0 AS (SELECT doc_id, lang, pair, side, s <> '' AS nonempty, finish_reason = 'stop' AS stop,
  regexp_full_match(s, '{_STRICT}') AND {_strip(f"regexp_extract(s, '{_STRICT}', 1)")} <> '' AND {_strip(f"regexp_extract(s, '{_STRICT}', 2)")} <> '' AND NOT regexp_matches(s, '<[^>\\r\\n]+>') AS strict_format,
  finish_reason IN ('length', 'max_tokens') AS truncated, {_abnormal(_S)} AS abnormal_symbols, {_gibberish(_S)} AS gibberish, {_open(_S)} AS unclosed_brackets,
  regexp_matches(s, '<[^>\\r\\n]+>') AS extra_tags, contains(s, 'the') AS signature, regexp_matches(s, 'idiot|scum') AS wrong_self_reference FROM t),
{_repeats("doc_id", "t", _S)},
f AS (SELECT f0.*, repeated AS repeated_span, repeated OR abnormal_symbols OR unclosed_brackets AS degenerate FROM f0 JOIN rp USING (doc_id))"""
_COUNTS = {
    "nonempty_count": "nonempty", "stop_count": "stop", "strict_format_count": "strict_format", "truncation_count": "truncated", "degeneration_count": "degenerate", "gibberish_count": "gibberish",
    "unclosed_bracket_count": "unclosed_brackets", "abnormal_symbol_count": "abnormal_symbols", "repetition_count": "repeated_span", "extra_tag_count": "extra_tags", "signature_count": "signature", "wrong_self_reference_count": "wrong_self_reference",
}
_RATES = {"strict_format_rate": "strict_format", "signature_rate": "signature", "wrong_self_reference_rate": "wrong_self_reference"}
METRICS = ", ".join(["count(*) AS records", *(f"count(*) FILTER (WHERE {f}) AS {n}" for n, f in _COUNTS.items()), *(f"round(count(*) FILTER (WHERE {f}) / count(*), 6) AS {n}" for n, f in _RATES.items())])

_FILLED = f"length({_compact('text')})"
_SENT = f"len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda p: {_strip('p')} <> ''))"
_LONG = f"least(2.0, greatest(0.0, ({_FILLED} - 180) / 60.0))"
_DELTA = f"""{DOCS}, r AS (SELECT pair, side, round({_SENT} - {_LONG}, 6) AS reward FROM d),
x AS (SELECT a.pair, a.reward AS base_reward, b.reward AS candidate_reward, round(b.reward - a.reward, 6) AS reward_delta FROM r a JOIN r b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
y AS (SELECT *, CASE WHEN reward_delta > 0 THEN 'candidate' WHEN reward_delta < 0 THEN 'base' ELSE 'tie' END AS winner FROM x)"""

_REVIEWS = f"""w AS (SELECT doc_id // 8 AS grp, chr((65 + doc_id % 8)::INT) AS label, CASE WHEN {drawn('status', 'doc_id', 2)} = 0 THEN 'pass' ELSE 'fail' END AS status,
  {drawn('quality', 'doc_id', 11)} AS quality, {drawn('reward', 'doc_id', 1000)} / 100.0 AS reward, {drawn('off', 'doc_id', 5)} = 0 AS off FROM documents),
ch AS (SELECT grp, label AS chosen_label, reward AS chosen_reward FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY quality DESC, reward DESC, label) AS n FROM w WHERE status = 'pass' AND quality >= 8 AND NOT off) WHERE n = 1),
rj AS (SELECT grp, label AS rejected_label, reward AS rejected_reward FROM (SELECT w.*, row_number() OVER (PARTITION BY w.grp ORDER BY quality DESC, CASE WHEN chosen_reward IS NULL THEN -reward ELSE abs(reward - chosen_reward) END, label) AS n
  FROM w LEFT JOIN ch USING (grp) WHERE status = 'fail' AND quality >= 7 AND NOT off) WHERE n = 1),
pr AS (SELECT coalesce(ch.grp, rj.grp) AS grp, chosen_label, chosen_reward, rejected_label, rejected_reward FROM ch FULL JOIN rj ON ch.grp = rj.grp)"""

_DIMS = ("generation_stability", "role_consistency", "dialogue_quality")


def _review(new_only: bool) -> str:
    severe = lambda s: f"list_filter(['unreadable', 'role_break'], lambda c: (c = 'unreadable' AND {drawn('sev' + s, 'pair', 9)} = 0) OR (c = 'role_break' AND {drawn('brk' + s, 'pair', 7)} = 0))"
    own, other = "CASE WHEN first THEN sa ELSE sb END", "CASE WHEN first THEN sb ELSE sa END"
    bad = f"len(list_filter({own}, lambda c: NOT list_contains({other}, c)))" if new_only else f"len({own})"
    score = lambda d, s: drawn(d + s, "pair", 11)
    cols = ", ".join(f"{score(d, s)} AS {d}_{s}" for d in _DIMS for s in "ab")
    means = ", ".join(
        f"round(avg(CASE WHEN first THEN {d}_{a} ELSE {d}_{b} END), 6) AS {who}_{d}" for who, a, b in (("candidate", "a", "b"), ("base", "b", "a")) for d in _DIMS
    )
    return f"""WITH k AS (SELECT doc_id // 2 AS pair FROM documents GROUP BY 1 HAVING count(*) = 2),
    q AS (SELECT pair, ('0x' || right(md5('20260807:' || pair), 1))::INT % 2 = 0 AS first, ['A', 'B', 'tie'][{drawn('winner', 'pair', 3)} + 1] AS winner,
      CASE {drawn('worse', 'pair', 8)} WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS worse, {severe('a')} AS sa, {severe('b')} AS sb, {cols} FROM k),
    g AS (SELECT count(*) AS reviewed_pairs, count(*) FILTER (WHERE winner = CASE WHEN first THEN 'A' ELSE 'B' END) AS wins, count(*) FILTER (WHERE worse = CASE WHEN first THEN 'A' ELSE 'B' END) AS clear_losses,
      count(*) FILTER (WHERE {bad} > 0) AS severe_pairs, {means} FROM q)
    SELECT *, true AS complete, wins >= 6 AND clear_losses <= 2 AND severe_pairs = 0 AND {' AND '.join(f'candidate_{d} >= base_{d}' for d in _DIMS)} AS passed FROM g"""


_KEY = _strip(f"regexp_replace(text, '{_WS}+', ' ', 'g')")
_GRAMS = "list_distinct(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i+7], ' ')))"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_COPY = "regexp_replace(text, '[\\t-\\r \\x1c-\\x1f\\pP]', '', 'g')"
_QUOTELESS = _without_quotes("text")

ORACLES: dict[str, str] = {
    "q_inspect_flags": f"WITH {FLAGS} SELECT doc_id, nonempty, stop, strict_format, truncated, abnormal_symbols, gibberish, unclosed_brackets, extra_tags, signature, wrong_self_reference, degenerate FROM f",
    "q_repeated_span": f"WITH t AS (SELECT conv_id, turn, {_compact('text')} AS c FROM conversations) SELECT conv_id, turn, {_repeated('c')} AS repeated_span FROM t",
    "q_quality_summary": f"WITH {FLAGS} SELECT coalesce(lang, 'all') AS lang, {METRICS} FROM f GROUP BY GROUPING SETS ((lang), ())",
    "q_compare_gate": f"""WITH {FLAGS}, g AS (SELECT pair FROM f GROUP BY pair HAVING count(*) = 2), h AS (SELECT f.* FROM f JOIN g USING (pair)),
      b AS (SELECT {METRICS} FROM h WHERE side = 0), c AS (SELECT {METRICS} FROM h WHERE side = 1), e AS (SELECT count(*) AS n FROM g),
      k AS (SELECT b.records = e.n AND c.records = e.n AND b.nonempty_count = e.n AND c.nonempty_count = e.n AS complete_and_aligned, c.stop_count >= b.stop_count AS stop_count_not_lower,
        c.truncation_count <= b.truncation_count AS truncation_count_not_higher, c.degeneration_count <= b.degeneration_count AS degeneration_count_not_higher, c.unclosed_bracket_count <= b.unclosed_bracket_count AS unclosed_bracket_count_not_higher,
        c.abnormal_symbol_count <= b.abnormal_symbol_count AS abnormal_symbol_count_not_higher, c.wrong_self_reference_count <= b.wrong_self_reference_count AS wrong_self_reference_count_not_higher,
        c.repetition_count = 0 AS no_repeated_spans, c.gibberish_count = 0 AS no_gibberish FROM b, c, e)
      SELECT *, complete_and_aligned AND stop_count_not_lower AND truncation_count_not_higher AND degeneration_count_not_higher AND unclosed_bracket_count_not_higher AND abnormal_symbol_count_not_higher AND wrong_self_reference_count_not_higher AND no_repeated_spans AND no_gibberish AS passed FROM k""",
    "q_grid_completeness": "WITH e AS (SELECT * FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT DISTINCT turn FROM conversations)), a AS (SELECT conv_id, turn, count(*) AS n FROM conversations GROUP BY 1, 2), m AS (SELECT e.conv_id, e.turn, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' END AS issue, coalesce(n, 0) AS n FROM e LEFT JOIN a USING (conv_id, turn)) SELECT * FROM m WHERE issue IS NOT NULL",
    "q_align_mismatch": f"""WITH {DOCS}, b AS (SELECT * FROM d WHERE side = 0), c AS (SELECT * FROM d WHERE side = 1),
      m AS (SELECT coalesce(b.pair, c.pair) AS pair, concat_ws(',', CASE WHEN b.pair IS NULL THEN 'missing_base' END, CASE WHEN c.pair IS NULL THEN 'missing_candidate' END,
        CASE WHEN b.pair IS NOT NULL AND c.pair IS NOT NULL AND b.lang IS DISTINCT FROM c.lang THEN 'lang' END, CASE WHEN b.pair IS NOT NULL AND c.pair IS NOT NULL AND b.source IS DISTINCT FROM c.source THEN 'source' END) AS mismatches FROM b FULL JOIN c ON b.pair = c.pair)
      SELECT * FROM m WHERE mismatches <> ''""",
    "q_exact_dedup": f"WITH k AS (SELECT doc_id, {_KEY} AS k FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS group_rows FROM k GROUP BY k",
    "q_dup_pointer": f"WITH v AS (SELECT doc_id, source, text, NOT {_open('text')} AS ok FROM documents), m AS (SELECT source, text, min(doc_id) AS first FROM v WHERE ok GROUP BY 1, 2) SELECT v.doc_id, v.source, coalesce(CASE WHEN v.ok AND m.first < v.doc_id THEN m.first END, -1) AS duplicate_of FROM v LEFT JOIN m ON v.source = m.source AND v.text = m.text",
    "q_answer_reasons": f"WITH {DOCS}, r AS (SELECT lang, CASE WHEN {_strip('text')} = '' THEN 'empty' WHEN finish_reason <> 'stop' THEN 'finish_reason=' || finish_reason WHEN {_contiguous("l")} THEN 'contiguous_repetition' ELSE 'ok' END AS reason FROM (SELECT *, string_split({_compact("text")}, '') AS l FROM d)) SELECT lang, reason, count(*) AS n FROM r GROUP BY 1, 2",
    "q_prompt_issues": f"""WITH {PROMPTS}, r AS (SELECT scenario, CASE WHEN regexp_matches(lower("user"), 'ndth|schu|password|token') THEN 'metadata_leak' WHEN regexp_matches("user", 'hea(?:th|nd)') THEN 'role_self_reference'
      WHEN regexp_matches("user", '^\\s*The[：:,，]') THEN 'addresses_user_as_self' WHEN regexp_matches("user", 'The(?:th|nd)') THEN 'third_person_user' WHEN regexp_matches("user", '^\\s*(?:And |Of )') THEN 'missing_context' ELSE 'ok' END AS reason FROM p)
      SELECT scenario, reason, count(*) AS n FROM r GROUP BY 1, 2""",
    "q_contiguous_repeats": f"SELECT doc_id, {_contiguous('l')} AS repeats FROM (SELECT doc_id, string_split({_compact('text')}, '') AS l FROM documents)",
    "q_stratified_split": f"WITH {PROMPTS}, r AS (SELECT id, scenario, row_number() OVER (PARTITION BY scenario ORDER BY md5('20260806:' || id), id) AS split_rank FROM p) SELECT id, scenario, split_rank, CASE WHEN split_rank <= 20 THEN 'train' WHEN split_rank <= 25 THEN 'dev' WHEN split_rank <= 30 THEN 'eval' ELSE 'rest' END AS split FROM r",
    "q_split_isolation": f"WITH k AS (SELECT doc_id, doc_id % 2 AS side, {_KEY} AS k FROM documents) SELECT doc_id FROM k WHERE side = 0 AND k NOT IN (SELECT k FROM k WHERE side = 1)",
    "q_contamination_ngrams": f"WITH dw AS (SELECT doc_id AS doc, {_WORDS} AS w FROM documents), rw AS (SELECT item_id AS ref, {_WORDS} AS w FROM benchmark), dg AS (SELECT doc, unnest({_GRAMS}) AS g FROM dw WHERE len(w) >= 8), rg AS (SELECT ref, unnest({_GRAMS}) AS g FROM rw WHERE len(w) >= 8), s AS (SELECT ref, count(*) AS ref_grams FROM rg GROUP BY 1) SELECT doc, ref, count(*) AS hits, any_value(ref_grams) AS ref_grams FROM dg JOIN rg USING (g) JOIN s USING (ref) GROUP BY 1, 2",
    "q_copy_coverage": f"""WITH r AS (SELECT {_COPY} AS c FROM benchmark), g AS (SELECT DISTINCT substr(c, i, 8) AS gram FROM (SELECT c, unnest(range(1, greatest(length(c) - 6, 1))) AS i FROM r WHERE length(c) >= 8)),
      t AS (SELECT conv_id, turn, {_COPY} AS c FROM conversations), x AS (SELECT conv_id, turn, i, substr(c, i, 8) AS gram FROM (SELECT conv_id, turn, c, unnest(range(1, greatest(length(c) - 6, 1))) AS i FROM t WHERE length(c) >= 8)),
      h AS (SELECT DISTINCT conv_id, turn, unnest(range(i, i + 8)) AS pos FROM x JOIN g USING (gram)), n AS (SELECT conv_id, turn, count(*) AS n FROM h GROUP BY 1, 2)
      SELECT t.conv_id, t.turn, length(c) AS normalized_length, round(CASE WHEN length(c) >= 8 THEN coalesce(n.n, 0) / length(c) ELSE 0 END, 6) AS coverage,
        CASE WHEN length(c) < 40 OR coalesce(n.n, 0) / length(c) < 0.2 THEN 0.0 WHEN coalesce(n.n, 0) / length(c) < 0.5 THEN 2.0 ELSE 4.0 END::DOUBLE AS penalty FROM t LEFT JOIN n USING (conv_id, turn)""",
    "q_sentence_stats": f"SELECT conv_id, turn, {_FILLED} AS filled_length, {_SENT} AS sentences FROM conversations",
    "q_bracket_balance": f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE {_open('text')}) AS unclosed FROM documents GROUP BY lang",
    "q_alias_counts": f"WITH t AS (SELECT conv_id, turn, {_QUOTELESS} AS x FROM conversations) SELECT conv_id, turn, {_occurrences('x', 'the ')} + {_occurrences('x', 'der ')} AS signatures, {_occurrences('x', 'anth')} + {_occurrences('x', 'tion')} AS wrong_aliases, len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 2) = 'on' AND (i = 1 OR substr(x, i - 1, 1) NOT IN ('i', 't')) AND substr(x, i + 2, 1) <> 'e')) AS wrong_pronouns FROM t",
    "q_penalties": f"SELECT doc_id, round({_LONG}, 6) AS length_penalty, CASE WHEN {_FILLED} < 40 OR doc_id % 10 < 2 THEN 0.0 WHEN doc_id % 10 < 5 THEN 2.0 ELSE 4.0 END::DOUBLE AS copy_penalty FROM documents",
    "q_local_reward": f"""WITH {CONV}, t AS (SELECT *, {_compact('text')} AS cc FROM c), r AS (SELECT conv_id, turn, CASE WHEN {_strip('text')} = '' OR {_gibberish('text')} OR {_repeated('cc')} OR {_open('text')} OR finish_reason = 'length' THEN 0 ELSE 1 END AS readable, {_LONG} AS long FROM t)
      SELECT conv_id, turn, readable, round(readable * ({drawn('role', 'conv_id * 100 + turn', 6)} + {drawn('dialogue', 'conv_id * 100 + turn', 6)}) / 2.0 - long, 6) AS reward FROM r""",
    "q_role_cap": f"SELECT doc_id, least({drawn('identity', 'doc_id', 3)} + {drawn('personality', 'doc_id', 3)} + {drawn('voice', 'doc_id', 2)}, CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 5 END) AS role FROM labels",
    "q_reward_delta": f"WITH {_DELTA} SELECT * FROM y",
    "q_reward_gate": f"WITH {_DELTA}, g AS (SELECT count(*) AS pairs, round(avg(reward_delta), 6) AS mean_delta, count(*) FILTER (WHERE winner = 'candidate') AS wins, avg(reward_delta) AS m FROM y) SELECT pairs, mean_delta, wins, m >= 0.3 AND wins >= 6 AS passed FROM g",
    "q_rank_ties": f"WITH s AS (SELECT conv_id, turn, {drawn('tier', 'conv_id * 100 + turn', 4)} AS score FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC) - 1 AS p FROM s) SELECT conv_id, turn, round(avg(p) OVER (PARTITION BY conv_id, score), 6) AS mean_position, round(5.0 * (3 - avg(p) OVER (PARTITION BY conv_id, score)) / 3, 6) AS rank_reward FROM r",
    "q_best_pairs": f"WITH {_REVIEWS} SELECT grp, coalesce(chosen_label, '') AS chosen_label, round(coalesce(chosen_reward, -1), 6) AS chosen_reward, coalesce(rejected_label, '') AS rejected_label, round(coalesce(rejected_reward, -1), 6) AS rejected_reward FROM pr",
    "q_pair_readiness": f"""WITH {_REVIEWS}, a AS (SELECT grp % 3 AS issue, chosen_label IS NOT NULL AND rejected_label IS NOT NULL AS included, grp % 7 = 0 AS teacher FROM pr), i AS (SELECT issue, count(*) AS n, count(*) FILTER (WHERE teacher) AS t FROM a WHERE included GROUP BY issue),
      g AS (SELECT coalesce(sum(n), 0)::BIGINT AS pairs, coalesce(sum(t), 0)::BIGINT AS teacher_pairs, count(*) FILTER (WHERE n >= 2) AS issues_ready FROM i) SELECT *, CASE WHEN teacher_pairs * 4 > pairs THEN 'too_many_teacher_pairs' WHEN pairs BETWEEN 10 AND 1000000 AND issues_ready = 3 THEN 'ready' ELSE 'insufficient_pairs' END AS status FROM g""",
    "q_preference_gate": f"""WITH k AS (SELECT doc_id // 2 AS pair FROM documents GROUP BY 1 HAVING count(*) = 2), s AS (SELECT pair, {', '.join(f"{drawn(d + w, 'pair', 11)} AS {w}_{d}" for w in ('c', 'r') for d in _DIMS)}, {drawn('ci', 'pair', 4)} = 0 AS ci, {drawn('ru', 'pair', 6)} = 0 AS ru FROM k)
      SELECT CASE WHEN c_generation_stability < 8 OR c_role_consistency < 7 OR c_dialogue_quality < 7 OR ci THEN 'chosen_below_floor' WHEN r_generation_stability < 7 OR ru THEN 'rejected_unstable'
        WHEN greatest(c_role_consistency - r_role_consistency, c_dialogue_quality - r_dialogue_quality) < 2 THEN 'gap_too_small' WHEN c_generation_stability < r_generation_stability - 1 OR c_role_consistency < r_role_consistency - 1 OR c_dialogue_quality < r_dialogue_quality - 1 THEN 'other_dimension_regressed' ELSE 'ok' END AS issue, count(*) AS n FROM s GROUP BY 1""",
    "q_unreviewed": "SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND turn >= 3)",
    "q_ab_review": _review(False),
    "q_review_submission": f"SELECT *, CASE WHEN passed THEN 'passed' ELSE 'failed' END AS status FROM ({_review(False)})",
    "q_ab_review_new_severe": _review(True),
    "q_blind_packet": f"""WITH {DOCS}, x AS (SELECT a.pair, md5(a.text) AS b, md5(c.text) AS c, ('0x' || right(md5('20260807:' || a.pair), 1))::INT % 2 = 0 AS first FROM d a JOIN d c ON a.pair = c.pair AND a.side = 0 AND c.side = 1)
      SELECT pair, CASE WHEN first THEN c ELSE b END AS answer_a, CASE WHEN first THEN b ELSE c END AS answer_b, CASE WHEN first THEN 'A' ELSE 'B' END AS candidate_label FROM x""",
    "q_prompt_lists": f"""WITH {PROMPTS} SELECT id, 1 AS n, md5({_strip('"user"')}) AS first_md5 FROM p""",
    "q_generated_candidates": f"""WITH {PROMPTS}, w AS (SELECT id, list_filter(regexp_split_to_array("user", '{_WS}+'), lambda x: x <> '') AS w FROM p)
      SELECT id AS prompt, i::INT AS candidate_index, md5(array_to_string(list_concat(w[i + 1:], w[1:i]), ' ')) AS raw_md5 FROM w, range(1, 5) AS r(i)""",
    "q_group_size": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) <> 2",
    "q_last_user": f"SELECT conv_id, arg_max(text, turn) AS last_user FROM conversations WHERE role = 'user' AND {_strip('text')} <> '' GROUP BY conv_id",
    "q_messages": "SELECT conv_id, count(*) AS n, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "q_json_contract": """WITH j AS (SELECT json_keys(props) AS ks, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(json_extract(props, '$.k')) AS kt FROM events),
      v AS (SELECT concat_ws(',', CASE WHEN NOT list_contains(ks, 'k') THEN 'missing:k' WHEN kt NOT IN ('BIGINT', 'UBIGINT') OR k < 10 OR k > 60 THEN 'invalid:k' END, 'missing:user') AS violations FROM j) SELECT violations, count(*) AS n FROM v GROUP BY 1""",
    "q_candidate_digest": "SELECT conv_id, count(*) AS n, sha256(string_agg((conv_id * 100 + turn) || ':' || sha256(text), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "q_first_per_category": "SELECT lang, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY lang",
    "q_label_packet": "SELECT conv_id, turn, chr((64 + row_number() OVER (PARTITION BY conv_id ORDER BY md5('20260810:' || (conv_id * 100 + turn)), conv_id * 100 + turn))::INT) AS label FROM conversations",
    "q_candidate_ids": "WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) SELECT conv_id, turn, conv_id || '-c' || i AS candidate_id, 20260810 + (conv_id - 1) * 100 + i - 1 AS seed FROM n",
    "q_embedding_delta": "WITH p AS (SELECT a.vec_id // 2 AS pair, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0), d AS (SELECT pair, list_transform(range(1, len(x) + 1), lambda i: y[i]::DOUBLE - x[i]::DOUBLE) AS d FROM p) SELECT pair, len(list_filter(d, lambda v: v <> 0)) AS changed, round(list_max(list_transform(d, lambda v: abs(v))), 6) AS max_abs, len(list_filter(d, lambda v: NOT isfinite(v))) = 0 AS finite FROM d",
    "q_reward_log_stats": "SELECT event_type, count(*) AS \"rows\", round(min(value), 6) AS minimum, round(avg(value), 6) AS mean, round(max(value), 6) AS maximum, bool_and(value IS NOT NULL AND isfinite(value)) AS finite FROM events GROUP BY event_type",
    "q_stream_reward_stats": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS minimum, round(max(value), 6) AS maximum FROM events GROUP BY event_type",
    "q_stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "q_axes": "SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(DISTINCT source) AS sources FROM documents",
    "q_corpus_stats": f"SELECT source, count(*) AS n, count(*) FILTER (WHERE contains(text, 'the')) AS with_signature, count(*) FILTER (WHERE regexp_matches(text, 'idiot|scum')) AS with_wrong, round(avg(length(text)), 2) AS mean_length, max(len({_WORDS})) AS max_tokens FROM documents GROUP BY source",
    "q_training_plan": "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, (ceil(ceil(n / 2.0) / 8) * 3)::BIGINT AS steps FROM n",
    "q_last_status": "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS at FROM events GROUP BY user_id",
    "q_preference_rows": f"""WITH {DOCS}, x AS (SELECT a.pair, CASE WHEN a.pair % 5 <> 0 THEN a.lang END AS u, a.text AS c, CASE WHEN a.pair % 7 = 0 THEN a.text ELSE b.text END AS r FROM d a JOIN d b ON a.pair = b.pair AND a.side = 0 AND b.side = 1)
      SELECT CASE WHEN u IS NULL OR trim(u) = '' OR c IS NULL OR trim(c) = '' THEN 'blank_message' WHEN r IS NULL OR trim(r) = '' THEN 'blank_rejected' WHEN r = c THEN 'same_answers' ELSE 'ok' END AS issue, count(*) AS n FROM x GROUP BY 1""",
    "q_persona_render": """WITH n AS (SELECT n_regionkey AS r, string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS l, min(n_name) AS f FROM nation GROUP BY 1)
      SELECT r_regionkey, 'You are ' || r_name || '.' || chr(10) || chr(10) || 'identity:' || chr(10) || l || chr(10) || chr(10) || 'facts:' || chr(10) || '- (none)' || chr(10) || chr(10) || CASE WHEN r_regionkey % 2 = 0 THEN 'notes:' || chr(10) || '- ' || f || chr(10) || chr(10) ELSE '' END || 'Stay in character.' AS prompt FROM region JOIN n ON r_regionkey = r""",
    "q_unknown_references": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1",
    "q_contiguous_ids": "WITH x AS (SELECT conv_id, turn, printf('c_%04d', turn // 2 + 1) AS ident, printf('c_%04d', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS expected_id FROM conversations WHERE role = 'assistant') SELECT * FROM x WHERE ident <> expected_id",
    "q_minimal_edits": f"""WITH k AS (SELECT doc_id // 2 AS pair FROM documents GROUP BY 1 HAVING count(*) = 2), s AS (SELECT {', '.join(f"{drawn(d + w, 'pair', 3)} + {b} AS {w}_{d}" for w, b in (('s', 6), ('i', 7)) for d in _DIMS)}, {drawn('target', 'pair', 2)} = 0 AS role, {drawn('sim', 'pair', 101)} / 100.0 AS sim, {drawn('len', 'pair', 200)} / 100.0 AS len, {drawn('st', 'pair', 5)} > 0 AS st FROM k),
      t AS (SELECT *, CASE WHEN role THEN s_role_consistency ELSE s_dialogue_quality END AS so, CASE WHEN role THEN s_dialogue_quality ELSE s_role_consistency END AS sx, CASE WHEN role THEN i_role_consistency ELSE i_dialogue_quality END AS io, CASE WHEN role THEN i_dialogue_quality ELSE i_role_consistency END AS ix FROM s)
      SELECT CASE WHEN s_generation_stability < 8 OR so <> 7 OR sx < 8 THEN 'source_not_single_fault' WHEN i_generation_stability < 8 OR io < 8 OR ix < 8 THEN 'improved_below_floor' WHEN io < so + 1 OR ix <> sx OR i_generation_stability <> s_generation_stability THEN 'other_dimension_changed'
        WHEN NOT st THEN 'unstable' WHEN sim < 0.65 THEN 'too_different' WHEN NOT len BETWEEN 0.8 AND 1.2 THEN 'length_changed' ELSE 'ok' END AS issue, count(*) AS n FROM t GROUP BY 1""",
    "q_series_ok": "SELECT user_id, count(*) AS n, bool_and(value IS NOT NULL AND isfinite(value) AND value > 0) AND count(*) = 10 AS ok FROM events GROUP BY user_id",
    "q_newest": "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "q_reported_steps": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS s FROM lineitem), x AS (SELECT *, max(s) OVER (PARTITION BY l_orderkey) AS t, lag(s) OVER (PARTITION BY l_orderkey ORDER BY s) AS b FROM l) SELECT s AS l_linenumber, count(*) AS n FROM x WHERE s = 1 OR s = t OR coalesce((s - 1) // greatest(ceil(t / 5), 1)::INT > (b - 1) // greatest(ceil(t / 5), 1)::INT, false) GROUP BY 1",
    "q_judge_contract": f"""WITH x AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {drawn(n, 'doc_id', h + 2)} > {h} THEN 'invalid:{n}' END" for n, h in (('identity_boundary_facts', 2), ('personality_relationship', 2)))}, 'invalid:character_voice',
      {', '.join(f"CASE WHEN {drawn(n, 'doc_id', h + 2)} > {h} THEN 'invalid:{n}' END" for n, h in (('response_effectiveness', 3), ('expression_quality', 2)))}, CASE WHEN doc_id % 4 = 0 THEN 'invalid:reason' END, CASE WHEN {drawn('code', 'doc_id', 3)} = 1 THEN 'unknown_code:rude' END], lambda i: i IS NOT NULL) AS l FROM documents)
      SELECT doc_id, len(l) AS n_issues, array_to_string(l, ',') AS issues FROM x""",
    "q_pilot_report": f"""WITH x AS (SELECT doc_id % 5 AS scenario, {drawn('decision', 'doc_id', 3)} AS d, toxic = 0 AS passed, {', '.join(f"{drawn(n, 'doc_id', 11)} AS {n}" for n in _DIMS)} FROM labels)
      SELECT count(*) AS sample_count, count(DISTINCT scenario) AS scenario_count, count(*) FILTER (WHERE d = 0) AS keep_count, count(*) FILTER (WHERE d = 1) AS light_edit_count, count(*) FILTER (WHERE d = 2) AS rewrite_count, {', '.join(f'round(avg({n}), 2) AS mean_{n}' for n in _DIMS)},
        CASE WHEN bool_and(passed) THEN 'automatic_checks_passed' ELSE 'manual_review_required' END AS status FROM x""",
    "q_editability_report": f"""WITH x AS (SELECT quality = 1 AS ok, {drawn('sim', 'doc_id', 101)} / 100.0 AS s, {drawn('len', 'doc_id', 200)} / 100.0 AS l FROM labels), g AS (SELECT count(*) AS prompts, count(*) FILTER (WHERE ok) AS successful, round(avg(s) FILTER (WHERE ok), 6) AS mean_similarity, round(avg(l) FILTER (WHERE ok), 6) AS mean_length_ratio FROM x)
      SELECT *, CASE WHEN successful >= 25 THEN 'strong' WHEN successful >= 10 THEN 'viable' ELSE 'insufficient' END AS outcome FROM g""",
    "q_triples": "WITH x AS (SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 2 <> 0 THEN 'missing:packet' END, CASE WHEN doc_id % 3 <> 0 THEN 'missing:key' END, CASE WHEN doc_id % 5 <> 0 THEN 'missing:results' WHEN doc_id % 10 = 0 THEN 'repeated:results' END) AS issue FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0) SELECT * FROM x WHERE issue <> ''",
    "q_constraint_issues": f"""WITH b AS (SELECT {', '.join(f"CASE WHEN {drawn(f'{m}_{n}null', 'doc_id', 5)} > 0 THEN {drawn(f'{m}_{n}', 'doc_id', 9)} END AS {m}_{n}" for n in ('actions', 'sentences', 'chars', 'signatures') for m in ('min', 'max'))} FROM documents)
      SELECT CASE {' '.join(f"WHEN (min_{n} IS NULL) <> (max_{n} IS NULL) OR coalesce(min_{n} > max_{n}, false)" + (f" OR min_{n} IS NULL" if n in ('chars', 'signatures') else '') + f" THEN '{n}'" for n in ('actions', 'sentences', 'chars', 'signatures'))} ELSE 'ok' END AS issue, count(*) AS n FROM b GROUP BY 1""",
    "q_training_rows": "WITH x AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'role_order' WHEN NOT contains(text, 'the') THEN 'no_signature' WHEN regexp_matches(text, 'idiot|scum') THEN 'wrong_alias' END AS issue FROM documents) SELECT issue, count(*) AS n FROM x WHERE issue IS NOT NULL GROUP BY 1",
}
