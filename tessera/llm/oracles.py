"""DuckDB SQL of the operators whose checksums, edits and spans take more than a few lines."""

from __future__ import annotations

#: crc32 of bytes as a fold: the 256 remainders by eight shifts of each byte (polynomial 0xEDB88320), then a byte a step.
CRC_TABLE = "(SELECT list(c ORDER BY b) FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(b)))"


def crc_sql(text: str, table: str) -> str:
    """The unsigned crc32 of a text's UTF-8; ``table`` is the list of remainders. Of code points below 0x800 only."""
    points = f"list_transform(string_split({text}, ''), lambda c: ord(c))"
    octets = f"flatten(list_transform({points}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 | (c >> 6), 128 | (c & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}::BIGINT[]), lambda x, b: xor({table}[(xor(x, b) & 255) + 1], x >> 8)), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE k AS (
  SELECT {CRC_TABLE} AS tab
), r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents
), l AS (
  SELECT id, CASE WHEN regexp_matches(run, '[A-Z]') THEN translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE run END AS low, count(*) AS times FROM r GROUP BY ALL
), h AS (
  SELECT low, times, {crc_sql("id || ':' || low", "tab")} AS h FROM l, k
), d AS (
  SELECT CASE WHEN h % 31 = 0 THEN low[1:h % length(low)] || low[h % length(low) + 2:] ELSE low END AS word, times FROM h
), w AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2
), x AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.less = w.word
  UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.less = w.word
), b AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM p GROUP BY 1
), f AS (
  SELECT w.word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM w LEFT JOIN b USING (word)
), c AS (
  SELECT word, form AS at FROM f WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL
), t AS (
  SELECT c.word, c.at AS root FROM c JOIN f ON c.at = f.word WHERE f.form IS NULL
)
SELECT f.word, form, coalesce(t.root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN t USING (word)
"""


def _add(state: str, cost: str, edit: str, line: str, n: int) -> str:
    """State n's struct with an edit more; only state 1 has no line before."""
    lead = "" if n == 1 else "|| chr(10)"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'l': {state}.l {lead} || {line}}}"


_D = [f"{{'c': b{n}.c + 4, 'a': b{n}.a || 'D', 'l': b{n}.l}}" for n in (1, 2, 3, 4)]
_FREE, _MORE = "CASE WHEN fault IN ('b', 'd') THEN 1000000000 WHEN fault = 't' THEN 3 ELSE 0 END", "CASE WHEN fault IN ('b', 'd') THEN 1000000000 WHEN fault = 't' THEN 6 ELSE 3 END"


def _held(n: int, initial: str) -> str:
    return _add(f"b{n}", f"(CASE WHEN role[1] = '{initial}' THEN 0 ELSE 1000000000 END + {_FREE})", "K", "role || ':' || text", n)


def _named(n: int, name: str) -> str:
    return _add(f"b{n}", _MORE, "R", f"'{name}:' || text", n)


_INSERT_U = ", ".join(_add(f"n{n}", "3", "I", "'user:'", n) for n in (1, 2, 4))
OP12_SQL = rf"""
WITH RECURSIVE k AS (
  SELECT {CRC_TABLE} AS tab
), h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')", "tab")} % 20 AS h FROM conversations, k
), d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(2) t(i) WHERE h <> 0 AND (i = 0 OR h = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, role[1] || lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS pair
  FROM o
), s AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0::BIGINT, 'a': '', 'l': ''}} AS b1, {{'c': 1000000000::BIGINT, 'a': '', 'l': ''}} AS b2,
    {{'c': 3::BIGINT, 'a': 'I', 'l': 'user:'}} AS b3, {{'c': 6::BIGINT, 'a': 'II', 'l': 'user:' || chr(10) || 'assistant:'}} AS b4 FROM conversations
  UNION ALL
  SELECT conv_id, i, n1, n2, u, list_min([n4, {_add("u", "3", "I", "'assistant:'", 3)}]) FROM (
    SELECT conv_id, i, n1, n2, n4, list_min([n3, {_INSERT_U}]) AS u FROM (
      SELECT s.conv_id, f.i, {_D[0]} AS n1, list_min([{_D[1]}, {_held(1, "s")}]) AS n2,
        list_min([{_D[2]}, {", ".join(_held(n, "u") for n in (1, 2, 4))}, {", ".join(_named(n, "user") for n in (1, 2, 4))}]) AS n3,
        list_min([{_D[3]}, {_held(3, "a")}, {_named(3, "assistant")}]) AS n4
      FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1))
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1
), e AS (
  SELECT conv_id, list_min([arg_max(b1, i), arg_max(b4, i)]) AS b FROM s GROUP BY 1
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.c AS cost, b.a AS audit, sha256(b.l) AS repaired_sha256 FROM e LEFT JOIN c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _placed(cuts: str, hits: str, i: str) -> str:
    """Where hit i begins: all cuts up to it and all hits before it."""
    total = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return f"{total.format(f'{cuts}[1:{i}]')} + {total.format(f'{hits}[1:{i} - 1]')}"


_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "true", "list_max(list_transform(string_split(hit, '.'), lambda x: CAST(x AS DOUBLE))) <= 255"),
    "card": (
        r"[0-9](?:[ -]?[0-9])+", "length(digits) BETWEEN 13 AND 19",
        "list_sum(list_transform(string_split(reverse(digits), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "true", "length(digits) BETWEEN 9 AND 15"),
}
_RUN, _TERM = r"[\p{L}\p{N}@._%+-]+", r"\p{L}{3,}[._%+-]*"
_CUT = " UNION ALL ".join(f"SELECT rid, text, {n} AS no, '{k}' AS kind, string_split_regex(text, '{p}') AS cuts, regexp_extract_all(text, '{p}') AS hits FROM t" for n, (k, (p, _, _)) in enumerate(_SQL_KINDS.items(), 1))
_SHAPE = " ".join(f"WHEN '{k}' THEN {s}" for k, (_, s, _) in _SQL_KINDS.items())
_RULE = " ".join(f"WHEN '{k}' THEN {r}" for k, (_, _, r) in _SQL_KINDS.items())
_SPACE = r"\x20\x09-\x0D"
OP13_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), c AS (
  {_CUT}
), h AS (
  SELECT rid, text, no, kind, hits[i] AS hit, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits, {_placed("cuts", "hits", "i")} AS start FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM c)
), s AS (
  SELECT *, start + length(hit) AS stop FROM h WHERE CASE kind {_SHAPE} END
), w AS (
  SELECT *, CASE WHEN lag(stop) OVER o IS NULL THEN '' ELSE '@' END || text[coalesce(lag(stop) OVER o, 0) + 1:start] || '@' AS before,
    '@' || text[stop + 1:coalesce(lead(start) OVER o, length(text))] || CASE WHEN lead(start) OVER o IS NULL THEN '' ELSE '@' END AS after FROM s WINDOW o AS (PARTITION BY rid, kind ORDER BY start)
), m AS (
  SELECT rid, no, kind, start, stop, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN digits ELSE lower(hit) END AS entity,
    CASE WHEN length(before) > 65 THEN regexp_replace(right(before, 65), '^[^{_SPACE}]+', '') ELSE before END AS l,
    CASE WHEN length(after) > 65 THEN regexp_replace(left(after, 65), '[^{_SPACE}]+$', '') ELSE after END AS r
  FROM w WHERE CASE kind {_RULE} END
), x AS (
  SELECT rid, entity, start - length(l) + 1 AS base, l AS part FROM m UNION ALL SELECT rid, entity, stop - 1, r FROM m
), y AS (
  SELECT rid, entity, base, string_split_regex(part, '{_RUN}') AS cuts, regexp_extract_all(part, '{_RUN}') AS runs FROM x
), z AS (
  SELECT rid, entity, regexp_extract(runs[i], '^\p{{L}}+') AS word, base + {_placed("cuts", "runs", "i")} AS start FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM y) WHERE regexp_full_match(runs[i], '{_TERM}')
), ct AS (
  SELECT entity, lower(word) AS term, count(DISTINCT rid) AS n_ct FROM z GROUP BY ALL
), ec AS (
  SELECT entity, count(DISTINCT rid) AS n_c FROM m GROUP BY ALL
), tt AS (
  SELECT term, count(DISTINCT rid) AS n_t FROM (SELECT rid, lower(regexp_extract(run, '^\p{{L}}+')) AS term FROM (SELECT rid, unnest(regexp_extract_all(text, '{_RUN}')) AS run FROM t) WHERE regexp_full_match(run, '{_TERM}')) GROUP BY ALL
), q AS (
  SELECT entity, term, 1 - ln(n_t / n_ct) / ln(n / n_c) AS share FROM ct JOIN ec USING (entity) JOIN tt USING (term), (SELECT count(*) AS n FROM t) WHERE n > n_c
), u AS (
  SELECT rid, start, start + length(word) AS stop, max(share) AS share FROM z JOIN q ON z.entity = q.entity AND lower(z.word) = q.term WHERE share >= 0.9 GROUP BY ALL
), a AS (
  SELECT rid, no, kind, start, stop FROM m UNION ALL SELECT rid, CASE WHEN share >= 1 THEN 6 ELSE 5 END, CASE WHEN share >= 1 THEN 'remove' ELSE 'generalise' END, start, stop FROM u
), g AS (
  SELECT rid, count(*) FILTER (no = 1) AS n_email, count(*) FILTER (no = 2) AS n_ip, count(*) FILTER (no = 3) AS n_card, count(*) FILTER (no = 4) AS n_phone,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY no, start) FILTER (no <= 4), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY no, start) AS spans
  FROM a GROUP BY 1
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)
"""
