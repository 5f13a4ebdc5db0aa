"""Text rules as column expressions: normal forms, predicates, counts and the action-span parser.

All stay in the JVM. White space is Unicode white space plus U+001C..U+001F, as the rules were written for a language
whose strings strip those too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import BRACKETS, DRIVER, QUOTES, TAG, RuleProfile

WS = r"[\s\x1C-\x1F]"
_CONTROL = r"[\p{C}\x{FFFD}&&[^\x{200D}\x09-\x0D\x1C-\x1F\x85]]"
_EMOJI = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}"
ABNORMAL = rf"{_CONTROL}|[{_EMOJI}]|[\p{{P}}\p{{S}}]{{4}}"
GIBBERISH = rf"{_CONTROL}|[\p{{L}}&&[\p{{IsGreek}}\p{{IsCyrillic}}]&&[^\x{{2126}}]]{{12}}|[[\p{{P}}\p{{S}}]&&[^{_EMOJI}]]{{12}}"
THINK = rf"(?iU)\A{WS}*<think>{WS}*</think>{WS}*"
CONTIGUOUS = r"(.{1,20}?)\1{3,}"


def escape(text: str) -> str:
    """A literal inside a Java regular expression."""
    return "".join("\\" + c if not c.isalnum() and c.isascii() and not c.isspace() else c for c in text)


def any_of(words: tuple[str, ...]) -> str:
    return "|".join(map(escape, words))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x computed once: inside a lambda an expression would be computed for every element."""
    return F.transform(F.array(x), use)[0]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)\A{WS}+|{WS}+\z", "")


def collapse(x: Column) -> Column:
    """Runs of white space become one space; none at the ends. Not NFKC: see pandas_text.nfkc_key."""
    return strip(F.regexp_replace(x, rf"(?U){WS}+", " "))


def compact(x: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(x, rf"(?U){WS}", "")


def comparison_tail(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def drop_empty_think(x: Column) -> Column:
    """Without one leading empty thinking wrapper, stripped."""
    return strip(F.regexp_replace(x, THINK, ""))


def drop_code_fence(x: Column) -> Column:
    """What one fence around the whole text holds, else the stripped text."""
    s = strip(x)
    inner = F.regexp_extract(s, r"(?sU)\A```(?:json)?\s*(.+?)\s*```\z", 1)
    return F.when(inner != "", inner).otherwise(s)


def copy_form(x: Column) -> Column:
    """Without white space and punctuation."""
    return F.regexp_replace(x, r"(?U)[\s\x1C-\x1F\p{P}]", "")


def has_abnormal_symbols(x: Column) -> Column:
    return x.rlike(ABNORMAL)


def has_gibberish(x: Column) -> Column:
    return x.rlike(GIBBERISH)


def has_contiguous_repeat(x: Column) -> Column:
    """A unit of 1 to 20 characters four times in a row, white space aside."""
    return compact(x).rlike(CONTIGUOUS)


def has_tag(x: Column) -> Column:
    return x.rlike(TAG)


def has_speaker_label(x: Column, profile: RuleProfile = DRIVER) -> Column:
    return x.rlike(rf"(?iU)(?:\A|\n)\s*(?:{any_of(profile.speaker_labels)})\s*[:：]")


def _deepen(opening: str) -> Callable[[Column, Column], Column]:
    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == opening, 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (acc["bad"] | (depth < 0)).alias("bad"))

    return step


def has_unclosed_brackets(x: Column) -> Column:
    """Either kind of bracket closes before it opens, or stays open.

    Only the brackets are split and folded, so the cost follows their number, not the text's length.
    """
    bad = F.lit(False)
    for opening, closing in BRACKETS:
        only = F.regexp_replace(x, f"[^{escape(opening)}{escape(closing)}]", "")
        steps = F.filter(F.split(only, ""), lambda c: c != "")
        start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"))

        bad = bad | F.aggregate(steps, start, _deepen(opening), lambda acc: acc["bad"] | (acc["depth"] != 0))
    return bad


def is_strict_format(x: Column, profile: RuleProfile = DRIVER) -> Column:
    """An action in brackets at the front, then dialogue; neither blank, no other bracket, no tag."""
    o, c, every = escape(profile.action_open), escape(profile.action_close), "".join(escape(b) for kind in BRACKETS for b in kind)
    return x.rlike(rf"(?U)\A{o}(?=[^{o}{c}\r\n]*[^\s\x1C-\x1F{every}])[^{every}\r\n]+{c}(?=[\s\S]*[^\s\x1C-\x1F])[^{every}]+\z") & ~has_tag(x)


def is_style_format(x: Column, profile: RuleProfile = DRIVER) -> Column:
    """One line of an action in brackets and dialogue without brackets."""
    o, c = escape(profile.action_open), escape(profile.action_close)
    return x.rlike(rf"\A{o}[^{o}{c}\r\n]+{c}[^{o}{c}\r\n]+\z")


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    return x.rlike(any_of(words))


def has_leak(x: Column, profile: RuleProfile = DRIVER) -> Column:
    return contains_any(F.lower(x), tuple(p.lower() for p in profile.leak_patterns))


def filled_length(x: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(compact(x)).cast("long")


def sentence_count(x: Column, profile: RuleProfile = DRIVER) -> Column:
    """Parts between sentence ends that aren't blank, an unended last one too."""
    return F.size(F.filter(F.split(x, profile.sentence_end), lambda p: strip(p) != "")).cast("long")


def without_quotes(x: Column) -> Column:
    for pattern in QUOTES:
        x = F.regexp_replace(x, pattern, "")
    return x


def signature_count(x: Column, profile: RuleProfile = DRIVER) -> Column:
    plain = without_quotes(x)
    return sum((F.regexp_count(plain, F.lit(escape(s))) for s in profile.signatures), F.lit(0)).cast("long")


def wrong_alias_count(x: Column, profile: RuleProfile = DRIVER) -> Column:
    plain = without_quotes(x)
    return sum((F.regexp_count(plain, F.lit(escape(s))) for s in profile.wrong_aliases), F.lit(0)).cast("long")


def wrong_pronoun_count(x: Column, profile: RuleProfile = DRIVER) -> Column:
    pattern = f"(?<![{profile.pronoun_not_after}]){escape(profile.wrong_pronoun)}(?!{escape(profile.pronoun_not_before)})"
    return F.regexp_count(without_quotes(x), F.lit(pattern)).cast("long")


def wrong_references(x: Column, profile: RuleProfile = DRIVER) -> Column:
    """Every wrong self-reference: the aliases in order, then the pronouns."""
    plain = without_quotes(x)
    found = [F.array_repeat(F.lit(s), F.regexp_count(plain, F.lit(escape(s)))) for s in profile.wrong_aliases]
    return F.concat(*found, F.array_repeat(F.lit(profile.wrong_pronoun), wrong_pronoun_count(x, profile).cast("int")))


def spoken_length(x: Column) -> Column:
    """Letters and digits."""
    return F.regexp_count(x, F.lit(r"[\p{L}\p{N}]")).cast("long")


def has_letter(x: Column) -> Column:
    return x.rlike(r"\p{L}")


def actions(text: Column) -> Column:
    """Bracketed spans, parsed with a stack: struct(spans, nested, unbalanced).

    spans: the outermost ones as (first, last, body), positions from 0. A closing bracket of the other kind closes too and counts as
    unbalanced. The text is cut at its brackets, so the fold takes a step for each bracket, not for each character.
    """
    return let(text, _parse)


def _parse(x: Column) -> Column:
    opens, closes = [b[0] for b in BRACKETS], [b[1] for b in BRACKETS]
    each = "".join(escape(b) for kind in BRACKETS for b in kind)
    parts = F.split(x, f"(?<=[{each}])")  # every part but the last ends in a bracket
    span = "array<struct<first:int,last:int,body:string>>"
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(0).alias("nested"), F.lit(0).alias("unbalanced"), F.array().cast(span).alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)  # one past the bracket
        c = F.right(part, F.lit(1))
        depth = F.length(acc["stack"])
        is_open, is_close = c.isin(opens), c.isin(closes)
        top = F.right(acc["stack"], F.lit(1))
        wrong = (top == opens[0]) != (c == closes[0])
        pops = is_close & (depth > 0)
        body = F.substring(x, acc["first"] + 2, end - acc["first"] - 2)
        closed = F.struct(acc["first"].alias("first"), (end - 1).cast("int").alias("last"), body.alias("body"))
        return F.struct(
            F.when(is_open, F.concat(acc["stack"], c)).when(pops, F.substring(acc["stack"], F.lit(1), depth - 1)).otherwise(acc["stack"]).alias("stack"),
            end.cast("int").alias("at"),
            F.when(is_open & (depth == 0), end - 1).otherwise(acc["first"]).cast("int").alias("first"),
            (acc["nested"] + F.when(is_open & (depth > 0), 1).otherwise(0)).cast("int").alias("nested"),
            (acc["unbalanced"] + F.when(is_close & ((depth == 0) | wrong), 1).otherwise(0)).cast("int").alias("unbalanced"),
            F.when(pops & (depth == 1), F.concat(acc["spans"], F.array(closed).cast(span))).otherwise(acc["spans"]).alias("spans"),
        )

    def done(acc: Column) -> Column:
        return F.struct(acc["spans"].alias("spans"), acc["nested"].alias("nested"), (acc["unbalanced"] + F.length(acc["stack"])).cast("int").alias("unbalanced"))

    return F.aggregate(parts, start, step, done)


def action_facts(text: Column, parsed: Column) -> Column:
    """What the rules need of the parsed actions: counts, lengths, share, smallest gap between spans, spans without letters."""
    return let(F.struct(text.alias("text"), parsed.alias("parsed")), lambda s: _facts(s["text"], s["parsed"]))


def _facts(x: Column, parsed: Column) -> Column:
    bodies = F.transform(parsed["spans"], lambda s: s["body"])
    lengths = F.transform(bodies, filled_length)
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)
    size = filled_length(x)
    pairs = F.zip_with(F.slice(parsed["spans"], 1, F.greatest(F.size(parsed["spans"]) - 1, F.lit(0))), F.slice(parsed["spans"], 2, F.size(parsed["spans"])), lambda a, b: spoken_length(F.substring(x, a["last"] + 2, b["first"] - a["last"] - 1)))
    return F.struct(
        F.size(bodies).cast("long").alias("count"),
        lengths.alias("lengths"),
        total.alias("total_length"),
        F.when(size > 0, total / size).otherwise(F.lit(0.0)).alias("ratio"),
        F.array_min(pairs).alias("minimum_gap"),
        parsed["nested"].cast("long").alias("nested"),
        parsed["unbalanced"].cast("long").alias("unbalanced"),
        F.size(F.filter(bodies, lambda b: ~has_letter(b))).cast("long").alias("invalid"),
    )


def ngrams(x: Column, n: int) -> Column:
    """Every n-gram of characters, in order."""
    each = let(x, lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    return F.when(F.length(x) >= n, each).otherwise(F.array().cast("array<string>"))


def redact(x: Column, secret: str) -> Column:
    return F.replace(x, F.lit(secret), F.lit("[REDACTED]"))


def plain_version(x: Column) -> Column:
    return F.split_part(x, F.lit("+"), F.lit(1))


def duration(seconds: Column) -> Column:
    """MM:SS, HH:MM:SS from an hour on, --:-- without a time."""
    s = F.floor(seconds).cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    minutes = F.concat(two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    hours = F.floor(s / 3600)
    text = F.when(hours > 0, F.concat(F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), F.lit(":"), minutes)).otherwise(minutes)
    return F.when(s.isNull() | (s < 0) | F.isnan(seconds), F.lit("--:--")).otherwise(text)


def named_user(x: Column) -> Column:
    """The name before a colon at the front, of up to 12 characters, or null."""
    name = F.regexp_extract(x, r"(?U)\A([^：:,，\s]{1,12})[：:]", 1)
    return F.when(name != "", name)


def self_references(rules: Column) -> Column:
    """Distinct quoted names after the word for calling oneself, in order."""
    found = F.flatten(F.transform(rules, lambda r: F.regexp_extract_all(r, F.lit("自称[“\"']([^”\"']+)[”\"']"), F.lit(1))))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda s: s != ""))
