"""Text functions that Spark has no form of, or a much slower one, as Arrow-batched UDFs: NFKC, the matching ratio, the share of repeats, repeated spans."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WS = re.compile(r"\s+")


def nfkc_text(text: str) -> str:
    return _WS.sub(" ", text if text.isascii() else unicodedata.normalize("NFKC", text)).strip()


def comparison_text(text: str) -> str:
    return re.sub(r"[\W_]+", "", nfkc_text(text).lower())


@F.pandas_udf(T.StringType())
def nfkc_key(x: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, stripped."""
    return x.map(nfkc_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def comparison_key(x: pd.Series) -> pd.Series:
    """The NFKC key in lower case, letters and digits only."""
    return x.map(comparison_text, na_action="ignore")


def repetition(text: str, least: int = 3, most: int = 12) -> float:
    """The largest share of a text, white space aside, that the repeats of one span of ``least`` to ``most`` characters make up, overlaps counted; 1 at most.

    Places are grouped by the span that begins there, one character longer at a time: a group and the next character give the next group. Only spans of up to half
    the text count.
    """
    codes = np.frombuffer(_WS.sub("", text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = len(codes)
    group, repeats = codes, 0
    for span in range(2, min(most, n // 2) + 1):
        keys = group[: n - span + 1] * (1 << 21) + codes[span - 1 :]
        _, group, counts = np.unique(keys, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            break
        if span >= least:
            repeats = max(repeats, (int(counts.max()) - 1) * span)
    return min(repeats / n, 1.0) if n else 0.0


@F.pandas_udf(T.DoubleType())
def repetition_ratio(x: pd.Series) -> pd.Series:
    return x.map(repetition, na_action="ignore")


# Fixed values of the repeated-span rule: a span's length and occurrences; a loop's longest unit, least length and least turns.
SPAN, OCCURRENCES = 12, 3
LOOP_UNIT, LOOP_LENGTH, LOOP_TURNS = 6, 24, 6


def recurs(text: str, span: int = SPAN, repeats: int = OCCURRENCES) -> bool:
    """Does a span occur ``repeats`` times without overlap, or a short unit loop, white space aside?

    Every place's span is hashed at once, places are sorted by hash, and each group is walked from its first place to the next one that is free. A group that has enough is compared
    letter by letter, so a collision of hashes decides nothing.
    """
    text = _WS.sub("", text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return loops(codes) or _has_groups(text, codes.astype(np.uint64), span, repeats)


def loops(codes: np.ndarray) -> bool:
    """Is there a unit of up to LOOP_UNIT characters that stands LOOP_TURNS times or more in a row, over LOOP_LENGTH characters or more?"""
    for unit in range(1, LOOP_UNIT + 1):
        need = (max(LOOP_TURNS, -(-LOOP_LENGTH // unit)) - 1) * unit
        if len(codes) >= need + unit:
            breaks = np.flatnonzero(codes[unit:] != codes[:-unit])
            if np.diff(np.r_[-1, breaks, len(codes) - unit]).max() > need:
                return True
    return False


def _has_groups(text: str, codes: np.ndarray, span: int, repeats: int) -> bool:
    n = len(codes) - span + 1
    if n < (repeats - 1) * span + 1:
        return False
    # A polynomial of the span's letters, by doubling: spans of 1, 2, 4 ... letters, put together by the binary digits of ``span``.
    base, have, part, length, done = np.uint64(0x9E3779B97F4A7C15), None, codes + np.uint64(1), 1, 0
    with np.errstate(over="ignore"):
        power = base
        while done < span:
            if span & length:
                have = part[:n] if have is None else have * power + part[done : done + n]
                done += length
            if done < span:
                part = part[:-length] * power + part[length:]
                power, length = power * power, length * 2
    order = np.argsort(have, kind="stable")
    starts = np.flatnonzero(np.r_[True, have[order][1:] != have[order][:-1]])
    counts = np.diff(np.r_[starts, n])
    for start, count in zip(starts[counts >= repeats].tolist(), counts[counts >= repeats].tolist()):
        places, free, held = order[start : start + count], 0, []
        if places[-1] - places[0] < (repeats - 1) * span:
            continue
        at = 0
        while at < count and len(held) < repeats:
            held.append(int(places[at]))
            at = int(np.searchsorted(places, held[-1] + span))
        if len(held) == repeats:
            spans = {text[p : p + span] for p in held}
            if len(spans) == 1 or any(text.count(s) >= repeats for s in {text[p : p + span] for p in places.tolist()}):
                return True
    return False


@F.pandas_udf(T.BooleanType())
def has_repeated_span(x: pd.Series) -> pd.Series:
    return x.map(recurs, na_action="ignore").astype("object")


def ratio(a: str, b: str, autojunk: bool, floor: float = 0.0) -> float:
    """difflib's ratio of (a, b), which isn't symmetric; 0 as soon as an upper bound falls below the floor."""
    matcher = SequenceMatcher(None, a, b, autojunk=autojunk)
    if matcher.real_quick_ratio() < floor or matcher.quick_ratio() < floor:
        return 0.0
    return matcher.ratio()


def ratio_udf(autojunk: bool, floor: float = 0.0):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else ratio(x, y, autojunk, floor) for x, y in zip(a, b)], dtype="float64")

    return run
