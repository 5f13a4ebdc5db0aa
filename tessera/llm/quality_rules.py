"""Quality rules: base counts, then distribution divergence from language references.

For every text: the base counts, a histogram of character classes and a histogram of its language's common words. A
document's divergence is the Jensen-Shannon distance (base 2, 0 to 1) of either histogram from its language's reference. A text is kept if it
passes the base rules and no test that applies to it exceeds its limit. Minimum-length guards leave short texts out of a test that
their few counts can't bear.

All of this is learnt from the table, over all documents:

* Languages: those that the table names and that have at least one word in MIN_SHARE of all words.
* Common words: those that make up at least one word in COMMON_SHARE of all words of a language. Each task counts in chunks and reports what makes up
  half of that in a chunk; a word that is common in all has at least half of its count in such chunks, so none is missed and what is reported is bounded. The exact
  counts decide.
* References: a language's mean histogram over its documents that pass the base rules, taken again, TRIMS times, over the nearer half of them, so that
  junk has no part in it. A language of fewer than MIN_REFERENCE such documents has none.
* Limits: by language and size (a power of two of characters or words) the median distance, SPREADS times the median deviation from it, and ALLOWANCE for kinds
  of documents. A size with fewer than MIN_REFERENCE documents takes the limit of the next smaller size that has one, else of the next larger.

What goes to the driver and back is fixed in size: languages (MIN_SHARE of them at most) by bins. Distances are
counted in steps of 1/STEPS, so that medians are exact and don't hang on the order of the rows.

Null and empty texts have no words and fail the base rules. A document whose language has no reference is held to the base
rules only; one whose language is null to those and to the reference nearest in characters. Ties: a distance at its limit passes. Very long texts are
measured whole, in memory linear in their words. Repeated rows count as often as they stand there and get the same verdict each. An empty table
has no references and gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .caches import hold
from .store import materialise, quoted, short_batches, without

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Percent of words in repeated windows beyond which a text fails.
MAX_REPEAT = 50
#: Characters and words below which a text's histogram isn't tested.
MIN_CHARS_TESTED, MIN_WORDS_TESTED = 200, 50
#: A word is common that is at least one in so many of its language, a language known that has at least one word in so many of all.
COMMON_SHARE, MIN_SHARE = 250, 1000
#: Documents of a language, or of one size of it, that a reference or a limit rests on at least.
MIN_REFERENCE = 20
TRIMS, STEPS = 2, 1000
SPREADS, ALLOWANCE = 6, 0.1
#: Words that a task counts, and distinct ones that it holds, before it reports a chunk.
CHUNK_WORDS, CHUNK_DISTINCT = 4_000_000, 150_000

_SPACES = b"\t\n\x0b\x0c\r "
#: The class of each byte of UTF-8; bytes that continue a character count in none.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "bang", "symbol", "control", "other")


def _class_map() -> np.ndarray:
    out = np.zeros((256, len(CLASSES)))
    for b in range(256):
        c = chr(b)
        k = (
            None if 0x80 <= b < 0xC0 else 9 if b >= 0xC0 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit()
            else 3 if c in " \t" else 4 if b in _SPACES else 5 if c in ".,;:?'\"-()" else 6 if c == "!" else 8 if b < 32 or b == 127 else 7
        )
        if k is not None:
            out[b, k] = 1
    return out


_CLASS_OF = _class_map()
_EDGES = b".,;:!?\"'()"


def plain_word(word: bytes) -> str:
    """A word as it is counted: without marks at either end, in lower case; empty if anything but letters is left."""
    plain = word.strip(_EDGES).decode("utf-8", "replace").lower()
    return plain if plain.isalpha() else ""


class _Bins(dict):
    """The bin of a word as it stands in a text, or -1; it forgets all when it holds many words."""

    def __init__(self, common: list[str]):
        self.bins = {w: i for i, w in enumerate(common)}

    def __missing__(self, word: bytes) -> int:
        if len(self) > 40_000:
            self.clear()
        self[word] = out = self.bins.get(plain_word(word), -1)
        return out


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of ``window`` words found at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    keys = codes[:n]
    for i in range(1, window):
        _, keys = np.unique(keys * len(ids) + codes[i : n + i], return_inverse=True)
    twice = np.bincount(keys)[keys] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measure(text: str | None, bins: _Bins) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, common-word counts)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(by_byte[:128].sum() + by_byte[192:].sum())
    seen: set[bytes] = set()
    dups = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dups += 1
        elif line.split(None, 1):
            seen.add(line)
    found = np.fromiter(map(bins.__getitem__, words), np.int64, len(words))
    common = np.bincount(found[found >= 0], minlength=len(bins.bins))
    symbols = int(by_byte[[ord(c) for c in SYMBOLS]].sum())
    return len(words), chars - int(by_byte[list(_SPACES)].sum()), symbols, dups, repeated_words(words), by_byte @ _CLASS_OF, common


def base_failed(n_words: int | Column, n_repeat: int | Column) -> bool | Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT * n_words)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance in base 2 between the last axes, which sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.clip(terms.sum(-1) / 2, 0, 1))


# --- common words -----------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, n) of what makes up half a common word's share in a chunk; the word "" has the chunk's total."""
    kind = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def report() -> pa.RecordBatch:
        rows = []
        for lang, raw in counts.items():
            plain: Counter = Counter()
            for word, n in raw.items():
                plain[plain_word(word)] += n
            total = sum(plain.values())
            rows.append({"lang": lang, "word": "", "n": total})
            rows += [{"lang": lang, "word": w, "n": n} for w, n in plain.items() if w and 2 * COMMON_SHARE * n >= total]
        return pa.RecordBatch.from_pylist(rows, kind)

    hold("rules")
    counts: dict[str, Counter] = {}
    words = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            own = (text.as_py() or b"").split()
            counts.setdefault(lang, Counter()).update(own)
            words += len(own)
        if words > CHUNK_WORDS or sum(map(len, counts.values())) > CHUNK_DISTINCT:
            yield report()
            counts, words = {}, 0
    yield report()


def likely_words(base: DataFrame) -> dict[str, list[str]]:
    """By language all words that may be common, from rows (lang, text)."""
    named = base.where("lang is not null").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    sums = named.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = materialise(sums, "rules-words")
    totals = sums.where("word = ''").select("lang", F.col("n").alias("total"))
    every = totals.agg(F.sum("total")).first()[0] or 0
    large = totals.where(F.col("total") * MIN_SHARE >= every)  # at most MIN_SHARE languages
    rows = sums.join(F.broadcast(large), "lang").where((F.col("word") == "") | (F.col("n") * 2 * COMMON_SHARE >= F.col("total")))
    out: dict[str, list[str]] = {}
    for r in rows.select("lang", "word").collect():  # languages x 2 COMMON_SHARE at most
        out.setdefault(r["lang"], []).append(r["word"])
    return {lang: sorted(set(words) - {""}) for lang, words in sorted(out.items())}


# --- references and limits --------------------------------------------------------------------------

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(likely: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("rules")
        bins = {lang: _Bins(words) for lang, words in likely.items()}
        none = _Bins([])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [measure(t.as_py(), bins.get(lang, none)) for t, lang in zip(part.column("text"), part.column("lang").to_pylist())]
                cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)] + [pa.array([r[i].astype(np.int32) for r in rows], pa.list_(pa.int32())) for i in (5, 6)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), part.column("lang"), *cols], ["id", "th", "lang", *_COUNTS, "classes", "common"])

    return run


def common_words(measured: DataFrame, likely: dict[str, list[str]]) -> dict[str, list[int]]:
    """By language the places of those likely words that are common, by exact counts over all documents."""
    known = measured.where(F.col("lang").isin(list(likely)))
    words = known.groupBy("lang").agg(F.sum("n_words").alias("total"))
    bins = known.select("lang", F.posexplode("common")).where("col > 0").groupBy("lang", "pos").agg(F.sum("col").alias("n"))
    out: dict[str, list[int]] = {lang: [] for lang in likely}
    for r in bins.join(F.broadcast(words), "lang").where(F.col("n") * COMMON_SHARE >= F.col("total")).select("lang", "pos").collect():  # languages x COMMON_SHARE at most
        out[r["lang"]].append(r["pos"])
    return {lang: sorted(places) for lang, places in out.items()}


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


class _Histograms:
    """The normalised histograms of the rows of a batch that are of one language, in characters and in common words."""

    def __init__(self, batch: pa.RecordBatch, places: list[int], width: int):
        classes, self.n_words = _matrix(batch.column("classes"), len(CLASSES)), batch.column("n_words").to_numpy()
        self.n_chars = classes.sum(-1)
        self.chars = classes / np.maximum(self.n_chars, 1)[:, None]
        common = _matrix(batch.column("common"), width)[:, places] if width else np.zeros((batch.num_rows, 0))
        rest = self.n_words - common.sum(-1)
        self.words = np.concatenate([common, rest[:, None]], -1) / np.maximum(self.n_words, 1)[:, None]


def _by_language(batch: pa.RecordBatch, likely: dict[str, list[str]], common: dict[str, list[int]]) -> Iterator[tuple[str, np.ndarray, _Histograms]]:
    langs = np.array(batch.column("lang").to_pylist(), object)
    for lang in common:
        rows = np.flatnonzero(langs == lang)
        if len(rows):
            yield lang, rows, _Histograms(batch.take(pa.array(rows)), common[lang], len(likely[lang]))


References = dict[str, tuple[np.ndarray, np.ndarray]]
_STEP_ROWS = "lang string, test int, size int, step int, n long"


def _summed(likely: dict, common: dict, refs: References | None, near: dict | None):
    """A task's sums of normalised histograms by language and test, of all rows or of those no farther than the median; rows (lang, test, n, hist)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], list] = {}
        for batch in batches:
            for lang, _, h in _by_language(batch, likely, common):
                for test, hist in enumerate((h.chars, h.words)):
                    own = hist if refs is None else hist[_step(js_distance(hist, refs[lang][test])) <= near[lang, test]] if lang in refs else hist[:0]
                    t = total.setdefault((lang, test), [0, np.zeros(hist.shape[1])])
                    t[0] += len(own)
                    t[1] += own.sum(0)
        rows = [{"lang": lang, "test": test, "n": n, "hist": hist.tolist()} for (lang, test), (n, hist) in total.items() if n]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("test", pa.int32()), ("n", pa.int64()), ("hist", pa.list_(pa.float64()))]))

    return run


def _step(distance: np.ndarray) -> np.ndarray:
    return np.ceil(distance * STEPS - 1e-6).astype(np.int32)


def _size(count: np.ndarray) -> np.ndarray:
    """The power of two of a count."""
    return np.frexp(np.maximum(count, 1).astype(float))[1] - 1


def _stepped(likely: dict, common: dict, refs: References):
    """How many rows of a task have which distance: rows (lang, test, size, step, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for lang, _, h in _by_language(batch, likely, common):
                if lang in refs:
                    for test, (hist, count) in enumerate(((h.chars, h.n_chars), (h.words, h.n_words))):
                        seen.update(zip([lang] * len(count), [test] * len(count), _size(count).tolist(), _step(js_distance(hist, refs[lang][test])).tolist()))
        rows = [{"lang": k[0], "test": k[1], "size": k[2], "step": k[3], "n": n} for k, n in seen.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("test", pa.int32()), ("size", pa.int32()), ("step", pa.int32()), ("n", pa.int64())]))

    return run


def _median(counts: dict[int, int]) -> int:
    half, seen = sum(counts.values()) / 2, 0
    for step in sorted(counts):
        seen += counts[step]
        if seen >= half:
            return step
    return 0


class Judge:
    """Common words, references and limits of every language of a corpus."""

    def __init__(self, measured: DataFrame, likely: dict[str, list[str]]):
        self.likely, self.common = likely, common_words(measured, likely) if likely else {}
        good = measured.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).where(F.col("lang").isin(list(likely))).select("lang", "n_words", "classes", "common")
        self.refs: References = {}
        self.limits: dict[tuple[str, int], dict[int, float]] = {}
        if not likely:
            return
        refs = self._means(good, None, None)
        for _ in range(TRIMS):
            refs = self._means(good, refs, {k: _median(self._merged(v)) for k, v in self._steps(good, refs).items()})
        self.refs = refs
        for key, by_size in self._steps(good, refs).items():
            for size, counts in by_size.items():
                if sum(counts.values()) >= MIN_REFERENCE:
                    m = _median(counts)
                    off: Counter = Counter()
                    for step, n in counts.items():
                        off[abs(step - m)] += n
                    self.limits.setdefault(key, {})[size] = (m + SPREADS * _median(off)) / STEPS + ALLOWANCE

    def _means(self, good: DataFrame, refs: References | None, near: dict | None) -> References:
        parts = good.mapInArrow(_summed(self.likely, self.common, refs, near), "lang string, test int, n long, hist array<double>")
        summed = parts.select("lang", "test", "n", F.posexplode("hist")).groupBy("lang", "test", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total"))
        found: dict[str, dict] = {}
        for r in summed.collect():  # languages x bins
            # Rounded: the order in which floats are summed differs from run to run.
            if refs is not None or r["n"] >= MIN_REFERENCE:
                found.setdefault(r["lang"], {})[r["test"], r["pos"]] = round(r["total"] / r["n"], 9)
        out = {}
        for lang, v in sorted(found.items()):
            hists = [np.array([x for (t, _), x in sorted(v.items()) if t == test]) for test in (0, 1)]
            out[lang] = tuple(h / h.sum() for h in hists)
        return out

    def _steps(self, good: DataFrame, refs: References) -> dict[tuple[str, int], dict[int, dict[int, int]]]:
        parts = good.mapInArrow(_stepped(self.likely, self.common, refs), _STEP_ROWS).groupBy("lang", "test", "size", "step").agg(F.sum("n").alias("n"))
        out: dict = {}
        for r in parts.collect():  # languages x sizes x STEPS at most
            out.setdefault((r["lang"], r["test"]), {}).setdefault(r["size"], {})[r["step"]] = r["n"]
        return out

    @staticmethod
    def _merged(by_size: dict[int, dict[int, int]]) -> dict[int, int]:
        out: Counter = Counter()
        for counts in by_size.values():
            out.update(counts)
        return out

    def limit(self, lang: str, test: int, count: np.ndarray) -> np.ndarray:
        known = self.limits.get((lang, test), {})
        sizes = _size(count)
        if not known:
            return np.full(len(count), np.inf)
        by = {s: known[max((k for k in known if k <= s), default=min(known))] for s in set(sizes.tolist())}
        return np.array([by[s] for s in sizes.tolist()])

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(base_failed, kept, distance in characters, distance in words) of measured rows; a distance is NaN without a reference."""
        n_words = batch.column("n_words").to_numpy()
        failed = base_failed(n_words, batch.column("n_repeat_words").to_numpy())
        kept, distance = ~failed, np.full((2, len(failed)), np.nan)
        for lang, rows, h in _by_language(batch, self.likely, self.common):
            if lang in self.refs:
                for test, (hist, count, least) in enumerate(((h.chars, h.n_chars, MIN_CHARS_TESTED), (h.words, h.n_words, MIN_WORDS_TESTED))):
                    distance[test, rows] = d = js_distance(hist, self.refs[lang][test])
                    kept[rows] &= ~((count >= least) & (d > self.limit(lang, test, count)))
        rows = np.flatnonzero(np.array([x is None for x in batch.column("lang").to_pylist()], bool))
        if len(rows) and self.refs:
            h = _Histograms(batch.take(pa.array(rows)), [], 0)
            every = np.array([js_distance(h.chars, chars) for chars, _ in self.refs.values()])
            limits = np.array([self.limit(lang, 0, h.n_chars) for lang in self.refs])
            distance[0, rows] = every.min(0)
            kept[rows] &= ~((h.n_chars >= MIN_CHARS_TESTED) & (every.min(0) > limits[every.argmin(0), np.arange(len(rows))]))
        return failed, kept, distance[0], distance[1]


def _verdicts(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["id", "th", "lang", *_COUNTS]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, judge(batch))], [*names, "base_failed", "kept", "char_distance", "word_distance"])

    return run


def _base(docs: DataFrame, id_col: str | None, text_col: str, lang_col: str | None) -> DataFrame:
    short_batches(docs.sparkSession, 250)
    lang = quoted(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    own = quoted(id_col) if id_col else F.lit(0)
    return docs.select(own.alias("id"), F.xxhash64(quoted(text_col)).alias("th"), lang.alias("lang"), quoted(text_col).cast("string").alias("text"))


def _judged(base: DataFrame) -> DataFrame:
    kind = dict(base.dtypes)["id"]
    likely = likely_words(base.select("lang", "text"))
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    measured = materialise(base.mapInArrow(_measured(likely), f"id {kind}, th long, lang string, {counts}, classes array<int>, common array<int>"), "rules-measured")
    return measured.mapInArrow(_verdicts(Judge(measured, likely)), f"id {kind}, th long, lang string, {counts}, base_failed boolean, kept boolean, char_distance double, word_distance double")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Per row of ``docs``: id, th (xxhash64 of the text), the base counts, base_failed, kept and both distances (NaN without a reference)."""
    return _judged(_base(docs, id_col, text_col, lang_col)).drop("lang")


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Texts are measured once; what is rejected is recognised by text hash and language."""
    refused = _judged(_base(docs, None, text_col, lang_col)).where("not kept").select("th", "lang").distinct()
    lang = quoted(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    return without(docs, [F.xxhash64(quoted(text_col)), lang], refused)
