"""Spelling variants by anagram hashing: integer keys from sums of letter powers, joined where they differ by one letter.

1. Runs of Latin letters are cut from whole texts and counted. A letter is deleted from one run in NOISE, chosen by a checksum of
   document and run, which plants slips of the pen whose right form is known.
2. A word's key is the sum of the fifth powers of its code points, so all its anagrams share it, and adding, removing or exchanging a letter
   adds a known value. Sums of two fifth powers below 256 are all different, so each word is given out under its key less each of its letters: two words
   that differ by an exchange meet where both lack their own letter (K - c = K' - d), a word and one with a letter more where the longer lacks it (K - c = K').
3. Words that meet are near if their letters agree in order but for that one edit (Levenshtein distance 1, in the join's own condition, so a bucket of anagrams
   makes no rows of pairs). A bucket is cut by the first HEAD letters, and once more by the last TAIL ones: an edit behind the head leaves the head alone, one within
   it leaves the tail alone, and every pair is met once.
4. A word's form is its most frequent near word, if that is FACTOR times as frequent; forms are followed to their roots by pointer jumping over written tables.
   Frequency grows by FACTOR at each step, so a chain has at most log10 of the largest count steps.

Counts come from partial aggregation, so a word that fills a third of all text is one number a task; no text is shuffled. A word has at most 90 near words for a place and
operation, and a bucket holds different words only. Nulls count as no text, a null id as an empty one; empty texts and empty tables give no words; ties of forms go to the
word that is least in code-point order; repeated rows count again. Columns other than id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise, quoted

LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
NOISE = 31
POWER = 5
#: Letters of a word that cut a bucket; an edit within the first HEAD letters leaves the last LEAST_LENGTH - HEAD ones as they are.
HEAD = 3
TAIL = LEAST_LENGTH - HEAD
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def planted(doc_id: Column, run: Column) -> Column:
    """The lower-cased run, one letter less where NOISE divides the checksum of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % NOISE == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (word, n): words of LEAST_LENGTH code points that occur LEAST_COUNT times or more."""
    # A deletion only shortens, so shorter runs are never words.
    found = F.regexp_extract_all(quoted(text_col).cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(quoted(id_col).alias("id"), F.explode(found).alias("run"))
    low = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("low"))
    words = low.select(planted(F.col("id"), F.col("low")).alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def anagram_key(letters: Column) -> Column:
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s + _power(c))


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, other, other_n): every ordered pair of words that differ by one inserted, deleted or replaced code point, once.

    Buckets are known by 64-bit hashes of key and cut: should two collide, words that aren't near still make no row.
    """
    letters = words.select("word", "n", F.split("word", "").alias("letters"))
    keyed = letters.select("word", "n", "letters", anagram_key(F.col("letters")).alias("key"))
    lacking = F.transform(F.array_distinct("letters"), lambda c: F.struct((F.col("key") - _power(c)).alias("key"), F.lit(True).alias("lacks")))
    keys = keyed.select("word", "n", F.explode(F.concat(F.array(F.struct(F.col("key"), F.lit(False).alias("lacks"))), lacking)).alias("k"))
    head, tail = F.substring("word", 1, HEAD), F.substring("word", -TAIL, TAIL)
    cuts = F.explode(F.array(F.struct(F.lit(True).alias("first"), head.alias("part")), F.struct(F.lit(False).alias("first"), tail.alias("part"))))
    rows = keys.select("word", "n", F.col("k.key").alias("key"), F.col("k.lacks").alias("lacks"), cuts.alias("cut"))
    rows = rows.select("word", "n", "lacks", F.col("cut.first").alias("first"), F.xxhash64("key", "cut.first", "cut.part").alias("bucket"))
    a, b = rows.alias("a"), rows.alias("b")
    once = F.col("a.first") | (F.substring("a.word", 1, HEAD) != F.substring("b.word", 1, HEAD))
    order = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    # Rows of buckets are many times the words, so the sizes that Spark takes from the words' files must not choose a broadcast.
    pairs = a.join(b.hint("merge"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.lacks") | F.col("b.lacks")) & (F.col("a.word") != F.col("b.word")) & once & order)
    return pairs.select(F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) from rows (word, form) in which no chain of forms returns to itself: the last word of each chain."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        now = materialise(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spelling-roots")
        moved = now.where("moved").limit(1).count()
        now = now.drop("moved")
        if not moved:
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = materialise(word_counts(docs, id_col, text_col), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    held = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    held = held.withColumn("has", F.coalesce(F.col("form_n") >= FACTOR * F.col("n"), F.lit(False)))
    held = materialise(
        held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), F.col("form_n")).alias("form_n")), "spelling-near"
    )
    tops = roots(held.where("form is not null").select("word", "form"))
    return held.join(tops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
