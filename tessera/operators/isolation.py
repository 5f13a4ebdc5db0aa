"""Isolation of splits and contamination by reference texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import materialise


def overlaps(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, left_id: str, right_id: str) -> DataFrame:
    """Rows (left_id, right_id, key) that share a key: an equi-join of ids and keys, the key's digest in place of the text."""
    a = left.select(F.col(left_id).alias("left_id"), F.sha2(left_key, 256).alias("key"))
    b = right.select(F.col(right_id).alias("right_id"), F.sha2(right_key, 256).alias("key"))
    return a.join(b, "key").select("left_id", "right_id", "key")


def isolated(rows: DataFrame, others: list[DataFrame], key: Column, other_keys: list[Column]) -> DataFrame:
    """The rows whose key no other table has."""
    seen = reduce(DataFrame.unionByName, [o.select(F.sha2(k, 256).alias("_k")) for o, k in zip(others, other_keys)])
    return rows.withColumn("_k", F.sha2(key, 256)).join(seen.distinct(), "_k", "left_anti").drop("_k")


def nested_users(rows: DataFrame, top: str | None, messages: str | None) -> DataFrame:
    """Every user text of a row: its top-level one and those of its messages (arrays of role, content)."""
    parts = []
    if top:
        parts.append(F.array(F.col(top)))
    if messages:
        parts.append(F.transform(F.filter(F.col(messages), lambda m: m["role"] == "user"), lambda m: m["content"]))
    return rows.select(F.explode(F.array_compact(F.concat(*parts))).alias("user"))


def word_grams(text: Column, n: int) -> Column:
    """Distinct n-grams of words, joined by spaces."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    none = F.array().cast("array<string>")
    return T.let(words, lambda w: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(none))


#: Rows of grams (16 bytes, or a few words' text) that may be sent to every task.
BROADCAST_GRAMS = 1_000_000


def _sent(grams: DataFrame) -> DataFrame:
    """A written table of grams, to be broadcast while it is small."""
    return F.broadcast(grams) if grams.count() <= BROADCAST_GRAMS else grams


def contamination(docs: DataFrame, reference: DataFrame, doc_id: str, doc_text: str, ref_id: str, ref_text: str, n: int = 8) -> DataFrame:
    """Rows (doc, ref, hits, ref_grams): how many of a reference's word n-grams a document holds.

    Grams are hashes of words. While the references have BROADCAST_GRAMS of them at most they go to every task, and only hits are shuffled; beyond that the
    documents' grams are shuffled to meet them. Hits are over distinct grams.
    """
    g = lambda df, i, t, name: df.select(F.col(i).alias(name), F.explode(word_grams(F.col(t), n)).alias("gram")).select(name, F.xxhash64("gram").alias("g"))
    ref = materialise(g(reference, ref_id, ref_text, "ref"), "reference-grams")
    sizes = ref.groupBy("ref").agg(F.count(F.lit(1)).alias("ref_grams"))
    hits = g(docs, doc_id, doc_text, "doc").join(_sent(ref), "g").groupBy("doc", "ref").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sizes, "ref").select("doc", "ref", "hits", "ref_grams")


def copy_coverage(rows: DataFrame, ident: list[str], text: str, reference: DataFrame, ref_text: str, n: int = 8) -> DataFrame:
    """Rows (ident, normalized_length, coverage): the share of a text's characters, white space and punctuation aside, that n-grams of the reference texts cover.

    The texts' grams meet the reference's distinct ones, which go to every task while there are BROADCAST_GRAMS of them at most; covered positions are then counted
    from the gaps between hits: a hit covers n characters, less what the next one covers again.
    """
    def spread(t: Column) -> Column:
        return F.posexplode(T.ngrams(T.copy_form(t), n))

    grams = materialise(reference.select(spread(F.col(ref_text))).select(F.col("col").alias("gram")).distinct(), "copy-grams")
    size = rows.select(*ident, F.length(T.copy_form(F.col(text))).cast("long").alias("normalized_length"))
    hits = rows.select(*ident, spread(F.col(text))).withColumnRenamed("col", "gram").join(_sent(grams), "gram", "left_semi")
    at = hits.groupBy(*ident).agg(F.array_sort(F.collect_list("pos")).alias("at"))
    gaps = F.zip_with(F.slice("at", 2, F.size("at")), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(n)))
    covered = F.aggregate(gaps, F.lit(n), lambda s, d: s + d)
    met = size.join(at.select(*ident, covered.alias("covered")), ident, "left")
    return met.select(*ident, "normalized_length", F.when(F.col("normalized_length") >= n, F.coalesce("covered", F.lit(0)) / F.col("normalized_length")).otherwise(0.0).alias("coverage"))
