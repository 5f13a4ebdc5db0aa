"""Shared scratch tables and fixed-size key filters that the operators of this folder use."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir, shared_dir, short_batches  # noqa: F401

#: Words of a key filter: 2**17 rows of 16 bytes, so a broadcast of about 2 MB whatever the input.
FILTER_WORDS = 1 << 17
#: Scratch tables that this driver has written and not dropped.
_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    return scratch_dir(spark, label)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage ends at files no executor owns."""
    path = path or scratch_path(df.sparkSession, label)
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession, keep: str) -> Iterator[None]:
    """Scratch tables that are written inside are deleted at the end, but the one of path ``keep``. What is returned must not read them any more."""
    before = len(_made)
    try:
        yield
    finally:
        for path in [p for p in _made[before:] if p != keep]:
            _delete(spark, path)
            _made.remove(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application."""
    _delete(spark, f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}")
    _made.clear()


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores put before those that ``df`` has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _word(key: Column) -> Column:
    return F.pmod(key, F.lit(FILTER_WORDS))


def _mask(key: Column) -> Column:
    one = F.lit(1).cast("long")
    first = F.call_function("shiftleft", one, F.shiftrightunsigned(key, 20).bitwiseAND(63).cast("int"))
    second = F.call_function("shiftleft", one, F.shiftrightunsigned(key, 40).bitwiseAND(63).cast("int"))
    return first.bitwiseOR(second)


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A blocked Bloom filter of the long column ``key``: at most FILTER_WORDS rows (word, bits).

    A filter that is full lets everything pass, so it may cost work but never loses a key.
    """
    return keys.where(F.col(key).isNotNull()).groupBy(_word(F.col(key)).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def flag_members(df: DataFrame, key: str, filt: DataFrame, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: false only where ``key`` is surely not in the filter."""
    word, bits, mask = free_names(df, "flt_word", "flt_bits", "flt_mask")
    table = filt.select(F.col("word").alias(word), F.col("bits").alias(bits))
    joined = df.join(F.broadcast(table), _word(quoted(key)) == table[word], "left").withColumn(mask, _mask(quoted(key)))
    hit = F.coalesce(quoted(bits).bitwiseAND(quoted(mask)) == quoted(mask), F.lit(False))
    return joined.withColumn(flag, hit).drop(word, bits, mask)


def retain(docs: DataFrame, id_col: str, text_col: str, verdict: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a verdict keeps, with all their columns.

    ``verdict`` has one row (id, th, keep) per row of ``docs``, th being xxhash64 of the text. Rows that
    are equal in id and text are one document: one of them stays if any is kept, the one whose columns have the smallest hash. Rows that the verdict
    leaves alone go through without a shuffle; only the others, found by a key filter, are joined.
    """
    cols = docs.columns
    n_id, n_th, n_key, n_hit = free_names(docs, "r_id", "r_th", "r_key", "r_hit")
    per_key = verdict.groupBy("id", "th").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("n")).where("not keep or n > 1")
    touched = materialise(per_key.withColumn("key", F.xxhash64("id", "th")), "touched")
    tagged = docs.withColumns({n_id: quoted(id_col), n_th: F.xxhash64(quoted(text_col))}).withColumn(n_key, F.xxhash64(quoted(n_id), quoted(n_th)))
    tagged = flag_members(tagged, n_key, key_filter(touched, "key"), n_hit)
    through = tagged.where(~quoted(n_hit)).select(*map(quoted, cols))
    names = free_names(tagged, "v_id", "v_th", "v_keep", "v_n")
    v = touched.select(*(F.col(c).alias(n) for c, n in zip(("id", "th", "keep", "n"), names)))
    met = tagged.where(quoted(n_hit)).join(v, quoted(n_id).eqNullSafe(v[names[0]]) & (quoted(n_th) == v[names[1]]), "left")
    alone = met.where(quoted(names[2]).isNull()).select(*map(quoted, cols))
    several = met.where(quoted(names[2])).groupBy(quoted(n_id), quoted(n_th)).agg(F.min_by(F.struct(*map(quoted, cols)), F.xxhash64(*map(quoted, cols))).alias("row"))
    return through.unionByName(alone).unionByName(several.select(*(F.col("row").getField(c).alias(c) for c in cols)))


def without(docs: DataFrame, keys: list[Column], refused: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` aren't a row of ``refused``, with all their columns; nulls are equal. Only rows that a key filter can't let through are joined."""
    cols, names = docs.columns, free_names(docs, *(f"w_{i}" for i in range(len(keys))), "w_key", "w_hit")
    own, key, hit = names[:-2], names[-2], names[-1]
    refused = materialise(refused.withColumn("key", F.xxhash64(*(F.col(c) for c in refused.columns))), "refused")
    tagged = docs.withColumns(dict(zip(own, keys))).withColumn(key, F.xxhash64(*map(quoted, own)))
    tagged = flag_members(tagged, key, key_filter(refused, "key"), hit)
    out = refused.select(*(F.col(c).alias(f"o_{i}") for i, c in enumerate(refused.columns[:-1])))
    same = [quoted(c).eqNullSafe(out[f"o_{i}"]) for i, c in enumerate(own)]
    met = tagged.where(quoted(hit)).join(out, same, "left_anti")
    return tagged.where(~quoted(hit)).select(*map(quoted, cols)).unionByName(met.select(*map(quoted, cols)))
