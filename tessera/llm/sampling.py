"""Bounded samples of labelled documents for the classifiers of this folder."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import quoted

#: The bound of a sample's texts in bytes, beside that of its rows.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of labelled documents in the order of their ids: those with the smallest hashed ids, at most ``rows`` whose texts have at most ``max_bytes``.

    Labels that are null, have no document, or whose id's text has crc32 mod 3 = 1 (held out) are left out. An id that is repeated counts
    once, with its largest label and its least text, and is aggregated before anything is collected: ``rows`` ids and sizes
    and then ``max_bytes`` of texts are all that reaches the driver. Empty tables give an empty sample.
    """
    own = labels.select(quoted(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    own = own.where(F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % 3 != 1).groupBy("id").agg(F.max("y").alias("y"))
    picked = own.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    # At most ``rows`` rows of 12 bytes are broadcast.
    found = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    sizes = found.select("id", F.xxhash64("id").alias("h"), F.octet_length("text").alias("n")).collect()
    sizes.sort(key=lambda r: (r["h"], r["id"]))
    fits = [(r["id"],) for r, upto in zip(sizes, accumulate(r["n"] for r in sizes)) if upto <= max_bytes]
    if not fits:
        return [], []
    if len(fits) < len(sizes):
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame(fits, found.select("id").schema)), "id")
    got = sorted(found.toArrow().to_pylist(), key=lambda r: r["id"])
    return [r["text"] for r in got], [r["y"] for r in got]


def held_out(id_col: str = "id") -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
