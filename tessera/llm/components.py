"""Connected components of an edge list, as Parquet rounds in the shared folder.

A round first contracts each bounded chunk of edges to the forest of its stars (union-find in one task,
CHUNK_EDGES at most), then, while there is more than one chunk, applies a large-star and a small-star
step, until nothing changes. Minima come from partial aggregation and are joined back, so a hub is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: Edges that one task contracts at once (16 bytes each).
CHUNK_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for every node that isn't the smallest itself."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        low, high = np.minimum(ru, rv), np.maximum(ru, rv)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[off], nodes[root[off]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in part]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a, b)], ["u", "v"])

    part, rows = [], 0
    for batch in batches:
        part.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_EDGES:
            yield done(part)
            part, rows = [], 0
    if part:
        yield done(part)


def _stars(edges: DataFrame, label: str) -> DataFrame:
    """One large-star and one small-star step over rows (u, v)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    large = materialise(large, label)
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    met = down.join(least, "u")
    small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return materialise(small.where("u != v").distinct(), label)


def components(edges: DataFrame, chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """Rows (node, root) from rows (u, v) of longs: each node that isn't the smallest of its component."""
    edges = materialise(edges.select("u", "v").where("u != v"), "cc-edges")
    mark = None
    while True:
        chunks = max(1, -(-edges.count() // chunk_edges))
        spread = edges.coalesce(1) if chunks == 1 else edges.repartition(chunks)
        edges = materialise(spread.mapInArrow(_contract, "u long, v long"), "cc-forest")
        if chunks == 1:
            break
        edges = _stars(edges, "cc-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
