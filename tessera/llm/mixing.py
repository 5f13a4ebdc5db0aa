"""Mixing sources to target weights by subset-sum budget fitting.

1. Size of a document: its words. Documents are counted by (source, size).
2. Targets: each source's share by weight of the total, cut at ``max_repeats`` times what the source
   has; what is cut off is shared again by weight among the others until none is above. This needs one
   row per source on the driver.
3. A source takes every document as many whole times as fit; the rest of its budget is fitted over the
   counts by size: first an even share of every size, then large sizes greedily, down to a small remaining budget
   that a bounded-knapsack dynamic programme closes as exactly as the counts allow.
4. Documents are selected by count of each size: the ones with the smallest seeded hash. Where a size has
   many documents the cut is first found among hash ranges, then within one range, so no task sorts a hot size.

Selection is a hash limit for each (source, size), so it applies row by row. Rows that share a hash (those equal in id and text) and lie at the limit are
counted, ranked by their other columns, and given out again as often as they are taken; so a document that is stored many times is taken as often as the
budget has it, and no task holds its rows. Which of several rows that are equal throughout is taken can't be told.

Null sources come last in the order of sources, null and empty texts have size 0 and are never taken. Very long texts are one item of their
size like others. An empty table gives an empty mix. Columns of ``docs`` may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import free_names, materialise, quoted

WORDS = r"[^\x20\x09-\x0D]+"
#: Remaining budget, in words, that the dynamic programme fits.
DP_BUDGET = 4096
#: Where a fit falls short, the longest documents that the programme's budget holds.
LONG_DOCUMENTS = 4
#: Words, and items times words, up to which the programme may fit a whole budget.
WHOLE_BUDGET, WHOLE_WORK = 1 << 22, 1 << 28
#: Documents of one (source, size) that one task sorts at most, on average.
RANGE_ROWS = 512


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def cycle_weights(sources: Sequence[str | None]) -> list[float]:
    """1, 2, 3 and again, in the order of the sources."""
    return [float(i % 3 + 1) for i in range(len(sources))]


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: int = 3) -> list[float]:
    """The share of the total by weight, none above ``max_repeats`` times its size."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    active = [i for i in range(len(sizes)) if weights[i] > 0]
    while active:
        whole = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / whole > max_repeats * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(max_repeats * sizes[i])
        left -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many documents of each length to take, so that their lengths sum to ``budget`` or as little below as is found.

    Where that leaves words over, as for few or long documents, the programme's budget follows the longest, and then, if its
    work allows, the programme fits the whole budget.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    best = _fit(lengths, counts, budget, dp_budget)
    longest = LONG_DOCUMENTS * int(lengths.max())
    if (lengths * best).sum() < budget and longest > dp_budget:
        best = max(best, _fit(lengths, counts, budget, longest), key=lambda take: int((lengths * take).sum()))
    items = int(np.ceil(np.log2(np.minimum(counts, budget // lengths) + 1.0)).sum())
    if (lengths * best).sum() < budget <= WHOLE_BUDGET and items * budget <= WHOLE_WORK:
        best = max(best, _knapsack(lengths, counts, budget), key=lambda take: int((lengths * take).sum()))
    return best


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int) -> np.ndarray:
    """An even share, large lengths greedily, and the programme over at most ``dp_budget`` words."""
    total = int((lengths * counts).sum())
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if left <= dp_budget:
            break
        more = min(int(counts[i] - take[i]), (left - dp_budget // 2) // int(lengths[i]))
        if more > 0:
            take[i] += more
            left -= more * int(lengths[i])
    # What is left may lie under the smallest free length: give some of what is taken back to the programme.
    small = [i for i in order[::-1] if lengths[i] <= dp_budget]
    for i in small:
        if left >= dp_budget // 2:
            break
        back = min(int(take[i]), -(-(dp_budget // 2 - left) // int(lengths[i])))
        take[i] -= back
        left += back * int(lengths[i])
    chosen = _knapsack(lengths[small], (counts - take)[small], left)
    take[small] += chosen
    return take


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: counts per length whose sum is the largest that is reachable within ``budget``."""
    out = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return out
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    first = np.full(budget + 1, -1, np.int32)  # the item by which a sum was first reached
    items: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        part, count = 1, min(count, budget // length)
        while count > 0 and not reach[budget]:
            n = min(part, count)
            step = n * length
            new = np.zeros_like(reach)
            new[step:] = reach[: budget + 1 - step]
            new &= ~reach
            first[new] = len(items)
            reach |= new
            items.append((i, n))
            count -= n
            part *= 2
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        i, n = items[first[at]]
        out[i] += n
        at -= n * int(lengths[i])
    return out


@dataclass
class Mix:
    """The plan of a mix: one row per (source, size) with whole copies and a hash limit, and one row per source."""

    sizes: DataFrame  # skey, source_size, target
    plan: DataFrame  # skey, size, repeats, cut (once more every hash up to it; null: none), tie (once more every hash below it, and `extra` rows of it)
    tied: bool  # whether any tie is there
    weights: dict[str | None, float]


def _skey(source: Column) -> Column:
    """A key that is never null and sorts as the source does by code point, null last."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _hash(id_col: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_col, F.xxhash64(text))


def plan_mix(docs: DataFrame, weights: Callable[[Sequence[str | None]], list[float]] = cycle_weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, seed: int = 42) -> tuple[Mix, DataFrame]:
    """The plan, and the narrow table (id, skey, size, h) that it was made from."""
    narrow = docs.select(quoted(id_col).alias("id"), _skey(quoted(source_col)).alias("skey"), size_of(quoted(text_col)).alias("size"), _hash(quoted(id_col), quoted(text_col), seed).alias("h"))
    narrow = materialise(narrow, "mix-narrow")
    hist = materialise(narrow.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    spark = docs.sparkSession
    # One row per source, sorted by its UTF-8 bytes, which is the order of code points.
    totals = sorted(((r["skey"], int(r["total"])) for r in hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()), key=lambda x: x[0].encode())
    names = [None if k == "~" else k[1:] for k, _ in totals]
    own = weights(names)
    goal = targets([t for _, t in totals], own, max_repeats)
    sizes = spark.createDataFrame([(k, t, float(g)) for (k, t), g in zip(totals, goal)], "skey string, source_size long, target double")

    def fitted(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", kind="stable")
        length, count = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        repeats = min(int(target // total), max_repeats) if total else 0
        take = np.zeros(len(length), np.int64)
        some = length > 0
        if total and repeats < max_repeats:
            take[some] = fit(length[some], count[some], int(round(target)) - repeats * total)
        return pd.DataFrame({"skey": key[0], "size": length, "n": count, "repeats": repeats, "take": take})

    joined = hist.join(sizes, "skey")
    took = materialise(joined.groupBy("skey").applyInPandas(fitted, "skey string, size long, n long, repeats long, take long"), "mix-fit")

    every, none = F.lit((1 << 63) - 1).cast("long"), F.lit(None).cast("long")
    settled = took.select("skey", "size", "repeats", "take", F.when(F.col("take") == F.col("n"), every).alias("cut"), none.alias("tie"), none.alias("extra")).where("take = 0 or cut is not null")
    open_ = took.where("take > 0 and take < n").withColumn("ranges", F.ceil(F.col("n") / RANGE_ROWS).cast("long"))
    # The rank of a hash among `ranges` equal ranges of all hashes.
    rank = F.floor((F.col("h").cast("double") / float(1 << 64) + 0.5) * F.col("ranges")).cast("long")
    ranged = narrow.join(open_, ["skey", "size"]).select("skey", "size", "take", "h", F.least(rank, F.col("ranges") - 1).alias("r"))
    ranged = materialise(ranged.groupBy("skey", "size", "take", "r", "h").agg(F.count(F.lit(1)).alias("m")), "mix-ranged")
    in_range = ranged.groupBy("skey", "size", "take", "r").agg(F.sum("m").alias("m"))
    running = F.sum("m").over(Window.partitionBy("skey", "size").orderBy("r"))
    crossing = in_range.withColumn("upto", running).where("upto >= take and upto - m < take").select("skey", "size", "r", (F.col("take") - (F.col("upto") - F.col("m"))).alias("need"))
    upto = F.sum("m").over(Window.partitionBy("skey", "size", "r").orderBy("h"))
    at = ranged.drop("take").join(crossing, ["skey", "size", "r"]).withColumn("upto", upto).where("upto >= need and upto - m < need")
    whole = F.col("upto") == F.col("need")
    cuts = at.select("skey", "size", F.when(whole, F.col("h")).alias("cut"), F.when(~whole, F.col("h")).alias("tie"), F.when(~whole, F.col("need") - (F.col("upto") - F.col("m"))).alias("extra"))
    cut = took.where("take > 0 and take < n").join(cuts, ["skey", "size"]).select(*settled.columns)
    plan = materialise(settled.unionByName(cut).drop("take"), "mix-plan")
    return Mix(sizes, plan, not plan.where("tie is not null").isEmpty(), dict(zip(names, own))), narrow


def _copies(h: Column, repeats: Column, cut: Column, tie: Column) -> Column:
    """How often a row is taken whose hash isn't the tie itself."""
    return repeats + F.when((h <= cut) | (h < tie), 1).otherwise(0)


#: Copies of a row that one row of a plan gives out.
CHUNK = 10_000


def _given_out(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says, in chunks that are spread over the tasks."""
    chunked = rows.where(f"`{times}` > 0").withColumn("mix_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK))))
    part = F.least(F.lit(CHUNK).cast("long"), F.col(times) - F.col("mix_chunk") * CHUNK)
    return chunked.repartition("mix_chunk").withColumn("mix_one", F.explode(F.sequence(F.lit(1).cast("long"), part))).drop("mix_chunk", "mix_one", times)


def _extras(tied: DataFrame, key: list[str], order: str) -> DataFrame:
    """``tied`` rows (key, order, n, extra) with ``more``: how many of a row's n go once more, by order, so that ``extra`` do."""
    earlier = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("extra") - F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return tied.withColumn("more", F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), left)))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target, copies, taken (size times copies)."""
    mix, narrow = plan_mix(docs, **options)
    rows = narrow.join(mix.plan, ["skey", "size"], "left").join(mix.sizes, "skey", "left")
    at_tie = F.coalesce(F.col("h") == F.col("tie"), F.lit(False))
    columns = ["id", "size", "source_size", "target"]
    copies = F.when(F.col("size") == 0, 0).otherwise(_copies(F.col("h"), F.col("repeats"), F.col("cut"), F.col("tie"))).cast("long")
    out = (rows.where(~at_tie) if mix.tied else rows).select(*columns, copies.alias("copies"))
    if mix.tied:
        tied = rows.where(at_tie).groupBy(*columns, "skey", "repeats", "extra").agg(F.count(F.lit(1)).alias("n"))
        tied = _extras(tied, ["skey", "size"], "id")
        split = F.explode(F.array(F.struct(F.col("more").alias("times"), (F.col("repeats") + 1).alias("copies")), F.struct((F.col("n") - F.col("more")).alias("times"), F.col("repeats").alias("copies"))))
        out = out.unionByName(_given_out(tied.withColumn("split", split).select(*columns, "split.copies", "split.times"), "times"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


#: Rows of a plan that may be broadcast (about 60 bytes each); a larger plan is joined by a shuffle.
BROADCAST_PLAN_ROWS = 100_000


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    mix, _ = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    own = ["mix_skey", "mix_size", "mix_h", "mix_repeats", "mix_cut", "mix_tie", "mix_extra", "mix_copies"]
    skey, size, h, repeats, cut, tie, extra, copies = free_names(docs, *own)
    tagged = docs.withColumns({skey: _skey(quoted(source_col)), size: size_of(quoted(text_col)), h: _hash(quoted(id_col), quoted(text_col), seed)})
    plan = mix.plan.where("size > 0 and (repeats > 0 or cut is not null or tie is not null)").toDF(skey, size, repeats, cut, tie, extra)
    if plan.count() <= BROADCAST_PLAN_ROWS:
        plan = F.broadcast(plan)
    met = tagged.join(plan, [skey, size])
    at_tie = F.coalesce(quoted(h) == quoted(tie), F.lit(False))
    times = _copies(quoted(h), quoted(repeats), quoted(cut), quoted(tie))
    plain = (met.where(~at_tie) if mix.tied else met).where(times > 0).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))))
    plain = plain.select(*map(quoted, docs.columns))
    if not mix.tied:
        return plain
    row = F.struct(*map(quoted, docs.columns))
    tied = met.where(at_tie).select(quoted(skey).alias("skey"), quoted(size).alias("size"), quoted(repeats).alias("repeats"), quoted(extra).alias("extra"), row.alias("row"), F.sha2(F.to_json(row), 256).alias("digest"))
    tied = tied.groupBy("skey", "size", "repeats", "extra", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"))
    tied = _extras(tied, ["skey", "size"], "digest").select("row", (F.col("n") * F.col("repeats") + F.col("more")).alias("times"))
    return plain.unionByName(_given_out(tied, "times").select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
