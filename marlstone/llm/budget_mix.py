"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length (in words) and source. Each source's
target is a budget of words. Every length first gives its proportional share;
what the shares leave over is fitted exactly by a bounded-knapsack dynamic
programme over the lengths still available (each document once up to one pass
over the source, twice beyond it), and single additions, removals and exchanges
follow while one brings the sum nearer to the budget. Which documents of a length
are taken is decided by a seeded hash of identifier, size and text, so reruns
agree; of rows equal in all of these just as many are taken as the plan needs.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own and comes last; null and repeated identifiers are told apart
by their texts, and equal rows by their place in the input, so each row is taken
or left by itself; sources without words have target 0; extra columns are
ignored by ``mix`` and carried by ``mixed_documents``, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (3, 1, 2)
SHARE, MOST_PASSES = 1.5, 2.0
SEED = 20_240
#: The dynamic programme runs over budgets up to this many words; larger ones are first reduced by proportional shares.
DP_WORDS = 1 << 15
#: A sum may end so many words above its budget if none below is nearer.
OVER_WORDS = 512
#: Words that the programme gets to fit at least, where documents can be given back for it.
SLACK_WORDS = 1 << 12
#: Rows of one source and length that one task ranks.
BUCKET_ROWS = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """Word targets by source for ``sizes(_source, _source_size)``: the budget is shared by weight, each
    target stops at ``most`` times its source's size, and the excess is shared anew until none is above.

    Sources stay distributed: their places in code point order come from a sort's partitions
    (one row each on the driver), and each new level of sharing is one aggregation.
    """
    spark = sizes.sparkSession
    ordered = cut(sizes.orderBy(F.col("_source").asc_nulls_last()).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    starts, before = [], 0
    for r in ordered.groupBy("_p").agg(F.min("_m").alias("m"), F.count("*").alias("n")).orderBy("_p").collect():
        starts.append((r["_p"], before - r["m"]))
        before += r["n"]
    shift = F.broadcast(spark.createDataFrame(starts, "_p int, _shift long"))
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.pmod(F.col("_m") + F.col("_shift"), F.lit(len(weights))).cast("int")]
    weighed = cut(ordered.join(shift, "_p").select("_source", "_source_size", weight.alias("_w"), (F.lit(float(most)) * F.col("_source_size")).alias("_cap")))
    level, above = 0.0, True
    while above:
        full = F.col("_cap") < level * F.col("_w")
        r = weighed.agg(F.sum("_source_size").alias("s"), F.sum(F.when(full, F.col("_cap"))).alias("capped"), F.sum(F.when(~full, F.col("_w"))).alias("w")).collect()[0]
        reached = (share * (r["s"] or 0) - (r["capped"] or 0.0)) / r["w"] if r["w"] else level
        above, level = reached > level, max(reached, level)
    return weighed.select("_source", "_source_size", F.least("_cap", F.lit(level) * F.col("_w")).alias("_target"))


def knapsack(lengths: np.ndarray, available: np.ndarray, budget: int, over: int = OVER_WORDS) -> np.ndarray:
    """How many of each length sum up nearest to ``budget`` (at most ``over`` above it): bounded knapsack over reachable sums.

    Sums are bits of one integer; multiples of a length are added by doubling. The programme
    stops as soon as the budget itself is reachable.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0:
        return take
    most = budget + over
    mask, reach, steps = (1 << (most + 1)) - 1, 1, []
    for i in np.flatnonzero((lengths > 0) & (lengths <= most) & (available > 0)):
        n, size, part = int(min(available[i], most // lengths[i])), int(lengths[i]), 1
        while n and not reach >> budget & 1:
            part = min(part, n)
            steps.append((i, part, reach))
            reach |= (reach << size * part) & mask
            n -= part
            part *= 2
        if reach >> budget & 1:
            break
    at, above = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1, reach >> budget
    if above and (first := (above & -above).bit_length() - 1) < budget - at:
        at = budget + first
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            take[i] += part
            at -= int(lengths[i]) * part
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """Documents to take of each length, at most ``counts``, so that their words meet ``budget`` as nearly as they can."""
    counts = np.where(lengths > 0, counts, 0).astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or budget >= total:
        return counts if budget > 0 else np.zeros(len(lengths), dtype=np.int64)
    take = np.floor(counts * (budget / total)).astype(np.int64)
    left = budget - int((lengths * take).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    for i in order:  # one more of each length while the rest stays beyond the programme's reach
        size = int(lengths[i])
        if left - size >= DP_WORDS // 2 and take[i] < counts[i]:
            take[i] += 1
            left -= size
    for i in np.argsort(-lengths):  # whatever is still beyond it: largest that fits first
        if left <= DP_WORDS:
            break
        n = min(int(counts[i] - take[i]), left // max(1, int(lengths[i])))
        take[i] += n
        left -= n * int(lengths[i])
    for i in order:  # a budget too short to be met exactly is widened by giving back a few documents
        if left >= SLACK_WORDS:
            break
        if take[i] and lengths[i] <= SLACK_WORDS:
            take[i] -= 1
            left += int(lengths[i])
    more = knapsack(lengths[order], (counts - take)[order], left)
    take[order] += more
    return nearer(lengths, counts, take, budget)


def nearer(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: int) -> np.ndarray:
    """``take`` after the best single addition, removal or exchange, again and again while that brings the sum nearer to ``budget``."""
    take, left = take.copy(), budget - int((lengths * take).sum())
    while left:
        out, more = np.append(np.flatnonzero((take > 0) & (lengths > 0)), -1), np.append(np.flatnonzero((take < counts) & (lengths > 0)), -1)
        given, got = np.append(lengths, 0)[out], np.append(lengths, 0)[more]
        order = np.argsort(got, kind="stable")
        above = np.clip(np.searchsorted(got[order], left + given), 0, len(got) - 1)
        near = np.stack([above, np.maximum(above - 1, 0)])
        miss = np.abs(left + given - got[order][near])
        side, i = np.unravel_index(int(miss.argmin()), miss.shape)
        if miss[side, i] >= abs(left):
            break
        j = order[near[side, i]]
        left += int(given[i] - got[j])
        if out[i] >= 0:
            take[out[i]] -= 1
        if more[j] >= 0:
            take[more[j]] += 1
    return take


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """Each row whole as ``_row``, with _size, _source and the _hash that orders documents of one size."""
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), size.alias("_size"), F.col("source").cast("string").alias("_source"), F.xxhash64(text).alias("_text"))
    return rows.withColumn("_hash", F.xxhash64(F.lit(seed), "_id", "_size", "_text")).drop("_id", "_text")


def _plan(histogram: DataFrame, seed: int) -> DataFrame:
    """Passes and further documents to take, by source and length. A group is one source's lengths, not its rows."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_size").reset_index(drop=True)
        lengths, counts = group["_size"].to_numpy(np.int64), group["_n"].to_numpy(np.int64)
        total, budget = int((lengths * counts).sum()), round(group["_target"].iloc[0])
        # Up to one pass nothing repeats; beyond it every document may be taken twice.
        take = fit(lengths, counts if budget <= total else int(MOST_PASSES) * counts, budget, seed)
        group["_passes"], group["_take"] = take // counts, take % counts
        return group

    return histogram.groupBy("_source").applyInPandas(one, "_source string, _size long, _n long, _source_size long, _target double, _passes long, _take long")


def _same(rows: DataFrame, other: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Join on source (null equals null), size and ``more``."""
    keys = ["_source", "_size", *more]
    other = other.withColumnsRenamed({k: f"{k}_r" for k in keys})
    on = rows["_source"].eqNullSafe(other["_source_r"])
    for k in keys[1:]:
        on = on & (rows[k] == other[f"{k}_r"])
    return rows.join(other, on, how).drop(*(f"{k}_r" for k in keys))


def _cutoffs(rows: DataFrame, part: DataFrame) -> DataFrame:
    """Of each group of ``part(_source, _size, _n, _take)``, of whose _n rows _take are taken: the hash of the
    last one taken (_cutoff), the rows that have it (_tied) and those of them that are taken (_of_tied).

    Groups are counted in order-preserving ranges of their hashes of about BUCKET_ROWS rows;
    only the range that holds the cut is looked into, where rows of one hash are counted before they are ordered.
    """
    ranges = F.ceil(F.col("_n") / BUCKET_ROWS)
    rows = _same(rows.select("_source", "_size", "_hash"), part).withColumn("_range", F.floor((F.shiftright("_hash", 40) + (1 << 23)) * ranges / (1 << 24)))
    counts = rows.groupBy("_source", "_size", "_range").agg(F.count("*").alias("_rows"), F.first("_take").alias("_t"))
    group = Window.partitionBy("_source", "_size")
    rank = F.col("_t") - F.coalesce(F.sum("_rows").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = counts.withColumn("_rank", rank).where("_rank > 0 and _rank <= _rows").select("_source", "_size", "_range", "_rank")
    hashes = _same(rows, held, "_range").groupBy("_source", "_size", "_hash").agg(F.count("*").alias("_tied"), F.first("_rank").alias("_rank"))
    last = F.sum("_tied").over(group.orderBy("_hash"))
    return hashes.withColumn("_of_tied", F.col("_rank") - last + F.col("_tied")).where("_of_tied > 0 and _of_tied <= _tied").select("_source", "_size", F.col("_hash").alias("_cutoff"), "_tied", "_of_tied")


#: A plan of at most so many rows (sources times lengths) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def _mixed(rows: DataFrame, narrow: DataFrame, seed: int) -> DataFrame:
    """``rows`` (_row, _source, _size, _hash) with _source_size, _target and _times, the passes that include the row."""
    histogram = cut(narrow.groupBy("_source", "_size").agg(F.count("*").alias("_n")))
    wanted = targets(histogram.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_source_size"))).withColumnRenamed("_source", "_s")
    plan = cut(_plan(histogram.join(wanted, histogram["_source"].eqNullSafe(wanted["_s"])).drop("_s"), seed))
    full = cut(_same(plan, _cutoffs(narrow, plan.where("_take > 0 and _take < _n").select("_source", "_size", "_n", "_take")), how="left"))
    split = full.where("_of_tied < _tied")
    found = _same(rows, F.broadcast(full) if full.count() <= BROADCAST_ROWS else full)
    apart = F.coalesce((F.col("_hash") == F.col("_cutoff")) & (F.col("_of_tied") < F.col("_tied")), F.lit(False))
    more = F.when(F.col("_take") >= F.col("_n"), 1).when(F.col("_take") > 0, (F.col("_hash") <= F.col("_cutoff")).cast("int")).otherwise(0)
    times = lambda more: F.when(F.col("_size") > 0, F.col("_passes") + more).otherwise(0)
    columns = ["_row", "_source", "_size", "_source_size", "_target", "_times"]
    sure = found.where(~apart).withColumn("_times", times(more)).select(columns)
    if split.isEmpty():
        return sure
    # Equal rows at the cut, of which some are taken: ordered by numbers of their own, in a table of their own.
    tied = cut(found.where(apart).drop("_cutoff", "_tied", "_of_tied").withColumn("_hash", F.monotonically_increasing_id())).withColumn("_hash", F.xxhash64("_hash"))
    last = _cutoffs(tied, split.select("_source", "_size", F.col("_tied").alias("_n"), F.col("_of_tied").alias("_take")))
    return sure.unionByName(_same(tied, last).withColumn("_times", times((F.col("_hash") <= F.col("_cutoff")).cast("int"))).select(columns))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words, repeats counted) of every row."""
    # The texts are read once; all that follows reads the narrow table.
    rows = cut(_sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"), seed).withColumn("_row", F.struct("_row.doc_id")))
    return _mixed(rows, rows, seed).select(
        "_row.doc_id", F.col("_size").alias("size"), F.col("_source").alias("source"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    narrow = cut(_sized(docs.select("doc_id", "text", "source"), seed).drop("_row"))
    chosen = _mixed(_sized(docs, seed), narrow, seed).where("_times > 0")
    return chosen.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))).select("_row.*")
