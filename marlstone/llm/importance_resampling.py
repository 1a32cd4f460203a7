"""Importance resampling towards a target distribution.

Features are runs of one and two words, hashed into a fixed number of buckets. The
log ratio of target to corpus frequency of every bucket is one array of that fixed
length, which scores all documents. The sample is the highest scores with Gumbel
noise (a draw without replacement). The last score drawn is found exactly by radix
selection: counts by one digit of the composite key (score, doc_id, row) at a time,
so that a round sends one row per digit value to the driver, whatever the input.
Only the rows up to that key are then sorted by range and ranked.

Defined results: null and empty texts have no features, weight 0 and too few words
to be drawn; a null identifier is noised as empty text and comes last among equal
scores; repeated rows are told apart by their place, so as many are drawn as the
sample holds; fewer eligible documents than a draw needs, or an empty table, draw
what there is; an empty target leaves gains by the corpus alone; extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_table, cut, filled, map_pieces, split_words, translated

BUCKETS = 10_000
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
#: Share of the eligible documents that is drawn.
PERCENT = 25
SEED = 7
#: Bits of a digit of the selection: a round counts at most 2^12 values.
DIGIT_BITS = 12

_TABLE = byte_table("0123456789abcdefghijklmnopqrstuvwxyz")
_SIGN = -(1 << 63)
_CRC = 0xEDB88320


@cache
def _shifts(length: int) -> np.ndarray:
    """Four tables of 256 numbers whose xor moves a crc32 past ``length`` further bytes (its linear part)."""
    if length == 0:
        steps = [np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)]
        return np.stack(steps)
    table = _byte_steps()
    out = _shifts(length - 1)
    return (out >> np.uint32(8)) ^ table[out & np.uint32(255)]


@cache
def _byte_steps() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(_CRC), table >> np.uint32(1))
    return table


def _shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each crc32 moved past so many bytes."""
    out = np.empty_like(crcs)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        some = crcs[at]
        if length > 64:  # long words are few; zeros alone leave what the crc's own start adds
            zeros = bytes(int(length))
            out[at] = np.array([zlib.crc32(zeros, int(c)) for c in some], np.uint32) ^ np.uint32(zlib.crc32(zeros))
            continue
        t = _shifts(int(length))
        out[at] = t[0][some & np.uint32(255)] ^ t[1][(some >> np.uint32(8)) & np.uint32(255)] ^ t[2][(some >> np.uint32(16)) & np.uint32(255)] ^ t[3][some >> np.uint32(24)]
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every feature, and each row's number of words.

    The crc32 of a pair of words is put together from those of its words, which are
    computed once per distinct word.
    """
    words, rows = split_words(translated(filled(texts, lower=True), _TABLE))
    n_words = np.bincount(rows, minlength=len(texts))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    coded = words.dictionary_encode()
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    crc = np.array([zlib.crc32(w) for w in distinct], np.uint32)
    spaced = np.array([zlib.crc32(b" ", int(c)) for c in crc], np.uint32)
    length = np.array([len(w) for w in distinct], np.int64)
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    left, right = codes[pair], codes[pair + 1]
    pairs = _shifted(spaced[left], length[right]) ^ crc[right]
    every = np.concatenate([crc[codes], pairs]).astype(np.int64) % buckets
    return every, np.concatenate([rows, rows[pair]]), n_words


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; one row per bucket reaches the driver."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = np.bincount(features(batch.column(0), buckets)[0], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_pieces(docs.select("text"), work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of target to corpus frequency by bucket, in thousandths, floored."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda b, a: (float(b + 1) * float(s + n)) / (float(a + 1) * float(t + n))
    return np.array([math.floor(1000 * math.log(ratio(int(b), int(a)))) for a, b in zip(corpus, target, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, n_words and weight of every document: the floored mean gain of its features."""
    buckets = len(gain)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every, rows, n_words = features(batch.column(1), buckets)
        n = np.bincount(rows, minlength=batch.num_rows)
        total = np.bincount(rows, gain[every], batch.num_rows).astype(np.int64)  # whole numbers far below 2^53
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(n_words.astype(np.int64)), pa.array(weight)], names=["doc_id", "n_features", "n_words", "weight"])

    return map_pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_features long, n_words long, weight long")


def noise(seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, floored; by its identifier alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _unsigned(column: str) -> Column:
    """A long as the same bits in unsigned order, seen as digits from above."""
    return F.col(column).bitwiseXOR(F.lit(_SIGN))


def kth_key(rows: DataFrame, columns: list[str], k: int) -> tuple[int, ...]:
    """The ``k``-th smallest (from 1) of the rows' keys, compared column by column; all long, without nulls.

    Each round counts the rows that share the digits found so far by their next digit.
    """
    found: list[int] = []
    same: list[Column] = []
    for column in columns:
        digits = _unsigned(column)
        group = rows.where(reduce(Column.__and__, same, F.lit(True)))
        low, high = group.agg(F.min(column), F.max(column)).first()
        low, high = low - _SIGN, high - _SIGN  # unsigned
        bits = (low ^ high).bit_length()
        prefix = low >> bits
        while bits:
            width = min(DIGIT_BITS, bits)
            inside = group if prefix == low >> bits and prefix == high >> bits else group.where(F.shiftrightunsigned(digits, bits) == prefix)
            bits -= width
            counts = inside.groupBy(F.shiftrightunsigned(digits, bits).bitwiseAND(F.lit((1 << width) - 1)).alias("digit")).count().collect()
            for r in sorted(counts, key=lambda r: r["digit"]):
                if k <= r["count"]:
                    prefix = prefix << width | r["digit"]
                    break
                k -= r["count"]
        found.append(prefix + _SIGN)
        same.append(F.col(column) == found[-1])
    return tuple(found)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 1 in ``order``: sorted by ranges, each numbered from what the ranges before it hold."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())  # one row per range
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", place).drop("part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document; ``target`` has texts."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + noise(seed))
    keys = {"_score": -F.col("score"), "_id": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "_row": F.monotonically_increasing_id()}
    scored = cut(scored.withColumns(keys))  # narrow, computed once: all that follows sees the same rows
    order = list(keys)
    eligible = scored.where(F.col("n_words") >= least_words)
    k = percent * eligible.count() // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*out)
    last = kth_key(eligible, order, k)
    drawn = F.lit(False)
    for column, value in reversed(list(zip(order, last, strict=True))):
        drawn = (F.col(column) < value) | ((F.col(column) == value) & (drawn if column != order[-1] else F.lit(True)))
    drawn = (F.col("n_words") >= least_words) & drawn
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(drawn), order).select(*out).unionByName(rest.select(*out))
