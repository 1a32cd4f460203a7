"""Best-fit packing with bound-certified repacking.

Pieces are dealt to partitions of bounded size and packed by best-fit
decreasing. Dual-feasible-function lower bounds certify a partition whose
number of bins cannot be beaten. Partitions with a gap exchange the documents
of their unfilled bins: whole bins meet those of other such partitions and are
packed anew by best-fit decreasing, on all items and on orders that leave the
largest items to themselves; the result is taken only where it needs fewer
bins. Rounds go on until
one saves next to nothing (``WORTH``). Every row tells the gap that
its partition was left with: 0 means that no packing of it has fewer bins.

Defined results: a null text counts as empty and is a document of one end
token; texts longer than a sequence are cut, everything else stays whole;
repeated rows are documents of their own, dealt by their place in the input;
null identifiers pass through; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filled, map_pieces
from .tokens import encoder

CAPACITY, END = 2048, 0
#: Pieces packed in one task.
PART_PIECES = 20_000
#: Places at which a dual-feasible function or an order of packing may bend, and lengths by which it may be lowered.
BENDS, LOWERED = 16, 12
#: A round that saves fewer bins than this share of the pieces it leaves open is the last one.
WORTH = 1e-5

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of at most ``capacity`` ids, end token included."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, counts = encoder(tokenizer_path).encode(filled(batch.column(1)))
        raw, end = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B"), END.to_bytes(4, "little")
        n = counts + 1
        per_doc = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), per_doc)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        start = piece * capacity
        length = np.minimum(n[row] - start, capacity)
        base = (np.cumsum(counts) - counts)[row] + start
        last = start + length == n[row]
        crcs = np.empty(len(row), np.int64)
        for i, (b, k, whole) in enumerate(zip(base.tolist(), length.tolist(), last.tolist(), strict=True)):
            crc = zlib.crc32(raw[4 * b : 4 * (b + k - whole)])
            crcs[i] = zlib.crc32(end, crc) if whole else crc
        yield pa.record_batch(
            [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs)],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return map_pieces(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins. Open bins are kept by room left."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, own, n = capacity, n, n + 1
        bins[i], offsets[i] = own, capacity - room
        rooms[room - size].append(own)
        if room > size:
            mask |= 1 << room - size
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, as dual-feasible functions of the lengths' histogram show."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    above, mass = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    for low in np.flatnonzero(count[: capacity // 2 + 1]):  # large items count whole, those under ``low`` not at all
        whole = int(above[capacity - low + 1]) if low else 0
        middle = int(mass[capacity - low] - (mass[low - 1] if low else 0))
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 100):  # rounding: x stays where (k + 1) x is whole, else floor((k + 1) x) / k
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, capacity * (scaled // capacity))
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def certified_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A lower bound by piecewise linear functions of the lengths, made dual feasible by what a bin can hold at most.

    A function is ``max(0, min(s, bend) - lowered)`` for a length ``s``. Dynamic programming over the
    bin's room finds the most that lengths in one bin add up to under each of them; divided by that, no
    bin exceeds 1, so the sum over all items is a number of bins that any packing needs.
    """
    sizes, count = np.unique(lengths, return_counts=True)
    if not len(sizes):
        return 0
    bends = np.unique(np.quantile(sizes, np.linspace(0, 1, BENDS), method="nearest"))
    lowered = np.unique(np.linspace(0, min(int(sizes[0]), capacity), LOWERED, endpoint=False).astype(np.int64))
    bend, low = (x.reshape(-1) for x in np.meshgrid(bends, lowered))
    value = np.maximum(0, np.minimum(sizes[:, None], bend) - low)
    best = np.zeros((capacity + 1, len(bend)), np.int64)
    for room in range(int(sizes[0]), capacity + 1):
        fits = int(np.searchsorted(sizes, room, side="right"))
        best[room] = np.maximum(best[room - 1], (best[room - sizes[:fits]] + value[:fits]).max(0))
    most = best[capacity]
    return int(np.max(-(-(count @ value) // np.maximum(most, 1)), initial=0, where=most > 0))


def completed(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of every item: the largest item left opens a bin, and the one or two items that fill it best complete it,
    then best fit as long as anything fits."""
    bins, left = np.empty(len(lengths), np.int64), [[] for _ in range(capacity + 1)]
    for i in np.argsort(lengths, kind="stable").tolist():
        left[lengths[i]].append(i)
    mask, n = sum(1 << s for s, own in enumerate(left) if own), 0

    def take(size: int) -> None:
        nonlocal mask
        bins[left[size].pop()] = n
        if not left[size]:
            mask ^= 1 << size

    while mask:
        room = capacity - (mask.bit_length() - 1)
        take(capacity - room)
        while (one := (mask & ((1 << room + 1) - 1)).bit_length() - 1) > 0:
            best, pair, a = one, (one,), one
            # Pairs a >= b of the lengths left, from the largest a down, while they can beat the best sum.
            while best < room and a > 0 and 2 * a > best:
                b = (mask & ((1 << min(room - a, a) + 1) - 1)).bit_length() - 1
                if b == a and len(left[a]) < 2:
                    b = (mask & ((1 << a) - 1) & ((1 << room - a + 1) - 1)).bit_length() - 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = (mask & ((1 << a) - 1)).bit_length() - 1
            for size in pair:
                take(size)
            room -= best
        n += 1
    return bins


def repacked(lengths: np.ndarray, bound: int, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of every item: the best of best-fit decreasing and of orders that first pack some of the largest items by
    themselves and complete bins with the rest; stops at ``bound``."""
    best, _, n = best_fit_decreasing(lengths, capacity)
    order = np.argsort(-lengths, kind="stable")
    for share in np.arange(BENDS) / BENDS:
        if n <= bound:
            break
        large, rest = np.split(order, [int(share * len(order))])
        bins = np.empty(len(lengths), np.int64)
        bins[large], _, used = best_fit_decreasing(lengths[large], capacity)
        bins[rest] = used + completed(lengths[rest], capacity)
        if bins.max() + 1 < n:
            best, n = bins, int(bins.max()) + 1
    return best


def offsets_in(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each item starts in its bin, gapless."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    first = np.flatnonzero(np.append(True, bins[order][1:] != bins[order][:-1])) if len(order) else np.zeros(0, np.int64)
    out = np.empty(len(lengths), np.int64)
    out[order] = starts - np.repeat(starts[first], np.diff(np.append(first, len(order))))
    return out


_PACKED = PIECES + ", sequence_id long, offset long, unfilled boolean, gap long, saved long"


def _pack(pieces: DataFrame, n_parts: int, first_part: int, capacity: int, again: bool) -> DataFrame:
    """Packs each partition; ``again`` only where that needs fewer bins than before."""

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy(np.int64)
        bound = lower_bound(lengths, capacity)
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        saved = 0
        if n > bound:
            bound = max(bound, certified_bound(lengths, capacity))
        if again:
            before, names = pd.factorize(group["sequence_id"])
            if n > bound:
                bins = repacked(lengths, bound, capacity)
                offsets, n = offsets_in(bins, lengths), int(bins.max()) + 1
            saved = len(names) - n
        if again and saved <= 0:
            bins, offsets, n, saved = before, group["offset"].to_numpy(np.int64), len(names), 0
            ids = group["sequence_id"].to_numpy(np.int64)
        else:
            ids = (first_part + int(key[0]) << 24) + bins
        fill = np.bincount(bins, weights=lengths)
        return group[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=ids, offset=offsets, unfilled=fill[bins] < capacity, gap=n - bound, saved=np.where(np.arange(len(bins)) == 0, saved, 0))

    return pieces.withColumn("_part", F.pmod(F.col("_deal"), F.lit(n_parts))).drop("_deal").groupBy("_part").applyInPandas(one, _PACKED)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """One row per piece with its sequence and place; sequences hold at most ``capacity`` tokens.

    ``gap`` says by how many bins the partition that packed the piece exceeds its lower bound.
    """
    return packed(cut_pieces(docs, tokenizer_path, capacity), capacity, part_pieces)


def packed(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """Packs ready pieces (the columns of PIECES), as ``pack`` does."""
    # Numbered before they are written, so equal rows are dealt to different partitions.
    pieces = cut(pieces.withColumn("_deal", F.xxhash64(F.monotonically_increasing_id())))
    left, first_part, done, again = pieces.count(), 0, [], False
    rows = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    while True:
        n_parts = max(1, -(-left // part_pieces))
        rows = cut(_pack(rows, n_parts, first_part, capacity, again))
        first_part += n_parts
        moving = F.col("unfilled") & (F.col("gap") > 0)
        state = rows.agg(F.count(F.when(moving, 1)).alias("left"), F.sum("saved").alias("saved")).collect()[0]
        left = state["left"]
        if not left or (again and state["saved"] < max(1, WORTH * left)):
            break
        done.append(rows.where(~moving))
        # Unfilled bins of partitions with a gap travel whole, so a bad round can be refused.
        rows = rows.where(moving).withColumn("_deal", F.xxhash64("sequence_id", F.lit(first_part)))
        again = True
    for part in done:
        rows = rows.unionByName(part)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")
