"""Hard-negative mining by a Voronoi-partitioned nearest-neighbour join.

Rows become vectors of whole numbers, and one more coordinate makes all norms equal,
so that the largest inner products with an anchor are its nearest rows. A fixed number
of pivots divides the space into cells.

Positives: for every cell and label the rows nearest to the pivot are known, which
bounds how far the last positive of any anchor of a cell and label can be; a row goes
only to the cells that it might serve by that bound and the triangle inequality.
Negatives: an anchor's positives bound the scores that matter from both sides; anchors
of a cell with like bounds form a group, and a row goes only to groups whose ring it
might lie in. Inside a group rows are scored exactly, in whole numbers.

Groups are cut into blocks of anchors and chunks of rows of bounded size, so no task
follows a hot label or cell; what each keeps is merged by a limited window.

Defined results: rows with a null label or vector, or a null or non-finite component
take no part; shorter vectors count as padded with zeros; rows are told apart by their
place, so of repeated rows each is another's positive; null identifiers come last
among ties; anchors without positives, positives without negatives, negative
positive scores and empty tables give no rows; extra columns are ignored. Scores
beyond 2^53 are computed exactly too, slowly; those beyond a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut

POSITIVES = 5
NEGATIVES = 5
#: A negative scores between these shares (in hundredths) of the positive's score.
LOW, HIGH = 80, 100
#: Cells, and the rows that their pivots are learned from. Any pivots give the same result.
PIVOTS = 16
SAMPLE_ROWS = 2_048
#: Anchors with like radii share a group: so many classes of radii in each cell.
RINGS = 8
#: Anchors of a block and rows of a chunk, about.
BLOCK_ROWS = 4_096
CHUNK_ROWS = 16_384
#: Anchors of a block that are scored at once.
SCORED_ROWS = 256

_LAST = (1 << 63) - 1
_ROWS = "row long, vec_id long, label long, cell int, dist double, norm double, q binary"


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and v of the rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("label").isNotNull() & v.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as floor(256 x), padded with zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    lengths = np.diff(offsets)
    values = np.floor(256 * values)
    if len(lengths) and (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


def packed(m: np.ndarray, kind: str) -> pa.Array:
    """Rows of a matrix as byte strings."""
    data = np.ascontiguousarray(m.astype(kind))
    width = data.dtype.itemsize * data.shape[1]
    offsets = np.arange(len(m) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def unpacked(column: pa.ChunkedArray | pa.Array, kind: str, dim: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), dim).astype(np.float64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles while these are, else in Python's numbers."""
    most = max((float(np.abs(m).max()) if m.size else 0.0) for m in (a, b))
    if most * most * max(a.shape[1], 1) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    exact = whole(a) @ whole(b).T
    return np.array([[max(-_LAST - 1, min(_LAST, x)) for x in r] for r in exact], np.int64).reshape(len(a), len(b))


class Cells:
    """Pivots in the space with the added coordinate, and what distances need."""

    def __init__(self, pivots: np.ndarray, top: float, dim: int, kind: str):
        self.pivots, self.top, self.dim, self.kind = pivots, top, dim, kind
        #: More than rounding of any squared distance can be.
        self.slack = 1e-6 * (1 + top**0.5)

    def distances(self, v: np.ndarray, extra: bool = True) -> np.ndarray:
        """From each row (``extra``: with its added coordinate; anchors have none) to each pivot."""
        norm = (v * v).sum(1)
        last = np.sqrt(np.maximum(self.top - norm, 0)) if extra else np.zeros(len(v))
        p, tail = self.pivots[:, :-1], self.pivots[:, -1]
        square = norm[:, None] - 2 * v @ p.T + (p * p).sum(1) + (last[:, None] - tail) ** 2
        return np.sqrt(np.maximum(square, 0))

    def between(self) -> np.ndarray:
        gap = self.pivots[:, None, :] - self.pivots[None, :, :]
        return np.sqrt((gap * gap).sum(2))


def learned(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE_ROWS) -> Cells | None:
    """Pivots from a bounded sample by the identifiers' hashes: spread out first, then moved to their cells' means."""
    ship(rows.sparkSession)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(b.column(0).offsets.to_numpy())
            v = matrix(b.column(0), int(lengths.max(initial=1)))
            most = [[float(lengths.max(initial=0))], [float((v * v).sum(1).max(initial=0))], [float(np.abs(v).max(initial=0))]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in most], names=["dim", "top", "most"])

    shape = rows.select("v").mapInArrow(shapes, "dim double, top double, most double").agg(*(F.max(c).alias(c) for c in ("dim", "top", "most"))).first()
    if shape["dim"] is None:
        return None
    dim, top = max(1, int(shape["dim"])), shape["top"]
    some = rows.orderBy(F.xxhash64("vec_id", "v")).limit(sample).select("v").toArrow().column("v").combine_chunks()
    v = matrix(some, dim)
    v = np.hstack([v, np.sqrt(np.maximum(top - (v * v).sum(1), 0))[:, None]])
    seeds = [0]
    far = ((v - v[0]) ** 2).sum(1)
    while len(seeds) < min(pivots, len(v)) and far.max() > 0:
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((v - v[seeds[-1]]) ** 2).sum(1))
    centres = v[seeds]
    for _ in range(8):
        own = ((v * v).sum(1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(1)).argmin(1)
        centres = np.array([v[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return Cells(centres, top, dim, "<i2" if shape["most"] < 2**15 - 1 else "<f8")


def assigned(rows: DataFrame, cells: Cells) -> DataFrame:
    """Every row with its number, nearest pivot, distance to it and packed vector."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(3), cells.dim)
            d = cells.distances(v)
            cell = d.argmin(1).astype(np.int32)
            near = d[np.arange(len(v)), cell]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell), pa.array(near), pa.array((v * v).sum(1)), packed(v, cells.kind)], names=["row", "vec_id", "label", "cell", "dist", "norm", "q"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v")
    return numbered.mapInArrow(run, _ROWS)


def anchored(anchors: DataFrame, cells: Cells) -> DataFrame:
    """Anchors by the cell nearest to them without the added coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = cells.distances(unpacked(b.column("q"), cells.kind, cells.dim), extra=False)
            cell = d.argmin(1).astype(np.int32)
            near = d[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("label"), pa.array(cell), pa.array(near), b.column("norm"), b.column("q")], names=["row", "vec_id", "label", "cell", "dist", "norm", "q"])

    return anchors.mapInArrow(run, _ROWS)


def _top(rows: DataFrame, by: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    """The first ``n`` of each group, numbered; Spark keeps only so many of a task before it shuffles."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def _positive_bounds(rows: DataFrame, anchors: DataFrame, cells: Cells, n: int) -> DataFrame:
    """label and the bounds of its anchors: by cell, how far from that pivot a positive can be.

    The n+1 rows of a label that must be nearest (the anchor itself is one) are among the
    n+1 nearest to each pivot, so their farthest bound holds the last positive.
    """
    near = _top(rows.select("label", "cell", "dist"), ["label", "cell"], [F.col("dist")], n + 1, "_n").select("label", F.col("cell").alias("_c"), F.col("dist").alias("_d"))
    own = anchors.groupBy("label", "cell").agg(F.max("dist").alias("reach"))
    gap = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in cells.between()))
    bound = F.element_at(F.element_at(gap, F.col("cell") + 1), F.col("_c") + 1) + F.col("_d")
    # At most n+1 rows of every cell for each label and cell.
    last = own.join(near, "label").groupBy("label", "cell", "reach").agg(F.sort_array(F.collect_list(bound)).alias("bounds"))
    theta = F.when(F.size("bounds") > n, F.get("bounds", F.lit(n)) + 2 * F.col("reach")).otherwise(F.lit(float("inf")))
    return last.select("label", "cell", theta.alias("far")).groupBy("label").agg(F.collect_list(F.struct(F.col("cell").alias("key"), "far")).alias("groups"))


_SENT = "key int, row long, vec_id long, label long, q binary"


def _sent(rows: DataFrame, cells: Cells, wanted: list[tuple[int, int, float, float]] | None) -> DataFrame:
    """Rows, once for each group they might serve: ``wanted`` as (group, cell, nearest, farthest), else each row's own ``groups``."""
    slack = cells.slack
    if wanted is not None:
        keys, at, near, far = (np.array(x) for x in zip(*wanted, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = cells.distances(unpacked(b.column("q"), cells.kind, cells.dim))
            if wanted is not None:
                row, g = np.nonzero((d[:, at] <= far + slack) & (d[:, at] >= near - slack))
                key = keys[g]
            else:
                groups = b.column("groups")
                row = pc.list_parent_indices(groups).to_numpy(zero_copy_only=False)
                flat = pc.list_flatten(groups)
                key, reach = flat.field("key").to_numpy(zero_copy_only=False), flat.field("far").to_numpy(zero_copy_only=False)
                fits = d[row, key] <= reach + slack
                row, key = row[fits], key[fits]
            order = pa.array(row)
            for start in range(0, len(row), CHUNK_ROWS):
                some = order.slice(start, CHUNK_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(key[start : start + CHUNK_ROWS].astype(np.int32)), *(b.column(c).take(some) for c in ("row", "vec_id", "label", "q"))], names=["key", "row", "vec_id", "label", "q"])

    return rows.mapInArrow(run, _SENT)


def _joined(sent: DataFrame, anchors: DataFrame, work, schema: str) -> DataFrame:
    """``work(anchors, rows)`` for every block of a group's anchors and chunk of the rows sent to it.

    Numbers of blocks and chunks follow the groups' sizes, one row per group.
    """
    spark = sent.sparkSession
    sizes = sent.groupBy("key").count().withColumnRenamed("count", "n_rows").join(anchors.groupBy("key").count().withColumnRenamed("count", "n_anchors"), "key").collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    plan = F.broadcast(spark.createDataFrame([(r["key"], -(-r["n_rows"] // CHUNK_ROWS), -(-r["n_anchors"] // BLOCK_ROWS)) for r in sizes], "key int, chunks int, blocks int"))
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(plan, "key").withColumn("block", part("blocks")).withColumn("chunk", every("chunks")).drop("chunks", "blocks")
    right = sent.join(plan, "key").withColumn("chunk", part("chunks")).withColumn("block", every("blocks")).drop("chunks", "blocks")
    names = [*sent.columns, "chunk", "block"]
    return left.groupBy("key", "block", "chunk").cogroup(right.select(*names).groupBy("key", "block", "chunk")).applyInArrow(work, schema)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, _LAST).to_numpy()


def _positives_of(cells: Cells, n: int):
    def work(a: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if a.num_rows and c.num_rows:
            mine, theirs = a.column("label").to_numpy(), c.column("label").to_numpy()
            va, vc = unpacked(a.column("q"), cells.kind, cells.dim), unpacked(c.column("q"), cells.kind, cells.dim)
            rows_a, rows_c, ids = a.column("row").to_numpy(), c.column("row").to_numpy(), _ids(c.column("vec_id"))
            for label in np.intersect1d(mine, theirs):
                at, to = np.flatnonzero(mine == label), np.flatnonzero(theirs == label)
                for start in range(0, len(at), SCORED_ROWS):
                    some = at[start : start + SCORED_ROWS]
                    for i, row in zip(some, scores(va[some], vc[to]), strict=True):
                        use = np.flatnonzero(rows_c[to] != rows_a[i])
                        if len(use) > n:  # ties at the cut all stay
                            edge = np.partition(row[use], len(use) - n)[len(use) - n]
                            use = use[row[use] >= edge]
                        best = use[np.lexsort((rows_c[to[use]], ids[to[use]], -row[use]))[:n]]
                        out.append((np.full(len(best), rows_a[i]), row[best], rows_c[to[best]], ids[to[best]]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("anchor", "score", "other", "other_id"), columns, strict=True)))

    return work


def _negatives_of(cells: Cells, n: int, low: int, high: int):
    def work(a: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if a.num_rows and c.num_rows:
            mine, theirs = a.column("label").to_numpy(), c.column("label").to_numpy()
            va, vc = unpacked(a.column("q"), cells.kind, cells.dim), unpacked(c.column("q"), cells.kind, cells.dim)
            rows_c, ids = c.column("row").to_numpy(), _ids(c.column("vec_id"))
            wanted = a.column("positives").to_pylist()
            for start in range(0, len(va), SCORED_ROWS):
                s = scores(va[start : start + SCORED_ROWS], vc)
                for i, row in enumerate(s, start):
                    marks = [p["score"] for p in wanted[i]]
                    use = np.flatnonzero((row >= -(-low * min(marks) // 100)) & (row <= high * max(marks) // 100) & (theirs != mine[i]))
                    use = use[np.lexsort((rows_c[use], ids[use], -row[use]))]
                    found = row[use]
                    for k, p in enumerate(marks):
                        first = int(np.searchsorted(-found, -(high * p // 100), "left"))
                        some = use[first : first + n]
                        some = some[row[some] >= -(-low * p // 100)]
                        if len(some):
                            out.append((np.full(len(some), a.column("row")[i].as_py()), np.full(len(some), k), row[some], rows_c[some], ids[some]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(("anchor", "k", "score", "other", "other_id"), columns, strict=True)))

    return work


def _best() -> list[Column]:
    return [F.col("score").desc(), F.col("other_id"), F.col("other")]


def _named(column: str) -> Column:
    return F.when(F.col(column) != _LAST, F.col(column))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows(vec_id, label, v)`` as :func:`usable` gives them; ``is_anchor`` is a condition on
    ``vec_id`` and ``label``. Of every anchor's ``positives`` nearest rows with its label each
    gets the ``negatives`` nearest with other labels that score from ``low`` to ``high`` hundredths of it.
    """
    spark = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    cells = learned(rows, pivots)
    if cells is None:
        return spark.createDataFrame([], result)
    rows = cut(assigned(rows, cells))
    anchors = cut(anchored(rows.where(is_anchor), cells))

    bounds = _positive_bounds(rows, anchors, cells, positives)
    sent = _sent(rows.join(bounds, "label"), cells, None)
    found = _joined(sent, anchors.withColumn("key", F.col("cell")), _positives_of(cells, positives), "anchor long, score long, other long, other_id long")
    best = _top(found, ["anchor"], _best(), positives, "k")
    lists = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("k", "score", "other", "other_id"))).alias("positives"))
    taught = cut(anchors.join(lists.withColumnRenamed("anchor", "row"), "row"))

    # A negative's distance lies between those that the scores at its ends have; scores below zero have no negatives.
    asked = taught.withColumn("positives", F.filter("positives", lambda p: p["score"] >= 0)).where(F.size("positives") > 0)
    value = F.transform("positives", lambda p: p["score"].cast("double"))
    away = lambda share, score: F.sqrt(F.greatest(F.lit(0.0), F.lit(cells.top) + F.col("norm") - 2 * share / 100 * score))
    asked = asked.withColumns({"far": away(low, F.array_min(value)), "near": away(high, F.array_max(value))})
    widest = 2 * cells.top**0.5 + 1
    asked = cut(asked.withColumn("key", F.col("cell") * RINGS + F.least(F.lit(RINGS - 1), F.floor(F.col("far") / widest * RINGS)).cast("int")))
    # One row per cell and ring, whatever the input.
    rings = asked.groupBy("key").agg(F.max(F.col("far") + F.col("dist")).alias("far"), F.min(F.col("near") - F.col("dist")).alias("near")).collect()
    if not rings:
        return spark.createDataFrame([], result)
    sent = _sent(rows, cells, [(r["key"], r["key"] // RINGS, r["near"], r["far"]) for r in rings])
    found = _joined(sent, asked.select("key", "row", "label", "q", "positives"), _negatives_of(cells, negatives, low, high), "anchor long, k long, score long, other long, other_id long")
    best = _top(found, ["anchor", "k"], _best(), negatives, "rank").withColumnRenamed("score", "negative_score")
    named = best.join(asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "positives"), "anchor")
    positive = F.get("positives", F.col("k").cast("int"))
    return named.select("anchor_id", positive["other_id"].alias("_p"), "rank", "other_id", positive["score"].alias("positive_score"), "negative_score").select(
        "anchor_id", _named("_p").alias("positive_id"), F.col("rank").cast("int").alias("rank"), _named("other_id").alias("negative_id"), "positive_score", "negative_score"
    )
