"""Near duplicates by DartMinHash and banded joining.

A text is the set of its word 5-grams (or the multiset: an element's weight is
then its count). Every unit of an element's weight is a column in which hashed
darts arrive as a Poisson process; a text keeps the darts that land inside its
weights up to a rank set by its total weight, so it looks at about
``k (ln k + 3)`` darts however long it is. Each dart is hashed to one of ``k``
coordinates and the earliest per coordinate is the signature: two texts agree
in a coordinate with probability equal to their (weighted) Jaccard similarity.

Texts of equal words are one node. The nodes of a bucket (those that agree in a
band) are compared exactly, on their whole sets, with the bucket's leader: the
node that meets most others over all its buckets, which groups of copies have at
their centre. Classes are the connected components of links of at least
``threshold``. Where the other members of a bucket still stand in several
classes, all of its pairs of different classes are compared as well, block
against block: a task gets the sets of at most two blocks, multiplies their
incidence matrices and returns no more links than it has members. Pairs within
the bucket's largest class are left out, so a bucket costs its members times
those outside that class. So the classes are those of comparing all pairs that
share a band, and no pair but a leader's is a row of its own.

Defined results: null and empty texts (no words) are copies of one another;
texts of fewer than five words are one shingle; repeated rows and null
identifiers are rows of their own, and a class is named by its smallest
identifier (null if it has none); very long texts are read whole; an empty
table gives an empty table; extra columns are ignored by ``classes`` and
carried by ``representatives``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import bitmap, byte_table, cut, filled, map_pieces, mix, only, split_words, text_hash, translated, word_hashes
from .components import components

WORDS, THRESHOLD = 5, 0.8
#: 20 bands of 5 coordinates: a pair at 0.8 shares a band with probability 0.9996.
BANDS, BAND_ROWS = 20, 5
#: Members of a bucket and bytes of their sets that make a block.
BLOCK_ROWS, BLOCK_BYTES = 1_000, 8 << 20
#: Cells of an incidence matrix multiplied at once.
CELLS = 1 << 22
#: Bytes of texts and texts whose darts are thrown at once.
SLICE_BYTES, DART_TEXTS = 2 << 20, 500
#: Bits of the broadcast filter of candidate nodes: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26

_TABLE = byte_table("abcdefghijklmnopqrstuvwxyz0123456789")
_U = np.uint64


class Words:
    """The words of many texts: flat, with each text's number of words."""

    def __init__(self, texts: pa.Array):
        self.flat, self.rows = split_words(translated(texts, _TABLE))
        self.n = len(texts)
        self.count = np.bincount(self.rows, minlength=self.n)
        self.offsets = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int32)

    def keys(self) -> list[bytes]:
        """128 bits per text, equal where all words are."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(self.offsets), self.flat), " ")
        return [hashlib.blake2b(t.as_buffer(), digest_size=16).digest() for t in joined]

    def shingles(self, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text index, 48-bit shingle hash and count of every distinct shingle, ordered.

        At most PIECE_ROWS texts, so index and hash sort as one number.
        """
        coded = self.flat.dictionary_encode()
        word = word_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(self.flat) else np.zeros(0, _U)
        rows = self.rows
        starts = np.flatnonzero(rows[: len(rows) - words + 1] == rows[words - 1 :]) if len(rows) >= words else np.zeros(0, np.int64)
        value = np.zeros(len(starts), _U)
        for j in range(words):
            value = mix(value ^ word[starts + j])
        short = np.flatnonzero((self.count > 0) & (self.count < words))
        own = np.zeros(len(short), _U)
        for j in range(words - 1):
            has = self.count[short] > j
            own[has] = mix(own[has] ^ word[self.offsets[short[has]] + j])
        packed = np.concatenate([rows[starts], short]).astype(_U) << _U(48) | np.concatenate([value, own]) >> _U(16)
        packed.sort()
        first = np.ones(len(packed), bool)
        first[1:] = packed[1:] != packed[:-1]
        spots = np.flatnonzero(first)
        return (packed[spots] >> _U(48)).astype(np.int64), packed[spots] & _U((1 << 48) - 1), np.diff(np.append(spots, len(packed)))


def dart_signatures(at: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (n by k) and which of the n texts have any weight.

    ``weight`` may be any positive number: a column's dart lies at a hashed height, and one
    above the element's weight is not kept.
    """
    signature = np.zeros((n, k), _U)
    total = np.bincount(at, weights=weight, minlength=n)
    some = total > 0
    times, todo = 1.0, some.copy()
    while todo.any():
        use = todo[at]
        a, e, w = at[use], element[use], weight[use].astype(float)
        units = np.ceil(w).astype(np.int64)
        column = np.repeat(np.arange(len(a)), units)
        unit = np.arange(len(column)) - np.repeat(np.cumsum(units) - units, units)
        base = mix(e[column] ^ mix(unit.astype(_U)))
        limit = (times * k * (np.log(k) + 3.0) / total)[a[column]]
        arrival, owner, room = np.zeros(len(column)), a[column], w[column] - unit
        earliest, names = np.full(n * k, np.iinfo(_U).max, _U), []
        step = thrown = 0
        while len(base):
            step += 1
            dart = mix(base ^ mix(np.full(1, step, _U)))
            arrival = arrival - np.log((dart >> _U(11)).astype(float) / 2.0**53 + 2.0**-54)
            alive = arrival <= limit
            base, limit, arrival, owner, room, dart = base[alive], limit[alive], arrival[alive], owner[alive], room[alive], dart[alive]
            name = mix(dart)
            inside = (mix(name) >> _U(11)).astype(float) / 2.0**53 < room
            # Rank bits above the dart's number: the minimum is the earliest dart.
            rank = arrival[inside].astype(np.float32).view(np.uint32).astype(_U) << _U(32)
            np.minimum.at(earliest, owner[inside] * k + (name[inside] % _U(k)).astype(np.int64), rank | np.arange(thrown, thrown + int(inside.sum())).astype(_U))
            names.append(name[inside])
            thrown += len(names[-1])
        hit = earliest != np.iinfo(_U).max
        if thrown:
            signature.reshape(-1)[hit] = np.concatenate(names)[(earliest[hit] & _U(0xFFFFFFFF)).astype(np.int64)]
        full = hit.reshape(n, k).all(axis=1)
        todo &= ~full  # a coordinate without a dart: look further
        times *= 2
    return signature, some


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    out = np.broadcast_to(mix(np.arange(bands).astype(_U)), (len(signature), bands)).copy()
    for j in range(rows):
        out = mix(out ^ signature.reshape(len(signature), bands, rows)[:, :, j])
    return out.view(np.int64)


def signatures(docs: DataFrame, weighted: bool = False, words: int = WORDS, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, text_hash, key (of the text's words) and band hashes of every row."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = Words(filled(batch.column(1)))
        at, element, count = found.shingles(words)
        n, keys = batch.num_rows, found.keys()
        weight, edges = count if weighted else np.ones(len(count)), np.searchsorted(at, np.arange(0, n + DART_TEXTS, DART_TEXTS))
        parts = []
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            parts.append(dart_signatures(at[a:b] - i * DART_TEXTS, element[a:b], weight[a:b], min(DART_TEXTS, n - i * DART_TEXTS), bands * rows))
        signature, some = (np.concatenate(x) for x in zip(*parts, strict=True))
        hashes = band_hashes(signature, bands, rows)[some]
        offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
        yield pa.record_batch(
            [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.reshape(-1)))],
            names=["doc_id", "text_hash", "key", "bands"],
        )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    return map_pieces(keyed, work, "doc_id long, text_hash long, key binary, bands array<long>", limit=SLICE_BYTES)


def _bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of hashed keys, at most FILTER_BITS / 8 bytes on the driver."""
    return bitmap(keys.select((F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % FILTER_BITS).alias("s")), "s", FILTER_BITS)


def shingle_sets(docs: DataFrame, nodes: DataFrame, weighted: bool, words: int) -> DataFrame:
    """id and packed shingles (and counts) of the nodes in ``nodes(key, id)``, one row each."""
    shared = docs.sparkSession.sparkContext.broadcast(_bits(nodes))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bits, texts = shared.value, filled(batch.column(0))
        names = Words(texts).keys()
        spots = np.array([int.from_bytes(k[:4], "big") % FILTER_BITS for k in names], np.int64)
        wanted = ((bits[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).astype(bool) if len(spots) else np.zeros(0, bool)
        some, own = np.flatnonzero(wanted), {}
        at, element, count = Words(texts.take(pa.array(some))).shingles(words)
        edges = np.searchsorted(at, np.arange(len(some) + 1))
        for i, row in enumerate(some.tolist()):
            if names[row] not in own:
                part = slice(edges[i], edges[i + 1])
                own[names[row]] = (element[part].tobytes(), count[part].astype("<u4").tobytes() if weighted else b"")
        yield pa.record_batch([pa.array(list(own), pa.binary()), pa.array([v[0] for v in own.values()], pa.binary()), pa.array([v[1] for v in own.values()], pa.binary())], names=["key", "elements", "counts"])

    found = map_pieces(docs.select("text"), work, "key binary, elements binary, counts binary", limit=SLICE_BYTES)
    return found.join(nodes, "key").groupBy("id").agg(F.first("elements").alias("elements"), F.first("counts").alias("counts"))


def similarity(a: bytes, b: bytes, ca: bytes = b"", cb: bytes = b"") -> float:
    """Jaccard similarity of packed sorted sets, weighted if counts are given."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    if not ca:
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared / max(1, len(x) + len(y) - shared)
    cx, cy = np.frombuffer(ca, "<u4").astype(np.int64), np.frombuffer(cb, "<u4").astype(np.int64)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(cx[i], cy[j]).sum())
    return shared / max(1, int(cx.sum() + cy.sum()) - shared)


def _linked(edges: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The edges (u, v) whose whole sets are at least ``threshold`` similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            good = [similarity(a, b, ca, cb) >= threshold for a, b, ca, cb in zip(*columns[2:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("id").alias("u"), F.col("elements").alias("a"), F.col("counts").alias("ca"))
    other = sets.select(F.col("id").alias("v"), F.col("elements").alias("b"), F.col("counts").alias("cb"))
    return edges.join(one, "u").join(other, "v").select("u", "v", "a", "b", "ca", "cb").mapInArrow(work, "u long, v long")


def _classed(rows: DataFrame, names: DataFrame | None, key: str, out: str) -> DataFrame:
    if names is None:
        return rows.withColumn(out, F.col(key))
    named = names.select(F.col("node").alias(key), F.col("component").alias("_c"))
    return rows.join(named, key, "left").withColumn(out, F.coalesce("_c", F.col(key))).drop("_c")


def _units(elements: bytes, counts: bytes) -> np.ndarray:
    """A packed set's elements; of a multiset, one for each unit of weight, so weighted similarity is that of sets."""
    x = np.frombuffer(elements, _U)
    if not counts:
        return x
    n = np.frombuffer(counts, "<u4").astype(np.int64)
    unit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(x, n) ^ mix(unit.astype(_U)))


def block_links(one: list[np.ndarray], other: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of ``one`` (rows) and of ``other`` (columns) are at least ``threshold`` similar."""
    both = one + other
    sizes = np.array([len(x) for x in both])
    names, column, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    again = times[column] > 1  # others are in no intersection
    row, column = row[again], (np.cumsum(times > 1) - 1)[column[again]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared, step, width = np.zeros((len(one), len(other)), np.float32), max(1, CELLS // len(both)), int((times > 1).sum())
    for start in range(0, width, step):
        a, b = np.searchsorted(column, [start, start + step])
        has = np.zeros((len(both), min(step, width - start)), np.float32)
        has[row[a:b], column[a:b] - start] = 1
        shared += has[: len(one)] @ has[len(one) :].T
    union = sizes[: len(one), None] + sizes[None, len(one) :] - shared
    return (shared >= threshold * np.maximum(union, 1)) & (sizes[: len(one), None] > 0)


def _block_links(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) that join the classes of ``rest(b, id, c)`` wherever members of different classes are linked."""
    sized = cut(rest.join(sets.select("id", (F.length("elements") + F.length("counts")).alias("bytes")), "id"))
    whole = sized.groupBy("b").agg(F.mode("c").alias("most"))
    parted = sized.join(whole, "b").withColumn("major", F.col("c") == F.col("most"))
    blocks = lambda major: F.greatest(F.ceil(F.sum(F.when(major, 1)) / BLOCK_ROWS), F.ceil(F.sum(F.when(major, F.col("bytes"))) / BLOCK_BYTES)).cast("int")
    dealt = cut(parted.groupBy("b").agg(F.first("most").alias("most"), blocks(~F.col("major")).alias("others"), blocks(F.col("major")).alias("majors")))
    own = F.when(F.col("major"), F.col("others") + F.pmod(F.xxhash64("id"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others"))).cast("int")
    # A block of the largest class meets those of the others; these meet all, themselves included.
    met = F.sequence(F.lit(0), F.when(F.col("major"), F.col("others")).otherwise(F.col("others") + F.col("majors")) - 1)
    placed = sized.join(dealt, "b").withColumn("major", F.col("c") == F.col("most")).withColumn("own", own)
    placed = placed.select("b", "id", "c", "own", F.explode(met).alias("met")).select("b", "id", "c", "own", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"))

    def links(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        ids, classes, at = (table.column(x).to_numpy() for x in ("id", "c", "own"))
        packed = [_units(a, n) for a, n in zip(table.column("elements").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        here, there = np.flatnonzero(at == i), np.flatnonzero(at == j)
        u, v = [], []
        if len(here) and len(there):
            near = block_links([packed[x] for x in here], [packed[x] for x in there], threshold)
            near &= classes[here][:, None] != classes[there][None]
            # A spanning forest of the linked classes, not every link.
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent[up]
                return x

            for x, y in zip(*np.nonzero(near)):
                one, other = find(int(classes[here[x]])), find(int(classes[there[y]]))
                if one != other:
                    parent[one] = other
                    u.append(int(ids[here[x]]))
                    v.append(int(ids[there[y]]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    ship(sets.sparkSession)
    return placed.join(sets, "id").select("b", "i", "j", "id", "c", "own", "elements", "counts").groupBy("b", "i", "j").applyInArrow(links, "u long, v long")


def nodes_to_classes(docs: DataFrame, nodes: DataFrame, threshold: float, weighted: bool, words: int) -> DataFrame | None:
    """(node, component) of every node of ``nodes(id, key, bands)`` that has a link; None if there is none."""
    bands = nodes.select("id", F.explode("bands").alias("b"))
    # A table of its own: nothing but the join stands after the shuffle, so a hot bucket's rows can be split.
    shared = cut(bands.groupBy("b").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = cut(bands.join(shared, "b"))
    meets = cut(buckets.groupBy("id").agg(F.sum("n").alias("meets")))
    sets = cut(shingle_sets(docs, cut(nodes.select("id", "key").join(meets.select("id"), "id")), weighted, words))
    led = cut(buckets.join(meets, "id").groupBy("b").agg(F.max(F.struct("meets", (-F.col("id")).alias("id"))).alias("l")).select("b", (-F.col("l.id")).alias("leader")))
    members = cut(buckets.join(led, "b").where("id <> leader").select("b", "id", "leader"))
    edges = members.select(F.least("leader", "id").alias("u"), F.greatest("leader", "id").alias("v")).distinct()
    links = cut(_linked(edges, sets, threshold))
    names = None if links.isEmpty() else components(links)
    rest = _classed(members.select("b", "id"), names, "id", "c")
    unsettled = rest.groupBy("b").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("b")
    more = cut(_block_links(rest.join(unsettled, "b"), sets, threshold))
    if more.isEmpty():
        return names
    # Links between classes; a class is named by a node, so the old naming joins the new one.
    new = components(_classed(_classed(more, names, "u", "cu"), names, "v", "cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    if names is None:
        return new
    moved = new.select(F.col("node").alias("component"), F.col("component").alias("_n"))
    kept = names.join(moved, "component", "left").select("node", F.coalesce("_n", "component").alias("component"))
    return cut(kept.unionByName(new).groupBy("node").agg(F.min("component").alias("component")))


def classes(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = False, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, class_id, class_size and stays of every row; one row of a class stays."""
    signed = cut(signatures(docs, weighted, words))
    # Copies are pre-aggregated to nodes, so classes are made of different texts only.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    grouped = signed.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(grouped.withColumn("id", F.monotonically_increasing_id()))
    names = nodes_to_classes(docs, nodes, threshold, weighted, words)
    named = _classed(nodes.select("key", "id", "first", "n"), names, "id", "component")
    whole = named.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    found = cut(named.select("key", "component").join(whole, "component").drop("component"))
    out = signed.select("doc_id", "text_hash", "key").join(found, "key")
    stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.hash"))
    return out.select("doc_id", "text_hash", F.col("first.id").alias("class_id"), "class_size", stays.alias("stays"))


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all its columns."""
    keep = classes(docs, threshold).where("stays").groupBy(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash")).agg(F.count("*").alias("n"))
    return only(docs, keep)
