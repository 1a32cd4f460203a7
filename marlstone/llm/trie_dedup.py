"""Exact duplicates by Patricia-trie owners.

Distinct texts of a map batch travel once to the partition of their length and
content hash. There, full byte strings are inserted into one compressed radix
trie per partition; a terminal node stands for one distinct text and holds its
owner (the identifier that stays) and its number of rows, so two texts share a
class where all their bytes agree. A trie over its budget spills whole
subtrees: their terminals leave with their texts, a mark stays in their place,
and every later text below the mark is handed on as well. What was handed on is
dealt to more partitions and goes through tries of its own, until nothing is
left; so each text ends in one terminal, which names its class. Rows find that
terminal by length and SHA-256, the digest that the result reports.

Defined results: null counts as empty; texts are equal when identical after
lower-casing A-Z; rows repeated with one identifier and text are all marked as
kept in the report, and ``deduplicated`` leaves one of them; null identifiers
own a class only if it has no other; extra columns are carried by
``deduplicated`` and ignored otherwise; an empty table gives an empty table; a
text longer than the budget is a trie of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import PIECE_BYTES, cut, filled, map_pieces, only, text_hash

#: Bytes of labels and nodes a trie may hold before it spills subtrees, and what a node takes besides its label
#: (its slots, the label's header, its share of its parent's dictionary; measured).
TRIE_BYTES, NODE_BYTES = 48 << 20, 320
DIGEST = "size long, sha string"


class Node:
    """A trie node: the label of the edge into it, children by first byte, and the terminal's (owner, rows).

    A node that is ``gone`` marks a spilled subtree: one byte of its label is left, all texts below it are elsewhere.
    """

    __slots__ = ("label", "children", "owner", "rows", "gone")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.rows, self.gone = label, None, None, 0, False


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


Terminal = tuple[bytes, int | None, int]


class Patricia:
    """Compressed radix trie over byte strings; ``largest`` says which identifier owns a string."""

    def __init__(self, largest: bool):
        self.root, self.largest, self.bytes, self.nodes = Node(b""), largest, 0, 0

    @property
    def memory(self) -> int:
        """Bytes that labels and nodes take."""
        return self.bytes + NODE_BYTES * self.nodes

    def better(self, a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if self.largest else min(a, b)

    def insert(self, key: bytes, owner: int | None, rows: int) -> bool:
        """Adds ``rows`` rows of ``key``; False if its subtree is spilled, where nothing changes."""
        node, rest = self.root, key
        while rest:
            child = node.children.get(rest[0]) if node.children else None
            if child is None:
                child = Node(rest)
                self.bytes += len(rest)
                self.nodes += 1
                node.children = node.children or {}
                node.children[rest[0]] = child
                node, rest = child, b""
                break
            if child.gone:
                return False
            n = _common(child.label, rest)
            if n < len(child.label):
                middle = Node(child.label[:n])
                self.nodes += 1
                child.label = child.label[n:]
                middle.children = {child.label[0]: child}
                node.children[rest[0]] = middle
                child = middle
            node, rest = child, rest[n:]
        node.owner = self.better(node.owner, owner) if node.rows else owner
        node.rows += rows
        return True

    def drain(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[Terminal]:
        """Terminals below ``node``, which leaves the trie."""
        stack = [(node or self.root, prefix)]
        while stack:
            at, before = stack.pop()
            key = before + at.label
            if not at.gone:
                self.bytes -= len(at.label)
                self.nodes -= at is not self.root
            if at.rows:
                yield key, at.owner, at.rows
            stack.extend((child, key) for child in (at.children or {}).values())
            at.children, at.rows, at.owner = None, 0, None

    @staticmethod
    def held(node: Node) -> int:
        """Bytes of ``node`` and all below it."""
        total, stack = 0, [node]
        while stack:
            at = stack.pop()
            total += 0 if at.gone else len(at.label) + NODE_BYTES
            stack.extend((at.children or {}).values())
        return total

    def spill(self, limit: int) -> Iterator[Terminal]:
        """Drains the largest subtrees of the first branching until at most ``limit`` bytes of memory are held,
        leaving a mark for each. A trie of a single text keeps it, however long."""
        node, prefix = self.root, b""
        while len(live := [c for c in (node.children or {}).values() if not c.gone]) == 1 and not node.rows:
            node, prefix = live[0], prefix + live[0].label
        live.sort(key=self.held, reverse=True)
        for child in live if node.rows else live[:-1]:  # something stays, so every trie settles a text
            if self.memory <= limit:
                return
            first = child.label[:1]
            yield from self.drain(child, prefix)
            child.label, child.gone = first, True


def _texts(docs: DataFrame, largest: bool) -> DataFrame:
    """Distinct normalised texts of each batch with their owner and number of rows."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        better = Patricia(largest).better
        local: dict[bytes, list] = {}
        ids = batch.column(0).to_pylist()
        for key, text in zip(ids, filled(batch.column(1), lower=True).cast(pa.binary()).to_pylist(), strict=True):
            found = local.get(text)
            if found is None:
                local[text] = [key, 1]
            else:
                found[0] = better(found[0], key)
                found[1] += 1
        yield pa.record_batch(
            [
                pa.array([len(t) for t in local], pa.int64()),
                pa.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in local], pa.int64()),
                pa.array(list(local), pa.binary()),
                pa.array([v[0] for v in local.values()], pa.int64()),
                pa.array([v[1] for v in local.values()], pa.int64()),
            ],
            names=["size", "hash", "text", "owner", "rows"],
        )

    return map_pieces(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, "size long, hash long, text binary, owner long, rows long")


def _tries(texts: DataFrame, largest: bool, trie_bytes: int) -> DataFrame:
    """One trie per partition: its terminals, and with their texts those that belong to spilled subtrees."""

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, room = Patricia(largest), [], 0

        def flush() -> pa.RecordBatch:
            done, out[:] = out[:], []
            return pa.record_batch([pa.array([r[i] for r in done], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["size", "sha", "owner", "rows", "text"])

        def elsewhere(terminal: Terminal) -> int:
            key, owner, rows = terminal
            out.append((len(key), None, owner, rows, key))
            return len(key)

        for batch in batches:
            own, rows = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, text in enumerate(batch.column(2)):
                key = text.as_buffer().to_pybytes()
                if not trie.insert(key, own[i], rows[i]):
                    room += elsewhere((key, own[i], rows[i]))
                elif trie.memory > trie_bytes:
                    for terminal in trie.spill(trie_bytes // 2):
                        room += elsewhere(terminal)
                        if room > PIECE_BYTES:
                            yield flush()
                            room = 0
                if room > PIECE_BYTES:
                    yield flush()
                    room = 0
        for key, owner, n in trie.drain():
            out.append((len(key), hashlib.sha256(key).hexdigest(), owner, n, None))
            if len(out) >= 10_000:
                yield flush()
        yield flush()

    ship(texts.sparkSession)
    return texts.mapInArrow(tries, DIGEST + ", owner long, rows long, text binary")


def owners(docs: DataFrame, largest: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text, a trie's terminal: its length, SHA-256, owner and number of rows."""
    # Rows of a text are at most the number of map batches, however many copies it has.
    found, done, parts = cut(_tries(_texts(docs, largest).repartition("size", "hash"), largest, trie_bytes)), [], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        done.append(found.where("text is null").drop("text"))
        again = found.where("text is not null")
        if again.isEmpty():
            break
        parts *= 4
        found = cut(_tries(again.select("size", F.xxhash64("text").alias("hash"), "text", "owner", "rows").repartition(parts, "size", "hash"), largest, trie_bytes))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def classes(docs: DataFrame, largest: bool = True) -> DataFrame:
    """doc_id, text_hash, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    Each row finds its terminal by length and SHA-256 of the normalised text. The join's other
    side, one row per terminal, is a table of its own: nothing but the join stands after
    the shuffle, so adaptive execution can split a hot key.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = filled(batch.column(1), lower=True).cast(pa.binary())
        yield pa.record_batch(
            [
                batch.column(0),
                batch.column(2),
                pa.compute.binary_length(texts).cast(pa.int64()),
                pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string()),
            ],
            names=["doc_id", "text_hash", "size", "sha"],
        )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    rows = map_pieces(keyed, work, "doc_id long, text_hash long, " + DIGEST)
    joined = rows.join(owners(docs, largest), ["size", "sha"])
    return joined.select(
        "doc_id", "text_hash", F.col("owner").alias("keep_id"), F.col("rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("owner")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def deduplicated(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows that stay, with all their columns: one per distinct text, also where identifiers repeat or are null."""
    kept = classes(docs, largest).where("kept").groupBy("doc_id", "text_sha256", "text_hash").agg(F.count("*").alias("n"))
    # Of kept rows that differ in case only, the least hash.
    first = kept.groupBy("doc_id", "text_sha256").agg(F.min(F.struct("text_hash", "n")).alias("k"))
    return only(docs, first.select(F.col("doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash"), "k.n"))
