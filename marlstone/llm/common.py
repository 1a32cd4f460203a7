"""Helpers shared by the training-data operators.

Everything that has to outlive an executor goes to the folder named by
``spark.checkpoint.dir``; when that setting is absent on a local master (tests,
a laptop) a temporary folder is set once for the session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Arrow batches are cut into pieces of about this many text bytes before any
#: work is done on them, so memory does not follow the length of the texts.
PIECE_BYTES = 8 << 20
#: Rows of such a piece, at most.
PIECE_ROWS = 1 << 16

_U = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Has Spark send texts in batches of about PIECE_BYTES (its default is eight times that), unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).removesuffix("b") == str(64 << 20):
        spark.conf.set(key, str(PIECE_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = sc.getCheckpointDir() if sc._jsc.sc().getCheckpointDir().isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, lineage cut, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Spark's own file systems."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the identifier written as text; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_hash() -> Column:
    """Hash of a text as it stands; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of ``docs`` named by ``keep(keep_id, keep_hash, n)`` by identifier and text hash, each once.

    ``n`` is how often such a row stands in ``docs``; only where one is repeated are rows told apart.
    """
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_hash().alias("_hash"))
    keep = cut(keep)

    def some(rows: DataFrame) -> DataFrame:
        on = marked["_id"].eqNullSafe(rows["keep_id"]) & (marked["_hash"] == rows["keep_hash"])
        return marked.join(rows, on, "left_semi")

    out, repeated = some(keep.where("n = 1")).select("_row"), keep.where("n > 1")
    if not repeated.isEmpty():
        # Reduced before the shuffle, so a row repeated many times is no hot group.
        out = out.unionByName(some(repeated).groupBy("_id", "_hash").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select("_row.*")


def pieces(batch: pa.RecordBatch, text_column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` holding about ``limit`` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    column = batch.column(text_column)
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = min(start + PIECE_ROWS, max(start + 1, int(np.searchsorted(ends, base + limit, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def map_pieces(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, text_column: str = "text", limit: int = PIECE_BYTES) -> DataFrame:
    """mapInArrow over bounded slices of each batch."""
    at = df.columns.index(text_column)
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, at, limit):
                yield from work(piece)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def filled(column: pa.Array, lower: bool = False) -> pa.Array:
    """Texts with null as empty, optionally with A-Z lower-cased."""
    column = pc.fill_null(column, "")
    return pc.ascii_lower(column) if lower else column


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, flat, and the row each belongs to."""
    lists = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(lists)
    rows = pc.list_parent_indices(lists)
    keep = pc.greater(pc.binary_length(words), 0)
    return words.filter(keep), rows.filter(keep).to_numpy(zero_copy_only=False)


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Texts without nulls with every ASCII byte mapped by ``table`` (which keeps bytes over 127)."""
    texts = texts if texts.offset == 0 else pa.concat_arrays([texts])
    if texts.offset:
        texts = pa.array(texts.to_pylist(), texts.type)
    _, offsets, data = texts.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(table)) if data is not None else pa.py_buffer(b"")
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, data])


def byte_table(kept: str) -> bytes:
    """Lower-cases A-Z, keeps the characters of ``kept`` and all bytes over 127; the rest become spaces."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in kept:
        table[ord(c)] = ord(c)
        table[ord(c.upper())] = ord(c)
    return bytes(table)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element-wise."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, mixed with its length."""
    if not len(words):
        return np.zeros(0, _U)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8).astype(_U)
    starts = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(int(lengths.max()), 0x100000001B3, _U))
    return mix(np.add.reduceat((data + _U(1)) * powers[np.arange(len(data)) - np.repeat(starts, lengths)], starts) ^ lengths.astype(_U))


def bitmap(spots: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of the numbers in ``column`` (from 0 to below ``bits``): so many bits on the driver, whatever the rows."""
    place = F.col(column) + 1
    parts = spots.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(-(-bits // 8), np.uint8)
    for r in parts:
        start = (r["b"] - 1) * len(r["bits"])
        out[start : start + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(out) - start]
    return out


class Written:
    """``df`` as a Parquet table in the shared folder for the length of a ``with`` block."""

    def __init__(self, df: DataFrame, name: str):
        self.df, self.path = df, scratch_path(df.sparkSession, name)

    def __enter__(self) -> DataFrame:
        self.df.write.parquet(self.path)
        return self.df.sparkSession.read.schema(self.df.schema).parquet(self.path)

    def __exit__(self, *_) -> None:
        dropped(self.df.sparkSession, self.path)
