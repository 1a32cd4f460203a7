"""Libraries kept in databases, read as the warehouse's relations.

A library in a SQLite file is a partitioned data source (``SqliteLibrary``): each
partition is one range of addresses, read through the table's primary key. Since
addresses are hashes, ranges of equal width hold about equally many objects. A library
in PostgreSQL (or any database that Spark has a JDBC driver for) is read by
``spark.read.jdbc`` over the same ranges. Payloads of index and vector objects may be
stored as a flag byte and a gzip stream; both readers give the logical bytes, and
``size`` is their length.

The SQLite file must lie where every executor can open it (a shared mount). It is opened
read-only, and each partition reads in a transaction of its own: nothing may write to the
library meanwhile.
"""

from __future__ import annotations

import gzip
import sqlite3
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema
from ..errors import InvalidObject, NotFound, VersionMismatch
from ..shipping import ship

# Kinds whose payload may be compressed, and the byte before a gzip stream.
COMPRESSED = ("indexroot", "indexshard", "vecroot", "vecshard")
GZIP_FLAG = 0x01

PREFIX = "sha256:"
#: Partitions of the objects, and payload bytes of a batch.
PARTITIONS, BATCH_BYTES = 64, 8 << 20

TABLES = {
    "objects": schema.OBJECTS,
    "projects": "name string, created_at string, description string",
    "branches": "project string, name string, addr string, updated_at string, description string",
    "meta": schema.META,
}


def address_bounds(n: int) -> list[str]:
    """The n - 1 addresses that cut all addresses into n ranges of equal width."""
    return [f"{PREFIX}{i * 16**8 // n:08x}" for i in range(1, n)]


def inflated(kind: str, data: bytes) -> bytes:
    """Logical bytes of a stored payload."""
    if kind not in COMPRESSED or len(data) < 2 or data[0] != GZIP_FLAG:
        return data
    try:
        return gzip.decompress(data[1:])
    except (OSError, EOFError, zlib.error) as e:
        raise InvalidObject(f"a compressed {kind} can't be read: {e}") from e


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


@dataclass
class Range(InputPartition):
    """Addresses from ``low`` up to, but without, ``high``; None is no bound."""

    low: str | None
    high: str | None


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, partitions: int):
        self.path, self.table, self.n = path, table, partitions

    def partitions(self) -> list[Range]:
        if self.table != "objects":
            return [Range(None, None)]
        bounds = address_bounds(self.n)
        return [Range(low, high) for low, high in zip([None, *bounds], [*bounds, None], strict=True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with_data = self.table == "objects"
        names = [c.split()[0] for c in TABLES[self.table].split(", ")]
        limits = [(sign, bound) for sign, bound in ((">=", partition.low), ("<", partition.high)) if bound is not None]
        where = " WHERE " + " AND ".join(f"addr {sign} ?" for sign, _ in limits) if limits else ""
        kinds = [pa.int64() if n == "size" else pa.binary() if n == "data" else pa.string() for n in names]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        link = _connect(self.path)
        try:
            held, size = [], 0
            for row in link.execute(f"SELECT {', '.join(names)} FROM {self.table}{where}", [bound for _, bound in limits]):
                if with_data:
                    addr, kind, _, data = row
                    data = inflated(kind, data.encode() if isinstance(data, str) else data)
                    row = (addr, kind, len(data), data)
                    size += len(data)
                held.append(row)
                if size >= BATCH_BYTES or len(held) >= 10_000:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)
        finally:
            link.close()


class SqliteLibrary(DataSource):
    """``spark.read.format("sqlite_library").option("table", "objects").load(path)``; options ``table`` and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_library"

    def schema(self) -> str:
        table = self.options.get("table", "objects")
        if table not in TABLES:
            raise ValueError(f"table {table}: one of {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema) -> SqliteReader:
        n = int(self.options.get("partitions", PARTITIONS))
        if n < 1:
            raise ValueError("partitions must be 1 at least")
        return SqliteReader(self.options["path"], self.options.get("table", "objects"), n)


@dataclass
class ForeignLibrary:
    """The relations of a library in a database."""

    objects: DataFrame
    projects: DataFrame
    branches: DataFrame
    meta: DataFrame

    def version(self) -> int:
        """The library's version, which must be this engine's: versions aren't converted."""
        found = [r["value"] for r in self.meta.where("key = 'schema_version'").limit(2).collect()]
        if found != [str(schema.LIBRARY_VERSION)]:
            raise VersionMismatch(f"library version {found}, readable is {schema.LIBRARY_VERSION}")
        return schema.LIBRARY_VERSION


def sqlite_library(spark: SparkSession, path: str, partitions: int = PARTITIONS) -> ForeignLibrary:
    """A library in a SQLite file; the prefixes ``sqlite:`` and ``file:`` may be left out."""
    path = path.removeprefix("sqlite:").removeprefix("file:")
    try:
        link = _connect(path)
        try:
            there = {name for (name,) in link.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        finally:
            link.close()
    except sqlite3.Error as e:
        raise NotFound(f"{path}: {e}") from e
    if lacking := sorted(set(TABLES) - there):
        raise NotFound(f"{path} is no library: it has no table {', '.join(lacking)}")
    ship(spark)
    spark.dataSource.register(SqliteLibrary)
    read = lambda table: spark.read.format("sqlite_library").option("table", table).option("partitions", partitions).load(path)
    return ForeignLibrary(*(read(t) for t in TABLES))


def jdbc_library(spark: SparkSession, url: str, properties: dict[str, str] | None = None, partitions: int = PARTITIONS) -> ForeignLibrary:
    """A library in a database that Spark reaches by JDBC (PostgreSQL, with its driver on the class path)."""
    if url.startswith(("postgres://", "postgresql://")):
        url = "jdbc:postgresql://" + url.split("://", 1)[1]
    bounds = [f"'{b}'" for b in address_bounds(partitions)]
    ranges = [" AND ".join(x for x in (low and f'"addr" >= {low}', high and f'"addr" < {high}') if x) or "1 = 1" for low, high in zip([None, *bounds], [*bounds, None], strict=True)]
    found = spark.read.jdbc(url, '"objects"', predicates=ranges, properties=properties or {}).select("addr", "kind", F.col("data").cast("binary").alias("data"))
    inflate = F.arrow_udf(_inflated, "binary")
    flagged = F.col("kind").isin(*COMPRESSED) & (F.substring("data", 1, 1) == F.lit(bytes([GZIP_FLAG])))
    # The few compressed payloads alone go through Python.
    whole = found.where(~flagged).unionByName(found.where(flagged).withColumn("data", inflate("kind", "data")))
    objects = whole.select("addr", "kind", F.octet_length("data").cast("long").alias("size"), "data")
    read = lambda table, names: spark.read.jdbc(url, f'"{table}"', properties=properties or {}).select(*(F.col(n).cast("string").alias(n) for n in names))
    return ForeignLibrary(objects, *(read(t, [c.split()[0] for c in TABLES[t].split(", ")]) for t in ("projects", "branches", "meta")))


def _inflated(kinds: pa.Array, data: pa.Array) -> pa.Array:
    return pa.array([inflated(k, d) for k, d in zip(kinds.to_pylist(), data.to_pylist(), strict=True)], pa.binary())


def open_library(spark: SparkSession, target: str, **options) -> ForeignLibrary:
    """A foreign library by its name: ``postgres://`` and ``jdbc:`` are databases, anything else is a SQLite file."""
    if target.startswith(("postgres://", "postgresql://", "jdbc:")):
        return jdbc_library(spark, target, **options)
    return sqlite_library(spark, target, **options)
