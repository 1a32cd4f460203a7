"""WARC archives written from pages and read back by boundary-chain verification.

Writing: each page becomes a response record; of equal payloads of at least
``least_bytes`` bytes the page with the largest identifier keeps it and the others
revisit that one. Archives are written by Spark's text writer, in whatever store it writes.

Reading: Spark's text reader cuts the files at every line that starts like a record, in
splits of any size. Such a place is only a candidate: it may stand inside a payload. Each
task follows its split in order and emits, for every candidate, where its record's
successor must begin by the length it states. Candidates that lead straight to the next
one form runs. Over the runs, whose number follows the splits and not the records,
pointer jumping from the start of each file finds the runs that the chain enters, and
where; only candidates from there on are records. A chain that doesn't end at the end of
its file is damage, and raises. Records that hold candidates inside their payload are
put together from their pieces in a second reading of their files alone.

Defined results: a null payload is an empty one; equal payloads are told by SHA-256; a
null identifier counts as the smallest, is never revisited, and is read back as null;
repeated rows of the page that keeps a payload are responses all; a null address gives a
record without one, and line breaks in addresses are escaped; empty tables give an empty
archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import bitmap, cut, dropped, scratch_path, small_batches

#: Payloads shorter than this are never revisited.
LEAST_BYTES = 0
#: Repeated payloads up to this many (about 5 MB) are broadcast; beyond, pages are shuffled by their payload's hash.
BROADCAST_OWNERS = 50_000
#: The date of records whose page has none.
DATE = "1970-01-01T00:00:00Z"
#: Where Spark cuts: a line that starts like a record of version 1.0 or 1.1. No part of it is a start of itself.
MARK = "\nWARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HEAD = len(MARK) - 1
_END = b"\r\n\r\n"


def base32_of(hexadecimal: Column) -> Column:
    """A SHA-1 in hexadecimal as upper-case base32: 20 bits at a time."""
    out = []
    for part in range(8):
        bits = F.conv(F.substring(hexadecimal, 5 * part + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(bits, 15 - 5 * i).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for i in range(4)]
    return F.concat(*out)


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest (base32 SHA-1) and refers_to (null: a response) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    # Counted before the shuffle, so copies are no hot group; groups of one need no owner.
    owners = rows.where(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("key", "owner")
    owners = cut(owners)
    # While few payloads are repeated, pages need no shuffle to learn so.
    few = owners.limit(BROADCAST_OWNERS + 1).count() <= BROADCAST_OWNERS
    found = rows.join(F.broadcast(owners) if few else owners, "key", "left")
    refers = F.when(F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    return found.select("page_id", "url", "payload", base32_of(F.sha1("payload")).alias("digest"), refers.alias("refers_to"))


def record(date: str = DATE) -> Column:
    """The bytes of a planned page's record as text, without its last line feed."""
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\r\n"))
    name = lambda c: F.concat(F.lit(f"<{NAME}"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: ", name("page_id")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI: ", url)).otherwise(""),
        line("WARC-Date: ", date),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To: ", name("refers_to")), line("WARC-Profile: ", PROFILE))).otherwise(""),
        line("Content-Type: application/http;msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r"),
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """One archive per task in the folder ``path``."""
    planned(pages, least_bytes).select(record(date).alias("value")).write.option("lineSep", "\n").text(path)


# reading

_FIELDS = "page_id long, kind string, refers_to long, stated_bytes long, stated_digest string, whole boolean, payload_bytes long, payload_digest string"
_CANDIDATE = f"file string, file_size long, block long, number long, at long, advance long, run long, away long, {_FIELDS}"
#: Files with broken records are told apart by so many bits.
FILE_BITS = 1 << 20


def _field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)[ \t]*\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def _named(text: str | None) -> int | None:
    found = re.fullmatch(rf"<{NAME}(-?[0-9]+)>", text or "")
    return int(found[1]) if found else None


def _parsed(piece: bytes, follows: int) -> tuple:
    """Distance from a record's start to its successor's, and its fields; ``piece`` begins after the mark.

    Payloads are measured where the record ends ``follows`` bytes from its start, where the next
    candidate stands (or a byte earlier, where the file ends).
    """
    head, blank, rest = piece.partition(_END)
    size = _field(head, b"Content-Length") if blank else None
    if size is None or not re.fullmatch(r"[0-9]{1,18}", size) or not re.match(rb"[01]\r\n", head):
        return None, None, None, None, None, None, False, None, None
    away = _HEAD + len(head) + len(_END) + int(size) + len(_END)
    digest = (_field(head, b"WARC-Payload-Digest") or "").removeprefix("sha1:") or None
    known = away, _named(_field(head, b"WARC-Record-ID")), _field(head, b"WARC-Type"), _named(_field(head, b"WARC-Refers-To"))
    if away not in (follows, follows - 1):
        return *known, None, digest, False, None, None
    http, _, payload = rest[: int(size)].partition(_END)
    stated = _field(http, b"Content-Length")
    return *known, int(stated) if stated and stated.isdigit() else None, digest, True, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """value, file, file_size and block of the text between the marks."""
    small_batches(spark)
    ship(spark)
    rows = spark.read.option("lineSep", MARK).option("recursiveFileLookup", "true").text(path)
    meta = F.col("_metadata")
    return rows.select(F.col("value").cast("binary").alias("value"), meta["file_path"].alias("file"), meta["file_size"].alias("file_size"), meta["file_block_start"].alias("block"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, int, int, bytes, int]]:
    """file, its size, block, number in the block, where the record would start, what the piece and a mark take, the piece
    after the mark and how far the next candidate stands. Starts count from the block's first piece.

    The text reader gives the lines of a split in order.
    """
    known, number, start = None, 0, 0
    for batch in batches:
        values, files, sizes, blocks = batch.columns
        for i in range(batch.num_rows):
            file, block, piece = files[i].as_py(), blocks[i].as_py(), values[i].as_py()
            if (file, block) != known:
                known, number, start = (file, block), 0, 0
            advance = len(piece) + len(MARK)
            if block == number == 0:  # no line feed before the file's first record
                at, follows = 0, len(piece) + 1
                piece = piece[_HEAD:] if piece.startswith(MARK[1:].encode()) else b""
            else:
                at, follows = start - _HEAD, advance
            yield file, sizes[i].as_py(), block, number, at, advance, piece, follows
            start += advance
            number += 1


def _batches(rows: Iterator[tuple], schema: str, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    named = [c.split() for c in schema.split(", ")]
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) == most or weight > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*held, strict=True), named, strict=True)], names=[n for n, _ in named])
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*held, strict=True), named, strict=True)], names=[n for n, _ in named])


def candidates(pieces: DataFrame) -> DataFrame:
    """Every place where a record may begin, how far its successor is, and the run of candidates that lead to one another."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        run, led = 0, None
        for file, size, block, number, at, advance, piece, follows in _placed(batches):
            away, *fields = _parsed(piece, follows)
            if led != (file, block, at):
                run = number
            led = None if away is None else (file, block, at + away)
            yield file, size, block, number, at, advance, run, away, *fields

    return pieces.mapInArrow(lambda batches: _batches(found(batches), _CANDIDATE), _CANDIDATE)


def _from_start(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at`` counted from the start of the file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("file", "block").agg(F.sum("advance").alias("_n")).select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, ["file", "block"]).withColumn("at", F.col("at") + F.col("_base")).drop("_base")


def chained(found: DataFrame) -> DataFrame:
    """The candidates that the chain from their file's start meets; raises where a chain doesn't end with its file."""
    runs = cut(found.groupBy("file", "block", "run").agg(F.max("file_size").alias("file_size"), F.max_by(F.col("at") + F.col("away"), "at").alias("leaves")))
    landing = found.select("file", F.col("at").alias("entry"), F.col("block").alias("to_block"), F.col("run").alias("to_run"))
    jump = cut(runs.where("leaves is not null").join(landing, (runs["file"] == landing["file"]) & (runs["leaves"] == landing["entry"])).select(runs["file"], "block", "run", "to_block", "to_run", "entry"))
    reached = cut(found.where("at = 0").select("file", "block", "run", F.col("at").alias("entry")))
    while True:  # after k rounds all runs within 2^k jumps of a start
        more = reached.drop("entry").join(jump, ["file", "block", "run"]).select("file", F.col("to_block").alias("block"), F.col("to_run").alias("run"), "entry")
        more = cut(more)
        if more.isEmpty():
            break
        reached = cut(reached.unionByName(more))
        then = jump.select("file", F.col("block").alias("to_block"), F.col("run").alias("to_run"), F.col("to_block").alias("_b"), F.col("to_run").alias("_r"), F.col("entry").alias("_e"))
        jump = cut(jump.drop("entry").join(then, ["file", "to_block", "to_run"]).select("file", "block", "run", F.col("_b").alias("to_block"), F.col("_r").alias("to_run"), F.col("_e").alias("entry")))
    last = runs.join(reached, ["file", "block", "run"], "left").groupBy("file").agg(F.max("file_size").alias("size"), F.max(F.when(F.col("entry").isNotNull(), F.col("leaves"))).alias("end"))
    torn = last.where(~F.col("end").eqNullSafe(F.col("size"))).head()
    if torn:
        raise ValueError(f"{torn['file']}: the chain of records ends at {torn['end']} of {torn['size']} bytes")
    return found.join(reached, ["file", "block", "run"]).where("at >= entry").drop("entry")


def _mended(spark: SparkSession, path: str, records: DataFrame, broken: DataFrame) -> DataFrame:
    """Records with candidates inside them, read a second time: their pieces are put together and parsed whole."""
    name = lambda c: F.pmod(F.crc32(F.col(c).cast("binary")), F.lit(FILE_BITS))
    bits = bitmap(broken.select(name("file").alias("spot")).distinct(), "spot", FILE_BITS)
    schema = "file string, block long, at long, advance long, value binary"

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for file, _, block, _, at, advance, piece, _ in _placed(batches):
            spot = zlib.crc32(file.encode()) % FILE_BITS
            if bits[spot >> 3] >> (spot & 7) & 1:
                yield file, block, at, advance, piece

    pieces = _from_start(cut(pieces_of(spark, path).mapInArrow(lambda batches: _batches(some(batches), schema), schema)))
    files = broken.select("file").distinct()
    starts = records.join(files, "file", "left_semi").select("file", "at", F.col("at").alias("start"), F.when(~F.col("whole"), F.col("away")).alias("away"))
    so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = pieces.join(starts, ["file", "at"], "left").select("file", "at", "value", "start", "away")
    owned = owned.withColumns({"start": F.last("start", True).over(so_far), "away": F.last(F.when(F.col("start").isNotNull(), F.coalesce("away", F.lit(-1))), True).over(so_far)})
    whole = owned.where("away >= 0").groupBy("file", "start", "away").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    out = f"file string, at long, {_FIELDS}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, start, away, parts = (batch.column(c)[i].as_py() for c in ("file", "start", "away", "parts"))
                yield file, start, *_parsed(MARK.encode().join(p["value"] for p in parts), away)[1:]

    return whole.mapInArrow(lambda batches: _batches(put(batches), out), out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, at, kind, page_id, refers_to, payload_bytes, payload_digest and intact of every record.

    A response's length and digest are those of the payload read; a revisit's are those it states of the
    payload it refers to. ``intact``: what was read agrees with what the record states.
    """
    found = cut(_from_start(cut(candidates(pieces_of(spark, path)))))
    records = cut(chained(found))
    fields = ["file", "at", *(c.split()[0] for c in _FIELDS.split(", "))]
    broken = records.where("not whole")
    out = records.where("whole").select(*fields)
    if not broken.isEmpty():
        out = out.unionByName(_mended(spark, path, records, broken).select(*fields))
    revisit = F.col("kind") == "revisit"
    read = {
        "intact": F.when(revisit, F.col("payload_bytes") == 0).otherwise((F.col("payload_bytes") == F.col("stated_bytes")) & (F.col("payload_digest") == F.col("stated_digest"))),
        "payload_bytes": F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")),
        "payload_digest": F.when(revisit, F.col("stated_digest")).otherwise(F.col("payload_digest")),
    }
    return out.withColumns(read).select("file", "at", "kind", "page_id", "refers_to", "payload_bytes", "payload_digest", "intact")


def through_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Every page's record as archives in the shared folder give it back; the archives go once they are read."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    try:
        write_archives(pages, path, least_bytes)
        return cut(read_archives(spark, path))
    finally:
        dropped(spark, path)
