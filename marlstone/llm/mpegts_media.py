"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores a byte payload losslessly in a single-program transport stream
with private PES data; ``parse`` is a general reader: it reassembles the sections
of program association and program map tables, over as many packets as they
take (checking their CRC), checks continuity counters, reassembles PES packets
and keeps the time stamp of each and whether decoding can start there. Null packets carry nothing and no
counter; packets marked as broken are counted and left out; a counter may jump
where its packet announces it. Damage is counted: whatever the bytes, reading ends
without an exception.

Defined results: a null text counts as empty; an empty payload is one block of
64 zero bytes; very long texts become many PES packets; equal texts give equal
values; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_pieces

PACKET = 188
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
STREAM_TYPE_PRIVATE_PES = 0x06
#: Bytes of payload in one PES packet, and PES packets between random-access points.
UNIT, RANDOM_ACCESS_EVERY = 16_384, 8
#: 90 kHz ticks: first time stamp and distance between two PES packets.
FIRST_PTS, PTS_STEP = 90_000, 3_003
BLOCK = 64
# Null packets, padding PES packets, and stream ids whose PES packets have no optional header.
NULL_PID, PADDING = 0x1FFF, 0xBE
HEADERLESS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, time_stamps array<long>, random_access array<boolean>"
)


def _crc_table() -> list[int]:
    table = []
    for value in range(256):
        crc = value << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        table.append(crc)
    return table


_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _TABLE[(crc >> 24) ^ byte]
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, extension >> 8, extension & 0xFF, 0xC1, 0, 0])
    section = head + body
    return section + crc32_mpeg(section).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> tuple[bytes, bytes]:
    """What stands before and after the continuity counter byte."""
    body = b"\x00" + section
    return bytes([0x47, 0x40 | pid >> 8, pid & 0xFF]), body + b"\xff" * (PACKET - 4 - len(body))


_PAT = _table_packet(0, _section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])))
_PMT = _table_packet(
    PMT_PID,
    _section(2, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, STREAM_TYPE_PRIVATE_PES, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0])),
)
_DATA = bytes([0x47, DATA_PID >> 8, DATA_PID & 0xFF])
_DATA_START = bytes([0x47, 0x40 | DATA_PID >> 8, DATA_PID & 0xFF])


def _time_stamp(prefix: int, ticks: int) -> bytes:
    return bytes([prefix << 4 | (ticks >> 29 & 0x0E) | 1, ticks >> 22 & 0xFF, (ticks >> 14 & 0xFE) | 1, ticks >> 7 & 0xFF, (ticks << 1 & 0xFE) | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    out: list[bytes] = []
    counter = tables = 0
    view = memoryview(payload)
    for unit, start in enumerate(range(0, len(payload), UNIT)):
        chunk = view[start : start + UNIT]
        pts = (FIRST_PTS + unit * PTS_STEP) & 0x1FFFFFFFF
        entry = unit % RANDOM_ACCESS_EVERY == 0
        if entry:
            mark = bytes([0x10 | tables & 15])
            out += (_PAT[0], mark, _PAT[1], _PMT[0], mark, _PMT[1])
            tables += 1
        length = len(chunk) + 8
        pes = b"".join((b"\x00\x00\x01\xbd", length.to_bytes(2, "big"), b"\x84\x80\x05", _time_stamp(2, pts), chunk))
        base = pts - 9_000
        clock = bytes([base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, 0])
        fields = bytes([0x50 if entry else 0x10]) + clock
        room = PACKET - 4 - 1 - len(fields)
        if len(pes) < room:
            fields += b"\xff" * (room - len(pes))
            room = len(pes)
        out += (_DATA_START, bytes([0x30 | counter & 15, len(fields)]), fields, pes[:room])
        counter += 1
        at, end = room, len(pes)
        while end - at >= 184:
            out += (_DATA, bytes([0x10 | counter & 15]), pes[at : at + 184])
            counter += 1
            at += 184
        if at < end:
            stuffing = 184 - (end - at) - 1
            filler = b"" if not stuffing else b"\x00" + b"\xff" * (stuffing - 1)
            out += (_DATA, bytes([0x30 | counter & 15, stuffing]), filler, pes[at:end])
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    """One elementary stream as read back; ``pts`` and ``entry`` have one element per PES packet."""

    stream_type: int = 0
    payload: bytes = b""
    pts: list[int | None] = field(default_factory=list)
    entry: list[bool] = field(default_factory=list)
    truncated: int = 0

    @property
    def pes_packets(self) -> int:
        return len(self.pts)

    @property
    def random_access(self) -> list[int]:
        """Numbers of the PES packets that are random-access points."""
        return [i for i, e in enumerate(self.entry) if e]


@dataclass
class Transport:
    packets: int = 0
    lost_sync: int = 0
    continuity_errors: int = 0
    bad_packets: int = 0
    bad_tables: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, Stream] = field(default_factory=dict)


class Sections:
    """Puts the sections of one table PID together, packet by packet."""

    def __init__(self):
        self.held: bytes | None = None

    def lost(self) -> bool:
        """Forgets an unfinished section; whether there was one."""
        was, self.held = bool(self.held), None
        return was

    def feed(self, payload: bytes, starts: bool) -> Iterator[bytes]:
        """Sections that end in ``payload``, from table_id to CRC; a packet that ``starts`` one points to its first byte."""
        if starts:
            first = 1 + payload[0] if payload else 1
            if self.held is not None:
                yield from self._take(payload[1:first])
            self.held = b""
            payload = payload[first:]
        if self.held is not None:
            yield from self._take(payload)

    def _take(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while len(self.held) >= 3 and self.held[0] != 0xFF:
            end = 3 + ((self.held[1] & 0x0F) << 8 | self.held[2])
            if len(self.held) < end:
                return
            yield self.held[:end]
            self.held = self.held[end:]
        if self.held[:1] in (b"", b"\xff"):  # stuffing up to the packet's end
            self.held = None


def _section_body(section: bytes, table_id: int) -> bytes | None:
    """The body between the section header and the CRC, or None if it doesn't check."""
    if section[0] != table_id or len(section) < 12 or not section[5] & 1 or crc32_mpeg(section):
        return None
    return section[8:-4]


def _read_pts(raw: bytes) -> int:
    return (raw[0] >> 1 & 7) << 30 | raw[1] << 22 | (raw[2] >> 1) << 15 | raw[3] << 7 | raw[4] >> 1


def parse(media: bytes) -> Transport:
    """Reads a transport stream; damage is counted, never raised on."""
    result = Transport(packets=len(media) // PACKET)
    counters: dict[int, int] = {}
    tables: dict[int, Sections] = {0: Sections()}
    known: dict[int, set[bytes]] = {0: set()}
    parts: dict[int, tuple[list[bytes], bool]] = {}
    done: dict[int, list[bytes]] = {}

    def finish(pid: int) -> None:
        pieces, entry = parts.pop(pid, ((), False))
        raw = b"".join(pieces)
        if not raw:
            return
        stream = result.streams[pid]
        bare = len(raw) >= 6 and raw[3] in HEADERLESS
        if len(raw) < (6 if bare else 9) or raw[:3] != b"\x00\x00\x01":
            stream.truncated += 1
            return
        length, start = int.from_bytes(raw[4:6], "big"), 6 if bare else 9 + raw[8]
        end = 6 + length if length else len(raw)
        stream.truncated += end > len(raw) or start > end
        if raw[3] == PADDING:
            return
        stream.pts.append(_read_pts(raw[9:14]) if not bare and raw[7] & 0x80 and raw[8] >= 5 and len(raw) >= 14 else None)
        stream.entry.append(entry)
        done[pid].append(raw[start:end])

    def read_table(pid: int, section: bytes) -> None:
        if section in known[pid]:
            return
        content = _section_body(section, 0 if pid == 0 else 2)
        if content is None:
            result.bad_tables += 1
            return
        known[pid].add(section)
        if pid == 0:
            for i in range(0, len(content) - 3, 4):
                program, own = content[i] << 8 | content[i + 1], (content[i + 2] & 0x1F) << 8 | content[i + 3]
                if program and own not in result.streams:
                    result.programs[program] = own
                    tables.setdefault(own, Sections())
                    known.setdefault(own, set())
            return
        if len(content) < 4:
            result.bad_tables += 1
            return
        i = 4 + ((content[2] & 0x0F) << 8 | content[3])
        while i + 5 <= len(content):
            own = (content[i + 1] & 0x1F) << 8 | content[i + 2]
            if own in tables:
                result.bad_tables += 1  # a table's packets are no elementary stream
            elif own not in result.streams:
                result.streams[own] = Stream(stream_type=content[i])
                done[own] = []
            i += 5 + ((content[i + 3] & 0x0F) << 8 | content[i + 4])

    for at in range(0, result.packets * PACKET, PACKET):
        if media[at] != 0x47:
            result.lost_sync += 1
            continue
        if media[at + 1] & 0x80:  # transport_error_indicator: nothing in it can be trusted
            result.bad_packets += 1
            continue
        pid = (media[at + 1] & 0x1F) << 8 | media[at + 2]
        if pid == NULL_PID:
            continue
        starts, control = bool(media[at + 1] & 0x40), media[at + 3]
        body, random_access, announced = at + 4, False, False
        if control & 0x20:
            size = media[body]
            if size > (182 if control & 0x10 else 183):
                result.bad_packets += 1
                continue
            random_access = bool(size and media[body + 1] & 0x40)
            announced = bool(size and media[body + 1] & 0x80)  # discontinuity_indicator
            body += 1 + size
        if announced:
            counters.pop(pid, None)
        if not control & 0x10:
            continue
        count, before = control & 15, counters.get(pid)
        counters[pid] = count
        gap = before is not None and count != (before + 1) & 15
        if gap:
            if count == before:
                continue  # a packet sent twice
            result.continuity_errors += 1
        if pid in result.streams:
            if starts:
                finish(pid)
                parts[pid] = ([], random_access)
            if pid in parts:
                parts[pid][0].append(media[body : at + PACKET])
        elif pid in tables:
            if gap or announced:
                result.bad_tables += tables[pid].lost()
            for section in tables[pid].feed(media[body : at + PACKET], starts):
                read_table(pid, section)
    result.bad_tables += sum(bool(t.held) for t in tables.values())
    for pid in list(result.streams):
        finish(pid)
        result.streams[pid].payload = b"".join(done[pid])
    return result


def padded(text: str | bytes | None) -> tuple[bytes, int]:
    raw = text.encode() if isinstance(text, str) else text or b""
    size = max(BLOCK, -(-len(raw) // BLOCK) * BLOCK)
    return raw.ljust(size, b"\0"), len(raw)


def feature(read: Transport) -> str:
    """Structure as text: tables, packets, continuity, time stamps, random-access points."""
    stream = next(iter(read.streams.values()), Stream())
    known = [p for p in stream.pts if p is not None]
    span = f"{known[0]}-{known[-1]}" if known else "-"
    return (
        f"programs={len(read.programs)};streams={len(read.streams)};packets={read.packets};pes={stream.pes_packets};"
        f"pts={span};random_access={','.join(map(str, stream.random_access))};"
        f"continuity_errors={read.continuity_errors};lost={read.lost_sync + read.bad_packets + read.bad_tables + stream.truncated}"
    )


def transport_streams(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per document with the digest of its stream as stored and read back.

    ``keep_media=True`` adds the stored stream as the binary column ``media``.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in range(11)]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            payload, size = padded(text.as_buffer().to_pybytes() if text.is_valid else None)
            media = mux(payload)
            read = parse(media)
            stream = next(iter(read.streams.values()))
            back = stream.payload
            values = (key, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(read), stream.pts, stream.entry, media if keep_media else None)
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "time_stamps", "random_access", "media"]
        n = 11 if keep_media else 10
        yield pa.record_batch([pa.array(v, k) for v, k in zip(rows[:n], kinds, strict=False)], names=names[:n])

    return map_pieces(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, SCHEMA + (", media binary" if keep_media else ""))
