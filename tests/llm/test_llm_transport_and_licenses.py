"""What readers of transport streams must let pass and must count, and licenses that differ in a word."""

import pytest

from marlstone.llm import diagonal_license
from marlstone.llm import mpegts_media as m

PAYLOAD = bytes(range(256)) * 400
NULL = b"\x47\x1f\xff\x10" + b"\xff" * 184


def cut_up(media):
    return [media[i : i + m.PACKET] for i in range(0, len(media), m.PACKET)]


def sound(read, payload=PAYLOAD):
    return read.streams[m.DATA_PID].payload == payload and not (read.continuity_errors or read.bad_packets or read.bad_tables or read.lost_sync or read.streams[m.DATA_PID].truncated)


def test_null_packets_have_no_continuity():
    packets = cut_up(m.mux(PAYLOAD))
    with_nulls = b"".join(p + NULL * (i % 3) for i, p in enumerate(packets))
    read = m.parse(with_nulls)
    assert sound(read) and read.packets == len(with_nulls) // m.PACKET


def test_packets_marked_as_broken_are_left_out_and_counted():
    packets = cut_up(m.mux(PAYLOAD))
    marked = bytearray(packets[10])
    marked[1] |= 0x80
    marked[20:40] = b"\0" * 20
    read = m.parse(b"".join([*packets[:10], bytes(marked), *packets[10:]]))  # the sender repeats it whole
    assert read.bad_packets == 1 and read.streams[m.DATA_PID].payload == PAYLOAD and read.continuity_errors == 0
    read = m.parse(b"".join([*packets[:10], bytes(marked), *packets[11:]]))
    assert read.bad_packets == 1 and read.continuity_errors == 1 and len(read.streams[m.DATA_PID].payload) < len(PAYLOAD)
    other = bytearray(packets[10])  # its identifier may be wrong too: no counter moves
    other[1:3] = b"\xff\xff"
    assert m.parse(b"".join([*packets[:10], bytes(other), *packets[10:]])).bad_packets == 1


@pytest.mark.parametrize("alone", [False, True])
def test_announced_jumps_of_the_counter_are_no_errors(alone):
    packets = [bytearray(p) for p in cut_up(m.mux(PAYLOAD))]
    starts = [i for i, p in enumerate(packets) if (p[1], p[2]) == (0x40 | m.DATA_PID >> 8, m.DATA_PID & 0xFF)]
    at = starts[2]
    for p in packets[at:]:
        if (p[1] & 0x1F, p[2]) == (m.DATA_PID >> 8, m.DATA_PID & 0xFF):
            p[3] = p[3] & 0xF0 | p[3] + 5 & 0x0F
    jumped = b"".join(map(bytes, packets))
    assert m.parse(jumped).continuity_errors == 1
    if alone:  # in a packet of its own, without payload
        packets.insert(at, bytearray(b"\x47" + bytes([m.DATA_PID >> 8, m.DATA_PID & 0xFF]) + b"\x20\xb7\x80" + b"\xff" * 182))
    else:
        packets[at][5] |= 0x80
    assert sound(m.parse(b"".join(map(bytes, packets))))
    late = next(i for i, p in enumerate(packets) if i > at + 20 and (p[1] & 0x5F, p[2]) == (m.DATA_PID >> 8, m.DATA_PID & 0xFF))
    del packets[late]
    assert m.parse(b"".join(map(bytes, packets))).continuity_errors == 1


def in_packets(pes, counter=0):
    """A PES packet in transport packets without adaptation fields but in the last."""
    out = b""
    for i in range(0, len(pes), 184):
        part, head = pes[i : i + 184], bytes([0x47, (0x40 if i == 0 else 0) | m.DATA_PID >> 8, m.DATA_PID & 0xFF])
        room = 184 - len(part)
        stuffing = b"" if not room else bytes([room - 1]) + (b"\x00" + b"\xff" * (room - 2) if room > 1 else b"")
        out += head + bytes([(0x30 if room else 0x10) | counter & 15]) + stuffing + part
        counter += 1
    return out, counter


@pytest.mark.parametrize("stream_id", [0xBD, 0xBF, 0xF0, 0xF2, 0xFF])
def test_stream_ids_without_the_optional_header_keep_their_first_bytes(stream_id):
    tables = b"".join(cut_up(m.mux(b"x" * 64))[:2])
    out, counter = b"", 0
    for unit in (b"\x80\x80\x05first bytes" * 30, b"ab"):
        head = b"" if stream_id in m.HEADERLESS else b"\x80\x00\x00"
        made, counter = in_packets(b"\x00\x00\x01" + bytes([stream_id]) + (len(head) + len(unit)).to_bytes(2, "big") + head + unit, counter)
        padding, counter = in_packets(b"\x00\x00\x01\xbe" + (50).to_bytes(2, "big") + b"\xff" * 50, counter)
        out += made + padding
    read = m.parse(tables + out)
    assert sound(read, b"\x80\x80\x05first bytes" * 30 + b"ab") and read.streams[m.DATA_PID].pts == [None, None]


def test_telling_words_must_stand(make_docs):
    """Another version or variant is its own license or none, never its relative's."""
    cases = [
        ("Licensed under the GNU General Public License version 2", "gpl,gpl-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("This work is licensed under the GNU Affero General Public License version 3", "agpl-3.0,gpl"),
        ("Licensed under the Apache License, Version 1.1", ""),
        ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2.0"),
        ("Licensed under the Zpache License, Version 2.0", ""),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
        ("Licensed under CC BY-SA 3.0", "cc-by"),
        ("Licensed under CC BY 4.0.", "cc-by,cc-by-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial license", ""),
        ("This work is licensed under a Creative Commons Attribution license", "creative-commons"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", ""),
        ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; you can redistribute it and/or modify it", "gpl,lgpl"),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in diagonal_license.scan(make_docs([(i, t, "a") for i, (t, _) in enumerate(cases)])).collect()}
    assert {cases[i][0]: got[i][0] for i in got} == dict(cases)
    for i, (_, labels) in enumerate(cases):
        named = set(labels.split(",")) - {"", *diagonal_license.BASE.values()}
        assert (got[i][1] >= diagonal_license.COVER) if named else got[i][1] == (diagonal_license.PHRASE if labels else 0)
