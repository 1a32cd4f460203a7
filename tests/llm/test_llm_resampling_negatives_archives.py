"""Importance resampling, hard negatives and WARC archives against brute force and odd tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import importance_resampling, voronoi_negatives, warc_chain
from marlstone.llm.queries import op13_warc_chain

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text, n=10_000):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(f.encode()) % n for f in words + [" ".join(p) for p in zip(words, words[1:], strict=False)]]


def resampled(docs, target, percent=25):
    read = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for *_, f in read for b in f), Counter(b for x in target for b in buckets(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, n, f in read:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    eligible = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for rank, o in enumerate(eligible[: percent * len(eligible) // 100], 1):
        o[4] = rank
    return Counter(tuple(o[:5]) for o in out)


def test_resampling(spark, make_docs, odd_rows):
    sentence = "one two three four five six seven eight nine ten "
    many = [(100 + i % 40, sentence * 2 + f"text {i % 7}", "a") for i in range(120)]  # repeated rows and ties
    target = ["Three four five", None, "", "text 3"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for rows, some in ((odd_rows + many, target), (odd_rows, []), ([], target)):
        got = importance_resampling.resample(make_docs(rows), goal if some else goal.limit(0))
        assert Counter(tuple(r) for r in got.collect()) == resampled([r[:2] for r in rows], some)


def test_radix_selection(spark):
    rng = random.Random(4)
    rows = [(rng.choice([-(1 << 63), -5, 0, 1, 70_000, (1 << 63) - 1]), rng.randrange(-10, 10), i) for i in range(300)]
    table = spark.createDataFrame(rows, "a long, b long, c long")
    for k in (1, 2, 77, 150, 299, 300):
        assert importance_resampling.kth_key(table, ["a", "b", "c"], k) == sorted(rows)[k - 1]
    ranked = importance_resampling.ranked(table, ["a", "b", "c"]).collect()
    assert [tuple(r)[:3] for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(rows) and sorted(r["rank"] for r in ranked) == list(range(1, 301))


def test_feature_hashes():
    text = "Ab-c 漢字 12 " + "x" * 64 + " " + "y" * 65 + " z " + "w" * 300 + " é"
    got = importance_resampling.features(pa.array([text, None, "", "one"]))
    assert sorted(got[0][got[1] == 0]) == sorted(buckets(text)[1]) and got[2].tolist() == [buckets(text)[0], 0, 0, 1]


def negatives(rows, n_pos=5, n_neg=5):
    """Straight from the definition; rows are (vec_id, label, whole numbers)."""
    place = lambda i: ((1 << 63) - 1 if rows[i][0] is None else rows[i][0], i)
    out = Counter()
    for a, (vec_id, label, q) in enumerate(rows):
        if vec_id is None or vec_id % 100:
            continue
        score = {i: sum(x * y for x, y in zip(q, r[2], strict=True)) for i, r in enumerate(rows) if i != a}
        order = sorted(score, key=lambda i: (-score[i], place(i)))
        for p in [i for i in order if rows[i][1] == label][:n_pos]:
            fits = [i for i in order if rows[i][1] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out.update((vec_id, rows[p][0], k, rows[i][0], score[p], score[i]) for k, i in enumerate(fits[:n_neg], 1))
    return out


@pytest.mark.parametrize(("chunk", "block", "pivots"), [(16_384, 4_096, 16), (37, 3, 5)])
def test_hard_negatives(spark, monkeypatch, chunk, block, pivots):
    """A hot label, copies, ties, repeated and null identifiers, short vectors and rows that take no part."""
    monkeypatch.setattr(voronoi_negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(voronoi_negatives, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(400):
        v = (centres[i % 6] + rng.normal(size=8) * (0.05 if i % 3 else 1)).round(3).tolist()
        rows.append((i if i % 17 else 100 * (i % 5), 0 if i % 3 else int(rng.integers(0, 5)), v))
    rows += [(500 + i, i % 2, rows[7][2]) for i in range(60)] + [(None, 1, rows[7][2]), (None, 0, rows[8][2]), (700, 1, [1.0, 2.0]), (800, 1, []), (900, 2, [0.0] * 8)]
    bad = [(1000, None, [1.0] * 8), (1100, 1, None), (1200, 1, [1.0, None]), (1300, 1, [float("nan")] * 8), (1400, 0, [float("inf")])]
    table = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<double>").withColumns({"row": F.lit("x"), "q": F.lit("y"), "key": F.lit(1)})
    usable = voronoi_negatives.usable(table)
    assert usable.count() == len(rows)
    whole = [(i, label, [math.floor(256 * x) for x in v] + [0] * (8 - len(v))) for i, label, v in rows]
    got = voronoi_negatives.mine(usable, F.col("vec_id") % 100 == 0, pivots=pivots)
    assert Counter(tuple(r) for r in got.collect()) == negatives(whole)
    assert voronoi_negatives.mine(usable.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert voronoi_negatives.mine(usable.where("vec_id % 100 <> 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_exact_scores():
    big = np.array([[3.0e9, 1.0], [1.0, 2.0**40]])
    want = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in big] for a in big]
    assert voronoi_negatives.scores(big, big).tolist() == [[max(-(2**63), min(2**63 - 1, x)) for x in r] for r in want]


def archived(rows):
    """Per page: id, bytes, digest, type and the page it refers to."""
    best = {}
    for i, html in rows:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    out = Counter()
    for i, html in rows:
        data, owner = (html or "").encode(), best.get(html or "")
        refers = owner if owner is not None and owner != i else None
        out[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers, True] += 1
    return out


@pytest.fixture(scope="module")
def hostile():
    """Payloads of marks, whole records and lengths that lead astray."""
    rng = random.Random(1)
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:9>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    bits = ["\r\n", "\r\n\r\n", "WARC/1.1\r\n", "\nWARC/1.1\r\n", "\r\n\r\nWARC/1.0\r\n", "é", "x" * 50, "漢", "\n", "\r", "Content-Length: 7\r\n\r\n", record % (5, "hello"), record % (90_000, "zz"), "\r\n\r\n" + record % (17, "HTTP/1.1 200\r\n\r\nx")]
    rows = [(i if i % 50 else None, f"http://a/{i}\n" if i % 3 else None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) if i % 11 else rng.choice(["", None, "same"])) for i in range(250)]
    return rows + [(5000 + i // 2, "u", "copy") for i in range(30)]


@pytest.mark.parametrize(("split", "few"), [("128m", 50_000), ("20k", 0)])
def test_archives(spark, monkeypatch, hostile, split, few):
    """Whole files and splits that cut records; repeated payloads broadcast and shuffled."""
    monkeypatch.setattr(warc_chain, "BROADCAST_OWNERS", few)
    monkeypatch.setattr(warc_chain, "FILE_BITS", 64)
    for key, value in (("maxPartitionBytes", split), ("openCostInBytes", "1k")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        pages = spark.createDataFrame(hostile, "page_id long, url string, html string").withColumns({"key": F.lit(1), "value": F.lit("x"), "file": F.lit("f")}).coalesce(2)
        for some, rows in ((pages, hostile), (pages.limit(0), [])):
            got = warc_chain.through_archives(some)
            assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["kind"], r["refers_to"], r["intact"]) for r in got.collect()) == archived([(i, h) for i, _, h in rows])
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")


def test_damaged_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "warc")
    warc_chain.write_archives(pages, path)
    part = next((tmp_path / "warc").glob("part-*"))
    data = part.read_bytes()
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and warc_chain.read_archives(spark, path).count() == 20
    for crc in (tmp_path / "warc").glob(".*.crc"):
        crc.unlink()
    for bad in (data[:-100], data.replace(b"page 7", b"page 7 and more", 1), b"x" + data):
        part.write_bytes(bad)
        with pytest.raises(ValueError, match="chain of records"):
            warc_chain.read_archives(spark, path)
    part.write_bytes(data.replace(b"page 7", b"page 8", 1))
    assert [r["page_id"] for r in warc_chain.read_archives(spark, path).where("not intact").collect()] == [7]


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long text"), (4, "u", "long text")], "page_id long, url string, html string")
    got = {(r["page_id"], r["kind"], r["refers_to"]) for r in warc_chain.through_archives(pages, least_bytes=3).collect()}
    assert got == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}


def test_archive_query(spark):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")) for r in op13_warc_chain(spark, "/root/testdata/sf0.001").collect()) == archived(rows)
