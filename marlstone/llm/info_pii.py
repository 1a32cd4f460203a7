"""Personal data by information-theoretic sanitisation.

Pattern matches (email, ip, card, phone) are generalised to their kind. What
they stand for is protected at several levels, each an entity of its own: the
kind, the person and the host of an address, the network of an ip, the issuer of
a card, the area of a phone number, and the value itself. Corpus co-occurrence
then estimates how strongly other terms of the text reveal an entity: of N
documents, ``n(e)`` hold the entity, ``n(t)`` the term and ``n(t, e)`` both;
with ``P(e) = n(e) / N`` and ``P(e | t) = (n(t, e) + S P(e)) / (n(t) + S)``, the
pointwise mutual information is ``log2 P(e | t) - log2 P(e)`` bits out of the
entity's own ``-log2 P(e)``. A term that falls short of those by at most
``SHORTFALL`` bits, and gives ``GAIN`` bits or more, discloses the entity; it is
a span of kind ``term`` in the documents that hold the entity, and is removed
there. Entities and pairs must stand in at least two different texts, so copies
of one text prove nothing.

Counting covers all documents and terms; what can't disclose anything is left
out by its counts before pairs are made: terms of a single text with personal
data, and terms that stand in more documents without personal data than all
those with it, or than the entity's, could outweigh.

Defined results: null and empty texts have no spans; repeated rows and null
identifiers give rows of their own; matches of one kind don't overlap, those of
different kinds may; terms inside a match are no terms; very long texts are
read whole; an empty table gives an empty table; extra columns are ignored by
``find`` and carried by ``sanitised``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, byte_table, cut, filled, map_pieces, split_words, text_hash, translated, word_hashes

KINDS = ("email", "ip", "card", "phone", "term")
#: Bits by which a term may fall short of revealing its entity (1: it does so in half of its documents), and bits it must give.
SHORTFALL, GAIN = 1.0, 1.0
#: Weight of the prior in a term's estimate, in documents.
SMOOTHING = 1.0
#: Bits of the broadcast filter of terms to count: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26

_LETTERS = byte_table("abcdefghijklmnopqrstuvwxyz")
_TERM = re.compile(r"[^\x00-@\[-`{-\x7f]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: A cheap test that a text can hold a match of each kind.
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}

# Contract patterns. Each starts where no shorter start could do better, and possessive
# repeats keep them linear on long runs of digits.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[Span]:
    return [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    return out


def phones(text: str) -> list[Span]:
    return [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


_FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}
_RANK = {k: i for i, k in enumerate(KINDS)}


def by_place(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in by_place(spans))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def terms(text: str, spans: list[Span]) -> dict[str, list[tuple[int, int]]]:
    """Places of each term outside ``spans``."""
    taken = sorted((a, b) for _, a, b in spans)
    out: dict[str, list[tuple[int, int]]] = {}
    i = 0
    for m in _TERM.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if any(a < m.end() and m.start() < b for a, b in taken[i : i + 4]):
            continue
        out.setdefault(m[0].translate(_ASCII_LOWER), []).append(m.span())
    return out


def protected(kind: str, value: str) -> list[str]:
    """The entities that a match stands for, from its kind to its value."""
    value = value.translate(_ASCII_LOWER)
    digits = "".join(c for c in value if c.isdigit())
    if kind == "email":
        local, host = value.split("@", 1)
        person = " ".join(_TERM.findall(local))
        parts = [f"host {host}", *([f"person {person}"] if person else []), f"value {value}"]
    elif kind == "ip":
        parts = [f"network {value.rsplit('.', 1)[0]}", f"value {value}"]
    elif kind == "card":
        parts = [f"issuer {digits[:6]}", f"value {digits}"]
    else:
        parts = [f"area {digits[:4]}", f"value {digits}"]
    return [kind, *(f"{kind} {p}" for p in parts)]


_FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, text_key long, "
    "entities array<long>, text string"
)


def matches(docs: DataFrame) -> DataFrame:
    """Pattern matches of every row; entities (as hashes) and the text only where there are any."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = filled(batch.column(1))
        hints = {k: pc.match_substring_regex(texts, h).to_numpy(zero_copy_only=False) for k, h in _HINTS.items()}
        n = batch.num_rows
        counts = {k: np.zeros(n, np.int64) for k in _FINDERS}
        base = [""] * n
        entities: list[list[int] | None] = [None] * n
        held: list[str | None] = [None] * n
        for i in np.flatnonzero(np.logical_or.reduce(list(hints.values()))).tolist():
            text, spans = texts[i].as_py(), []
            for kind, find in _FINDERS.items():
                if hints[kind][i]:
                    got = find(text)
                    counts[kind][i] = len(got)
                    spans += got
            if spans:
                base[i], held[i] = written(spans), text
                entities[i] = sorted({_number(e) for k, a, b in spans for e in protected(k, text[a:b])})
        yield pa.record_batch(
            [
                batch.column(0),
                *(pa.array(c) for c in counts.values()),
                pa.array(base, pa.string()),
                batch.column(2),
                pa.array(entities, pa.list_(pa.int64())),
                pa.array(held, pa.string()),
            ],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "text_key", "entities", "text"],
        )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_key"))
    return map_pieces(keyed, work, _FOUND).withColumn("_row", F.monotonically_increasing_id())


def read_spans(text: str) -> list[Span]:
    """Spans as ``written`` puts them."""
    return [(kind, int(a), int(b)) for kind, a, b in (s.split(":") for s in text.split(",") if s)]


def _spots(words: pa.Array) -> np.ndarray:
    return (word_hashes(words) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter(terms: DataFrame) -> Broadcast:
    """A bitmap of the terms' hashes: what isn't in it is none of them. Its size is the same whatever the corpus."""

    def spots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array(_spots(batch.column(0)))], names=["s"])

    return terms.sparkSession.sparkContext.broadcast(bitmap(map_pieces(terms.select("term"), spots, "s long", text_column="term"), "s", FILTER_BITS))


def _passes(bits: np.ndarray, words: pa.Array) -> np.ndarray:
    spot = _spots(words)
    return ((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)


def holder_terms(found: DataFrame, only: Broadcast | None = None) -> DataFrame:
    """_row, text_key and each term outside the matches (that passes the filter ``only``), of the rows that have matches."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = [list(terms(t, read_spans(b))) for t, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        at, names = np.repeat(np.arange(batch.num_rows), [len(o) for o in own]), pa.array([t for o in own for t in o], pa.string())
        if only is not None:
            keep = pa.array(_passes(only.value, names))
            at, names = pa.array(at).filter(keep), names.filter(keep)
        yield pa.record_batch([batch.column(2).take(pa.array(at)), batch.column(3).take(pa.array(at)), names], names=["_row", "text_key", "term"])

    return map_pieces(found.where("text is not null").select("text", "base", "_row", "text_key"), work, "_row long, text_key long, term string")


def document_frequencies(docs: DataFrame, only: Broadcast) -> DataFrame:
    """Over the whole corpus, documents that hold each term that passes the filter ``only``."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, rows = split_words(translated(filled(batch.column(0)), _LETTERS))
        coded = words.dictionary_encode()
        keep = _passes(only.value, coded.dictionary)
        ids, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        some = keep[ids] if len(ids) else np.zeros(0, bool)
        once = np.bincount(np.unique(rows[some].astype(np.int64) * size + ids[some]) % size, minlength=len(coded.dictionary))
        yield pa.record_batch([coded.dictionary.filter(pa.array(keep)), pa.array(once[keep].astype(np.int64))], names=["term", "n"])

    return map_pieces(docs.select("text"), work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosures(found: DataFrame, docs: DataFrame, shortfall: float = SHORTFALL, gain: float = GAIN) -> tuple[DataFrame, DataFrame]:
    """Pairs (entity, term) that disclose, with their bits, and the occurrences they were counted from."""
    two_texts = F.min("text_key") < F.max("text_key")
    n_docs = found.count()
    single = found.where("entities is not null").select("_row", "text_key", F.explode("entities").alias("entity"))
    entities = cut(single.groupBy("entity").agg(F.count("*").alias("n_e"), two_texts.alias("two")).where("two").drop("two"))
    # P(e | t) reaches the share only if the entity's documents, and all documents with personal data, outweigh the term's.
    share = 2.0**-shortfall
    can = lambda n: n + F.lit(SMOOTHING) * (n / F.lit(float(max(1, n_docs)))) >= share * (F.col("n_t") + SMOOTHING)
    seen = cut(holder_terms(found).groupBy("term").agg(F.count("*").alias("n_h"), two_texts.alias("two")).where("two").drop("two"))
    counted = document_frequencies(docs, _filter(seen))
    rare = cut(counted.join(seen, "term").where(F.col("n_h") + SMOOTHING >= share * (F.col("n_t") + SMOOTHING)).select("term", "n_t"))
    by_row = single.join(entities, "entity").groupBy("_row").agg(F.collect_list(F.struct("entity", "n_e")).alias("held"))
    held = holder_terms(found, _filter(rare)).join(rare, "term").join(by_row, "_row").select("_row", "text_key", "term", "n_t", F.explode(F.filter("held", lambda e: can(e["n_e"]))).alias("e"))
    pairs = cut(held.select("_row", "text_key", "term", "n_t", "e.entity", "e.n_e"))
    together = pairs.groupBy("entity", "term", "n_t", "n_e").agg(F.count("*").alias("n_te"), two_texts.alias("two")).where("two")
    prior = F.col("n_e") / F.lit(float(max(1, n_docs)))
    given = (F.col("n_te") + SMOOTHING * prior) / (F.col("n_t") + SMOOTHING)
    strong = together.select("entity", "term", (-F.log2(given)).alias("shortfall"), (F.log2(given) - F.log2(prior)).alias("gain"))
    return strong.where((F.col("shortfall") <= shortfall) & (F.col("gain") >= gain)), pairs


def find(docs: DataFrame, shortfall: float = SHORTFALL, gain: float = GAIN) -> DataFrame:
    """Counts, base spans, all spans (with disclosing terms) of every row, and its sanitised text where that differs."""
    found = cut(matches(docs))
    strong, pairs = disclosures(found, docs, shortfall, gain)
    flagged = pairs.join(cut(strong), ["entity", "term"]).groupBy("_row").agg(F.collect_set("term").alias("terms"))

    @F.pandas_udf("spans string, n_term long, sanitised string")
    def clean(texts: pd.Series, bases: pd.Series, flagged: pd.Series) -> pd.DataFrame:
        rows = []
        for text, base, names in zip(texts, bases, flagged):
            spans, names = read_spans(base), () if names is None else set(names)
            if names:
                spans += [("term", *place) for term, places in terms(text, spans).items() if term in names for place in places]
            every = written(spans)
            rows.append((every, len(names), redact(text, every)))
        return pd.DataFrame(rows, columns=["spans", "n_term", "sanitised"])

    counts = ["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")]
    held = found.where("text is not null").join(flagged, "_row", "left").withColumn("c", clean("text", "base", "terms")).select(*counts, "c.*")
    free = found.where("text is null").select(*counts, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_term"), F.lit(None).cast("string").alias("sanitised"))
    return held.unionByName(free)


def redact(text: str | None, spans: str) -> str:
    """``text`` with its matches generalised to their kind and its disclosing terms removed."""
    text, out, free = text or "", [], 0
    for span in filter(None, spans.split(",")):
        kind, a, b = span.split(":")
        a, b = int(a), int(b)
        if a >= free:
            out += (text[free:a], "" if kind == "term" else f"[{kind}]")
        free = max(free, b)
    return "".join(out) + text[free:]


def sanitised(docs: DataFrame, shortfall: float = SHORTFALL, gain: float = GAIN) -> DataFrame:
    """``docs`` with sanitised texts; rows keep all their columns. Equal rows have equal texts."""
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_hash().alias("_key"))
    found = find(docs.select("doc_id", "text"), shortfall, gain).where("sanitised is not null").groupBy(F.col("doc_id").alias("_found_id"), F.col("text_key").alias("_found_key")).agg(F.first("sanitised").alias("_text"))
    joined = rows.join(found, rows["_id"].eqNullSafe(found["_found_id"]) & (rows["_key"] == found["_found_key"]), "left")
    return joined.select(*(F.coalesce("_text", "_row.text").alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`") for c in names))
