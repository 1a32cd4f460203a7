"""Language-model scores from Brown class-based bigrams.

Exchange clustering gives every word a class so that the likelihood of the
corpus' class bigrams grows; a text's probability is the product of class
transitions and word emissions.

Every word of the training corpus is clustered by its own contexts, in two
steps. Words with a share of at least ``ITEM_SHARE`` of all tokens (at most
1 / ITEM_SHARE of them, whatever the corpus) are exchanged one after another,
in sweeps on the driver; all others stand for it in ``BUCKETS`` items named by
their ending. Bigrams of items are counted by Spark over the whole corpus and
stay distributed; each sweep reduces them to items times classes. Then Spark
gathers the contexts of each of the other words over the whole corpus and moves
the word from its ending's class to the class where the likelihood gains most,
all words at once against the sweeps' class bigrams. Class bigrams are counted
anew from the same contexts; a neighbour that is itself such a word counts for
the classes of its ending by their share. An unknown word gets the class that
most tokens of its ending have.

What is kept where: word counts, contexts and classes of all words are tables
that grow with the corpus. Counts and classes of words above ``HEAD_SHARE`` are
broadcast (again a proven bound); those of the long tail reach the texts by a
join, in which no word is frequent, token by token, so that transitions between
them are those of the text.

Probabilities: P(b | a) = (C(a, b) + T P(b)) / (C(a) + T) for classes, and
(n + D) / (N + D S) for the words of a class, where N is their tokens and S
their number, one unknown word for each ending of the class included. So the
model sums to one over known words, one unknown word per ending and the end.

Defined results: null and empty texts are an end token alone; repeated rows
and null identifiers are scored as rows of their own; without training texts
all words are unknown; very long texts are read whole; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Written, cut, filled, id_crc, map_pieces, split_words

ITEM_SHARE, HEAD_SHARE = 2.0**-16, 2.0**-21
BUCKETS, CLASSES, ROUNDS = 512, 64, 5
#: Additive smoothing of emissions, and weight of the unigram in transitions.
D, T = 0.1, 2.0
#: Cells of the context table that one task sums.
BLOCK = 1 << 15
#: The end token is item 0 and has class 0 to itself.
END = 0


def training(docs: DataFrame) -> DataFrame:
    return docs.where(id_crc() % 10 != 0)


def word_counts(docs: DataFrame) -> DataFrame:
    """Word, its ending's bucket and its count over all of ``docs``."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, _ = split_words(filled(batch.column(0), lower=True))
        counted = pc.value_counts(words)
        yield pa.record_batch([counted.field(0), counted.field(1)], names=["word", "n"])

    counts = map_pieces(docs.select("text"), work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.withColumn("bucket", (F.crc32(F.right("word", F.lit(2)).cast("binary")) % BUCKETS).cast("int"))


def buckets(words: pa.Array, n: int = BUCKETS) -> np.ndarray:
    """The bucket of each word: checksum of its last two characters."""
    size = pc.utf8_length(words)
    ends = pc.utf8_slice_codeunits(words, start=-2).dictionary_encode()
    known = np.array([zlib.crc32(e.encode()) % n for e in ends.dictionary.to_pylist()], dtype=np.int64)
    return known[ends.indices.to_numpy(zero_copy_only=False)] if len(size) else np.zeros(0, np.int64)


@dataclass
class Vocabulary:
    """Items, broadcast counts and totals of the training corpus."""

    words: pa.Array  # head words; the first ``n_items`` are items
    counts: np.ndarray
    n_items: int
    ends: int
    tokens: int
    distinct: int
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray
    least: float  # count of a head word, at least

    @property
    def size(self) -> int:
        """Items: end, frequent words, buckets."""
        return 1 + self.n_items + len(self.bucket_tokens)

    def look_up(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place among the head words (or -1) and item of each distinct word."""
        place = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        item = np.where((place >= 0) & (place < self.n_items), place + 1, 1 + self.n_items + buckets(distinct, len(self.bucket_tokens)))
        return place, item

    def item_counts(self) -> np.ndarray:
        return np.concatenate([[self.ends], self.counts[: self.n_items], self.bucket_tokens]).astype(float)


def vocabulary(counts: DataFrame, n_docs: int, item_share: float = ITEM_SHARE, head_share: float = HEAD_SHARE) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    tokens = int(total["n"]) + n_docs
    # At most 1 / head_share words have such a share (or 1 / item_share, as all items are head words).
    least = max(1.0, min(head_share, item_share) * tokens)
    head = counts.where(F.col("n") >= least).select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    n_items = int((head["n"] >= item_share * tokens).sum())
    per = counts.where(F.col("n") < item_share * tokens).groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    bucket_tokens, bucket_words = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in per:
        bucket_tokens[r["bucket"]], bucket_words[r["bucket"]] = r["n"], r["v"]
    return Vocabulary(pa.array(head["word"], pa.string()), head["n"].to_numpy(np.int64), n_items, n_docs, tokens, int(total["v"]) + (n_docs > 0), bucket_tokens, bucket_words, least)


def _sequence(texts: pa.Array, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Items of all texts in a row, ends included, each item's row, and for the words: distinct-word index, head place per distinct word, distinct words."""
    words, rows = split_words(texts)
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place, item = known.look_up(coded.dictionary)
    n = len(texts)
    lengths = np.bincount(rows, minlength=n)
    at = np.arange(len(rows)) + rows  # every text before shifts by one end
    items, owner = np.full(len(rows) + n, END, np.int64), np.repeat(np.arange(n), lengths + 1)
    items[at] = item[index]
    which = np.full(len(items), -1, np.int64)
    which[at] = index
    return items, owner, which, place, coded.dictionary


def item_bigrams(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """Counts of pairs of items; a text starts after an end."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            items = _sequence(filled(batch.column(0), lower=True), shared.value)[0]
            before = np.concatenate([[END], items[:-1]])
            keys, n = np.unique(before * shared.value.size + items, return_counts=True)
            yield pa.record_batch([pa.array(keys), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return map_pieces(docs.select("text"), work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _contexts(bigrams: DataFrame, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Items times classes: counts of classes before and after each item. At most 2 * items * k rows reach the driver."""
    size = len(classes)
    shared = bigrams.sparkSession.sparkContext.broadcast(classes)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * size * k)
        for b in batches:
            before, item = np.divmod(b["pair"].to_numpy(), size)
            n = b["n"].to_numpy()
            total += np.bincount(np.concatenate([item * k + shared.value[before], size * k + before * k + shared.value[item]]), weights=np.concatenate([n, n]), minlength=2 * size * k)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"block": some // BLOCK, "cell": some % BLOCK, "n": total[some]})

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cells = np.bincount(group["cell"], weights=group["n"], minlength=BLOCK)
        return pd.DataFrame({"block": [key[0]], "cells": [zlib.compress(cells.tobytes(), 1)]})

    # Partial tables in as many tasks as run at once, summed block by block; the driver gets a few compressed blocks.
    parts = bigrams.coalesce(max(16, bigrams.sparkSession.sparkContext.defaultParallelism)).mapInPandas(reduce, "block long, cell long, n double").groupBy("block").applyInPandas(pack, "block long, cells binary")
    both = np.zeros(-(-2 * size * k // BLOCK) * BLOCK)
    for r in parts.collect():
        both[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["cells"]))
    both = both[: 2 * size * k]
    return both[: size * k].reshape(size, k), both[size * k :].reshape(size, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def class_bigrams(left: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """C(a, b): class a directly before class b."""
    c = np.zeros((k, k))
    np.add.at(c.T, classes, left)
    return c


def likelihood(c: np.ndarray) -> float:
    return float(_xlogx(c).sum() - _xlogx(c.sum(0)).sum() - _xlogx(c.sum(1)).sum())


def exchange(left: np.ndarray, right: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """One sweep: every item, most frequent first, moves to the class where the class bigrams'
    likelihood is largest. Contexts are those of the sweep's start."""
    classes, c = classes.copy(), class_bigrams(left, classes, k)
    total = left.sum(1)
    mass = np.bincount(classes, weights=total, minlength=k)
    for w in np.argsort(-total, kind="stable"):
        if w == END or not total[w]:
            continue
        own, before, after = classes[w], left[w], right[w]
        c[own] = np.maximum(c[own] - after, 0)
        c[:, own] = np.maximum(c[:, own] - before, 0)
        mass[own] -= total[w]
        b, a = np.flatnonzero(after), np.flatnonzero(before)
        rows, columns = c[:, b], c[a].T
        gain = (_xlogx(rows + after[b]) - _xlogx(rows)).sum(1) + (_xlogx(columns + before[a]) - _xlogx(columns)).sum(1)
        gain -= 2 * (_xlogx(mass + total[w]) - _xlogx(np.maximum(mass, 0)))
        gain[END] = -np.inf
        best = int(gain.argmax())
        c[best] += after
        c[:, best] += before
        mass[best] += total[w]
        classes[w] = best
    return classes


@dataclass
class ClassModel:
    known: Vocabulary
    classes: np.ndarray  # of items
    head_classes: np.ndarray  # of the head words
    unknown: np.ndarray  # class of an unknown word, by ending
    step: np.ndarray  # log10 P(b | a), less log10 of b's normaliser: a word adds log10(n + D)
    history: list[float] = field(default_factory=list)


def contexts(docs: DataFrame, known: Vocabulary, classes: np.ndarray, k: int) -> DataFrame:
    """What stands around each word that is no item: word and code pairs (before, after) with their counts.

    A code is a class for an item and ``k`` plus the ending for any other word.
    """
    width = k + len(known.bucket_tokens)
    codes = np.concatenate([classes[: 1 + known.n_items], np.arange(k, width)])
    shared = docs.sparkSession.sparkContext.broadcast((known, codes))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, codes = shared.value
        items, _, which, _, distinct = _sequence(filled(batch.column(0), lower=True), known)
        rare = np.flatnonzero(items > known.n_items)
        code = codes[items]
        around = np.concatenate([[codes[END]], code])[rare] * width + np.append(code, codes[END])[rare + 1]
        keys, n = np.unique(which[rare] * width**2 + around, return_counts=True)
        yield pa.record_batch([distinct.take(pa.array(keys // width**2)), pa.array(keys % width**2), pa.array(n.astype(np.int64))], names=["word", "around", "n"])

    seen = map_pieces(docs.select("text"), work, "word string, around long, n long").groupBy("word", "around").agg(F.sum("n").alias("n"))
    # A word has at most ``width`` squared pairs, and less than ITEM_SHARE of all tokens.
    return seen.groupBy("word").agg(F.collect_list("around").alias("around"), F.collect_list("n").alias("n"))


def _moved(word: np.ndarray, other: np.ndarray, n: np.ndarray, own: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Gain of every class for every word when its pairs with classes ``other`` join the rows of ``c``; the own class
    already holds them."""
    pairs, place = np.unique(word * len(c) + other, return_inverse=True)
    total = np.bincount(place, weights=n, minlength=len(pairs))
    w, b = np.divmod(pairs, len(c))
    gain = np.zeros((len(own), len(c)))
    for start in range(0, len(pairs), 1 << 14):
        part = slice(start, start + (1 << 14))
        with_own, m = c[:, b[part]].T, total[part][:, None]
        without = with_own.copy()
        mine = np.arange(len(without)), own[w[part]]
        without[mine] = np.maximum(without[mine] - total[part], 0)
        first = np.flatnonzero(np.append(True, np.diff(w[part]) > 0))
        gain[w[part][first]] += np.add.reduceat(_xlogx(without + m) - _xlogx(without), first)
    return gain


def assigned(docs: DataFrame, known: Vocabulary, classes: np.ndarray, c: np.ndarray, k: int) -> DataFrame:
    """word, bucket, n and class of every word that is no item; and, with a null word, partial counts of the pairs
    (cell: side, class and code of the neighbour)."""
    width = k + len(known.bucket_tokens)
    mass = c.sum(0)
    ending_class = classes[1 + known.n_items :]
    shared = docs.sparkSession.sparkContext.broadcast((c, mass, ending_class))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, mass, ending_class = shared.value
        cells = np.zeros((2, k, width))
        class_of = np.concatenate([np.arange(k), ending_class])
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(start, 1 << 13)
                words = part.column(0)
                bucket = buckets(words, width - k)
                own, of = ending_class[bucket], np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
                around, n = (pc.list_flatten(part.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
                before, after = np.divmod(around, width)
                total = np.bincount(of, weights=n, minlength=part.num_rows)
                gain = _moved(of, class_of[after], n, own, c) + _moved(of, class_of[before], n, own, np.ascontiguousarray(c.T))
                without = np.tile(mass, (part.num_rows, 1))
                without[np.arange(part.num_rows), own] -= total
                gain -= 2 * (_xlogx(without + total[:, None]) - _xlogx(without))
                gain[:, END] = -np.inf
                best = gain.argmax(1)
                np.add.at(cells[0], (best[of], before), n)
                np.add.at(cells[1], (best[of], after), n)
                yield pa.record_batch([words, pa.array(bucket.astype(np.int32)), pa.array(total.astype(np.int64)), pa.array(best.astype(np.int32)), pa.nulls(part.num_rows, pa.int32())], names=["word", "bucket", "n", "class", "cell"])
        some = np.flatnonzero(cells)
        none = pa.nulls(len(some), pa.int32())
        yield pa.record_batch([pa.nulls(len(some), pa.string()), none, pa.array(cells.reshape(-1)[some].astype(np.int64)), none, pa.array(some.astype(np.int32))], names=["word", "bucket", "n", "class", "cell"])

    ship(docs.sparkSession)
    return contexts(docs, known, classes, k).mapInArrow(choose, "word string, bucket int, n long, class int, cell int")


def learn(docs: DataFrame, counts: DataFrame, n_docs: int, k: int = CLASSES, rounds: int = ROUNDS, item_share: float = ITEM_SHARE) -> tuple[ClassModel, DataFrame]:
    """Clusters the words of ``docs`` and estimates the model; the second result has the words that are no items, with bucket, n and class."""
    known = vocabulary(counts, n_docs, item_share, HEAD_SHARE)
    frequency = known.item_counts()
    classes = np.zeros(known.size, np.int64)
    order = np.argsort(-frequency[1:], kind="stable") + 1
    classes[order] = 1 + np.arange(len(order)) % (k - 1)
    history: list[float] = []
    with Written(item_bigrams(docs, known), "bigrams") as bigrams:
        left, right = _contexts(bigrams, classes, k)
        history.append(likelihood(class_bigrams(left, classes, k)))
        for _ in range(rounds):
            moved = exchange(left, right, classes, k)
            new_left, new_right = _contexts(bigrams, moved, k)
            reached = likelihood(class_bigrams(new_left, moved, k))
            if reached <= history[-1]:
                break
            classes, left, right = moved, new_left, new_right
            history.append(reached)
        # Bigrams of which neither word is rare; all others are in the rare words' contexts.
        both = (F.col("pair") / known.size < 1 + known.n_items) & (F.col("pair") % known.size < 1 + known.n_items)
        plain = _contexts(bigrams.where(both), classes, k)[0]
    found = cut(assigned(docs, known, classes, class_bigrams(left, classes, k), k))
    rare = found.where("word is not null").drop("cell")
    width = k + len(known.bucket_tokens)
    cells = np.zeros(2 * k * width)
    for r in found.where("word is null").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r["cell"]] = r["n"]
    before, after = cells.reshape(2, k, width)
    # Tokens and words by ending and class: at most BUCKETS times classes rows.
    tokens, words = np.zeros((len(known.bucket_tokens), k)), np.zeros(k)
    for r in rare.groupBy("bucket", "class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["bucket"], r["class"]] = r["n"]
        words[r["class"]] += r["v"]
    unknown = np.where(tokens.sum(1) > 0, tokens.argmax(1), classes[1 + known.n_items :])
    share = tokens / np.maximum(tokens.sum(1, keepdims=True), 1)
    spread = np.vstack([np.eye(k), share])
    c = class_bigrams(plain, classes, k) + (before @ spread).T
    c += after[:, :k]
    own = classes[: 1 + known.n_items]
    mass = np.bincount(own, weights=frequency[: 1 + known.n_items], minlength=k) + tokens.sum(0)
    size = np.bincount(own, minlength=k) + words + np.bincount(unknown, minlength=k)
    unigram = (c.sum(0) + D * (size > 0)) / max(1e-9, c.sum() + D * (size > 0).sum())
    transition = np.log10(np.maximum((c + T * unigram) / (c.sum(1)[:, None] + T), 1e-300))
    head = dict(rare.where(F.col("n") >= known.least).select("word", "class").toPandas().itertuples(index=False, name=None))
    head_classes = np.concatenate([classes[1 : 1 + known.n_items], [head.get(w, 0) for w in known.words[known.n_items :].to_pylist()]]).astype(np.int64)
    return ClassModel(known, classes, head_classes, unknown, transition - np.log10(np.maximum(mass + D * size, 1e-300)), history), rare


_PARTS = "word string, _row long, doc_id long, held_out boolean, pos int, before int, after int, own int, n_tokens long, n_known long, counts double, steps double"


def _parts(docs: DataFrame, model: ClassModel) -> DataFrame:
    """Per text, what the broadcast words give (one row, pos -1), and every token of the tail with the classes
    around it (-1: the neighbour is such a token too) and the class it has if unknown."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (id_crc() % 10 == 0).alias("held_out")).withColumn("_row", F.monotonically_increasing_id())
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    schema = pa.schema([(c.split()[0], kind) for c, kind in zip(_PARTS.split(", "), kinds, strict=True)])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m, n = shared.value, batch.num_rows
        known = m.known
        items, owner, which, place, distinct = _sequence(filled(batch.column(1), lower=True), known)
        log_head = np.log10(np.concatenate([known.counts, [known.ends, 0]]) + D)
        spot = np.where(which >= 0, place[which] if len(place) else -1, len(known.counts))  # ends follow the head words
        in_head = spot >= 0
        count = np.where(in_head, log_head[np.maximum(spot, 0)], 0.0)
        class_of = np.where(in_head, np.append(m.head_classes, [END, END])[np.maximum(spot, 0)], -1)
        before = np.concatenate([[END], class_of[:-1]])
        step = np.where(in_head & (before >= 0), m.step[before, class_of], 0.0)
        rows = batch.column(3).to_numpy()
        main = [
            pa.array([f"\n{r}" for r in rows.tolist()], pa.string()),
            batch.column(3),
            batch.column(0),
            batch.column(2),
            pa.array(np.full(n, -1, np.int32)),
            *(pa.nulls(n, pa.int32()) for _ in range(3)),
            pa.array(np.bincount(owner, minlength=n)),
            pa.array(np.bincount(owner, weights=in_head & (count > np.log10(D)), minlength=n).astype(np.int64)),
            pa.array(np.bincount(owner, weights=count, minlength=n)),
            pa.array(np.bincount(owner, weights=step, minlength=n)),
        ]
        yield pa.record_batch(main, schema=schema)
        tail = np.flatnonzero(~in_head)
        for start in range(0, len(tail), 1 << 16):
            at = tail[start : start + (1 << 16)]
            size = len(at)
            yield pa.record_batch(
                [
                    distinct.take(pa.array(which[at])),
                    pa.array(rows[owner[at]]),
                    pa.nulls(size, pa.int64()),
                    pa.nulls(size, pa.bool_()),
                    *(pa.array(x.astype(np.int32)) for x in (at, before[at], class_of[at + 1], m.unknown[items[at] - 1 - known.n_items])),
                    *(pa.nulls(size, t) for t in kinds[8:]),
                ],
                schema=schema,
            )

    return map_pieces(keyed, work, _PARTS)


def score(docs: DataFrame, k: int = CLASSES, rounds: int = ROUNDS, item_share: float = ITEM_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    spark = docs.sparkSession
    taught = training(docs)
    counts = cut(word_counts(taught))
    model, rare = learn(taught, counts, taught.count(), k, rounds, item_share)
    known = model.known
    tail = rare.where(F.col("n") < known.least).select("word", F.col("n").alias("c"), "class")
    steps = spark.createDataFrame([(int(a * k + b), float(model.step[a, b])) for a in range(k) for b in range(k)], "pair int, step double")
    token = F.col("pos") >= 0
    joined = _parts(docs, model).join(tail, "word", "left").withColumn("own", F.coalesce("class", "own"))
    # A neighbour of the tail is the row before, of the same text.
    before = F.when(F.col("before") >= 0, F.col("before")).otherwise(F.lag("own").over(Window.partitionBy("_row").orderBy("pos")))
    walked = joined.withColumn("into", F.when(token, before * k + F.col("own"))).withColumn("out_of", F.when(token & (F.col("after") >= 0), F.col("own") * k + F.col("after")))
    for pair in ("into", "out_of"):
        # As many rows as pairs of classes.
        walked = walked.join(F.broadcast(steps.select(F.col("pair").alias(pair), F.col("step").alias(f"{pair}_step"))), pair, "left")
    log_count = F.when(token, F.log10(F.coalesce("c", F.lit(0)) + D)).otherwise(0.0)
    summed = walked.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("n_known", F.lit(0))) + F.count("c")).alias("n_known"),
        F.sum(F.coalesce("counts", F.lit(0.0)) + log_count).alias("counts"),
        F.sum(F.coalesce("steps", F.lit(0.0)) + F.coalesce("into_step", F.lit(0.0)) + F.coalesce("out_of_step", F.lit(0.0))).alias("steps"),
    )
    score = F.col("counts") + F.col("steps")
    norm = float(np.log10(known.tokens + D * (known.distinct + 1)))
    return summed.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("counts") - F.col("n_tokens") * norm).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
