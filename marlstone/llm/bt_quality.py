"""Quality classifier: Bradley-Terry pairwise ranking.

Features describe a text's characters and repetition, never its language,
source, identifier or labels. From preference pairs (a good document over a
bad one) the scores' weights are learned by logistic loss on feature
differences. The cut between good and bad is a quantile of the training
scores: the share of bad documents among the training labels.

The training set is a bounded, documented sample (``TRAIN_ROWS`` labelled
documents, ``PAIRS`` pairs); every document is scored.

Defined results: null and empty texts get the features of an empty text and
are scored; labels without a document, without a value or with a null
identifier are ignored, repeated labels count by their largest value, and of
documents with one identifier the one with the least features is learned from;
without both classes every score is 0.5; very long texts are read whole; extra columns
are ignored by ``score`` and carried by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, id_crc, map_pieces, pieces, split_words

TRAIN_ROWS, PAIRS, RIDGE, SEED = 20_000, 200_000, 1e-3, 7

FEATURES = ("upper", "digit", "space", "comma_stop", "mark", "symbol", "high", "line", "word_length", "distinct", "repeat", "symbol_word", "upper_word", "stop_word", "log_words", "short")

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _SYMBOL, _HIGH, _LINE = range(9)


def _byte_classes() -> np.ndarray:
    classes = np.full(256, _SYMBOL, np.uint8)
    classes[ord("a") : ord("z") + 1], classes[ord("A") : ord("Z") + 1], classes[ord("0") : ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    classes[[9, 11, 12, 13, 32]], classes[10], classes[128:] = _SPACE, _LINE, _HIGH
    classes[[ord(c) for c in ".,"]], classes[[ord(c) for c in "!?:;'\"()-"]] = _STOP, _MARK
    return classes


_CLASSES = _byte_classes()


def _class_counts(raw: bytes, step: int = 1 << 20) -> np.ndarray:
    """Bytes of each class, counted in steps so that a long text needs no large array."""
    data, total = np.frombuffer(raw, np.uint8), np.zeros(9, np.int64)
    for start in range(0, len(data), step):
        total += np.bincount(_CLASSES[data[start : start + step]], minlength=9)
    return total


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; shares are of bytes or of words."""
    n = len(texts)
    raw = texts.cast(pa.binary()).to_pylist()
    lengths = np.fromiter((len(r) for r in raw), np.int64, n)
    by_class = np.array([_class_counts(r) for r in raw]).reshape(n, 9)
    share = by_class / np.maximum(lengths, 1)[:, None]
    words, at = split_words(texts)
    count = np.bincount(at, minlength=n)
    some = np.maximum(count, 1)
    coded = words.dictionary_encode()
    ids, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    width = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(coded.dictionary, "[#$%&*|~^=<>@{}_\\[\\]+]|!!").to_numpy(zero_copy_only=False)
    capital = pc.and_(pc.match_substring_regex(coded.dictionary, r"^\P{Ll}*$"), pc.match_substring_regex(coded.dictionary, r"\p{Lu}")).to_numpy(zero_copy_only=False)
    ended = pc.match_substring_regex(coded.dictionary, r"[.!?]$").to_numpy(zero_copy_only=False)

    def mean(flag: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=flag[ids].astype(float), minlength=n) / some

    distinct = np.bincount(np.unique(at * size + ids) // size, minlength=n) / some**0.85
    same = np.zeros(len(ids))
    if len(ids) > 1:
        same[1:] = (ids[1:] == ids[:-1]) & (at[1:] == at[:-1])
    repeat = np.bincount(at, weights=same, minlength=n) / some
    out = np.column_stack(
        [
            share[:, _UPPER], share[:, _DIGIT], share[:, _SPACE], share[:, _STOP], share[:, _MARK], share[:, _SYMBOL], share[:, _HIGH], share[:, _LINE],
            mean(width), distinct, repeat, mean(odd), mean(capital), mean(ended), np.log1p(count), count < 3,
        ]
    )
    return out.astype(np.float64)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and one double column per feature."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = text_features(filled(batch.column(1)))
        yield pa.record_batch([batch.column(0), *(pa.array(values[:, i]) for i in range(values.shape[1]))], names=["doc_id", *FEATURES])

    return map_pieces(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Ranking:
    """Weights on standardised features and the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def probability(self) -> Column:
        """Score in 0..1 as a column expression over the feature columns."""
        total = F.lit(-self.cut)
        for name, mean, scale, weight in zip(FEATURES, self.mean, self.scale, self.weights, strict=True):
            z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(name) - F.lit(float(mean))) / F.lit(float(scale))))
            total = total + z * F.lit(float(weight))
        return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), total))))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Ranking:
    """Bradley-Terry weights by Newton steps on pairs of a good and a bad document."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(x.shape[1] if x.ndim == 2 else len(FEATURES)), 0.0)
    z, rng = np.clip((x - mean) / scale, -8, 8), np.random.default_rng(seed)
    difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ (p - 1) / pairs + RIDGE * w
        curvature = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = len(bad)  # the quantile: as many below the cut as there are bad labels
    return Ranking(mean, scale, w, float((s[k - 1] + s[min(k, len(s) - 1)]) / 2))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Ranking:
    """Learns from labelled documents whose crc32(doc_id) mod 3 is not 1, at most about ``train_rows``."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_y"))
    marked = marked.where("doc_id is not null and _y in (0, 1)").where(id_crc() % 3 != 1).groupBy("doc_id").agg(F.max("_y").alias("_y"))
    n = marked.count()
    if n > train_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    # The sample is bounded by ``train_rows`` pairs of numbers, so it is broadcast and only its texts are read on.
    sample = F.broadcast(marked)
    rows = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample.select("doc_id"), "doc_id"))
    # One row per identifier, reduced before the shuffle: however often one stands in the documents, the sample keeps its bound.
    one = rows.join(sample, "doc_id").groupBy("doc_id", "_y").agg(F.min(F.struct(*FEATURES)).alias("f")).select("doc_id", "_y", "f.*")
    got = one.toPandas().sort_values("doc_id")
    return fit(got[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), got["_y"].to_numpy(int))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    found = train(docs, labels).probability()
    return features(docs).select("doc_id", (id_crc() % 3 == 1).alias("held_out"), found.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows predicted good, with all their columns, in one pass over the texts after training."""
    ranking = train(docs, labels)  # which also ships the package
    names = docs.columns
    at = names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, at):
                good = ranking.strengths(text_features(filled(piece.column(at)))) >= ranking.cut
                yield piece.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
