"""Inverted index and ranked retrieval.

An index is two relations, keyed by path (so notes with equal content at several paths
are all found): ``postings(term, path, addr, tf_title, tf_tags, tf_body)``, stored by the
term's bucket, and ``docs(path, addr, len)``. Field counts stay apart, so weights can change without
indexing anew.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import bm25, bucket, cosine, rrf, tags_or_empty, tokens, weighted
from ..functions.snippet import query_terms
from ..functions.snippet import snippet as render
from ..lineage import cut

#: Depth of each leg of a hybrid search.
LEG = 50
#: Queries of a batch up to this many (query, term) rows are broadcast.
BROADCAST_TERMS = 100_000
#: Numbers in a block of vectors (2 MB), and in all unfinished blocks of a task (64 MB).
BLOCK_CELLS, HELD_CELLS = 1 << 18, 1 << 23


def terms(notes: DataFrame, together: bool = False) -> DataFrame:
    """path, addr and term with its count in title, tags and body; each tag is cut by itself.

    Notes are dealt by path before they are cut into words, so that terms are counted where they are: a note's text is
    sent once, not a path and an address with each of its terms. ``together``: a join on the address has dealt them.
    """
    notes = notes.select("path", "addr", "title", "tags", "body")
    notes = notes if together else notes.repartition("path")
    fields = F.array(
        F.struct(F.lit(0).alias("field"), tokens("title").alias("tokens")),
        F.struct(F.lit(1).alias("field"), F.flatten(F.transform(tags_or_empty("tags"), tokens)).alias("tokens")),
        F.struct(F.lit(2).alias("field"), tokens("body").alias("tokens")),
    )
    rows = notes.select("path", "addr", F.inline(fields)).select("path", "addr", "field", F.explode("tokens").alias("term"))
    count = lambda i: F.count(F.when(F.col("field") == i, 1))
    return rows.groupBy("path", "addr", "term").agg(count(0).alias("tf_title"), count(1).alias("tf_tags"), count(2).alias("tf_body"))


def full_build(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and docs of ``notes(path, addr, title, tags, body)``."""
    return postings_of(notes), docs_of(notes)


def postings_of(notes: DataFrame, together: bool = False) -> DataFrame:
    return terms(notes, together).select("term", "path", "addr", "tf_title", "tf_tags", "tf_body")


def bucketed(postings: DataFrame) -> DataFrame:
    """Postings with their bucket, as they are stored: the partition that a query's terms select."""
    return postings.withColumn("bucket", bucket("term"))


def docs_from(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same as ``docs_of`` the notes of ``pairs(path, addr)``, from their postings; a note without terms has length 0."""
    lens = postings.groupBy("path", "addr").agg(F.sum(weighted("tf_title", "tf_tags", "tf_body")).cast("long").alias("len"))
    return pairs.select("path", "addr").join(lens, ["path", "addr"], "left").select("path", "addr", F.coalesce("len", F.lit(0).cast("long")).alias("len"))


def docs_of(notes: DataFrame) -> DataFrame:
    """Weighted lengths, straight from the token arrays: no shuffle."""
    n_tags = F.aggregate(F.transform(tags_or_empty("tags"), lambda t: F.size(tokens(t))), F.lit(0), lambda s, x: s + x)
    return notes.select("path", "addr", weighted(F.size(tokens("title")), n_tags, F.size(tokens("body"))).cast("long").alias("len"))


def apply_delta(postings: DataFrame, docs: DataFrame, removed: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index after a change: rows of ``removed(path)`` and of changed notes go, the changed notes' rows come."""
    gone = removed.select("path").unionByName(changed.select("path")).distinct()
    new_postings, new_docs = full_build(changed)
    keep = lambda rows: rows.join(gone, "path", "left_anti").select(*rows.columns)
    return keep(postings).unionByName(new_postings), keep(docs).unionByName(new_docs)


def touched_buckets(postings: DataFrame, removed: DataFrame, changed: DataFrame) -> DataFrame:
    """Buckets whose rows change, so that only they are written anew."""
    gone = removed.select("path").unionByName(changed.select("path")).distinct()
    rows = postings.join(gone, "path", "left_semi").select("term").unionByName(postings_of(changed).select("term")).distinct()
    return bucketed(rows).select("bucket").distinct()


def term_statistics(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """term, df and idf."""
    n = docs.agg(F.count("*").alias("n"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_table(queries: DataFrame) -> DataFrame:
    """(qid, term) of ``queries(qid, query)``, each term once per query."""
    return queries.select("qid", F.explode(F.array_distinct(tokens("query"))).alias("term"))


def scores(postings: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """BM25 (qid, path, addr, score) of every note that holds a term of a query."""
    some = F.broadcast if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else lambda rows: rows
    corpus = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))  # one row
    # Read twice, for the terms' frequencies and for the scores: made again from what is dealt by path, since keeping a path
    # and an address for every term takes many times the texts' room.
    hits = postings.drop("bucket").join(some(wanted.select("term").distinct()), "term", "left_semi")
    # With few terms their frequencies are broadcast too: no join shuffles by term, so a frequent one is no hot key.
    asked = some(wanted.join(hits.groupBy("term").agg(F.count("*").alias("df")), "term"))
    tf = weighted("tf_title", "tf_tags", "tf_body")
    found = hits.join(docs.select("path", "len"), "path").crossJoin(F.broadcast(corpus)).join(asked, "term")
    part = bm25(tf, F.col("df"), F.col("n"), F.col("len"), F.col("avg_len"))
    # Rounded, so that the order of summing can't decide between equal scores.
    return found.groupBy("qid", "path", "addr").agg(F.round(F.sum(part), 9).alias("score"))


def top(rows: DataFrame, k: int, *order, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The first k rows of each group with their rank. Ranks are limited before the shuffle, so a large group costs k rows per task."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def search_batch(postings: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best notes of every query: score falling, then path, then address."""
    return top(scores(postings, docs, query_table(queries)), k, F.col("score").desc(), "path", "addr")


def search(postings: DataFrame, docs: DataFrame, query: str, k: int | None = None) -> DataFrame:
    """path, addr and score of one query, ordered; the query is cut on the driver, so only its buckets are read."""
    from ..functions.scalars import BUCKETS

    words = query_terms(query)
    spark = postings.sparkSession
    if not words:
        return docs.limit(0).select("path", "addr", F.lit(0.0).alias("score"))
    only = postings.where(F.col("term").isin(words))
    if "bucket" in postings.columns:  # a stored index: other buckets are not read
        only = only.where(F.col("bucket").isin(sorted({_fnv(w) % BUCKETS for w in words})))
    wanted = spark.createDataFrame([(0, w) for w in words], "qid int, term string")
    found = scores(only, docs, F.broadcast(wanted)).select("path", "addr", "score").orderBy(F.col("score").desc(), "path", "addr")
    return found if k is None else found.limit(k)


def _fnv(text: str) -> int:
    value = 2166136261
    for byte in text.encode():
        value = (value ^ byte) * 16777619 & 0xFFFFFFFF
    return value


def materialised(hits: DataFrame, notes: DataFrame, query: str | None = None) -> DataFrame:
    """Hits (after the limit) with title, tags, body and, if asked for, a snippet."""
    found = hits.join(notes.select("addr", "title", "tags", "body"), "addr")
    if query is not None:
        cut_out = F.pandas_udf(lambda bodies: bodies.map(lambda b: render(b, query)), "string")
        found = found.withColumn("snippet", cut_out("body"))
    return found


def cosine_rank(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest paths by exact cosine similarity."""
    q = F.array(*(F.lit(float(x)).cast("float") for x in query))
    return vectors.select("path", F.round(cosine("vec", q), 9).alias("sim")).orderBy(F.col("sim").desc(), "path").limit(k)


def cosine_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest paths of every query vector, exactly.

    A product of blocks: both sides are dealt into ``cells`` groups by a hash of their key, a
    group's vectors of one length are packed into blocks of at most BLOCK_CELLS numbers, and each block of queries
    meets each block of vectors once, in one join whose tasks are the pairs of groups. A pair of blocks is one matrix
    product that sends on its own k best per query, so rows grow with the pairs of blocks, not of rows, and nothing
    passes the driver. A zero vector is similar to nothing (0); null vectors, and those of another length than a
    query's, are left out.
    """
    cells = _cells(vectors.sparkSession)
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    asked = _packed(queries, "qid", cells).select("dim", F.col("own").alias("q"), every.alias("v"), F.col("keys").alias("qids"), F.col("numbers").alias("asked"))
    stored = _packed(vectors, "path", cells).select("dim", every.alias("q"), F.col("own").alias("v"), F.col("keys").alias("paths"), F.col("numbers").alias("stored"))
    pairs = asked.join(stored.hint("shuffle_merge"), ["dim", "q", "v"]).select("dim", "qids", "asked", "paths", "stored")
    schema = queries.schema["qid"].dataType.simpleString()
    near = pairs.mapInArrow(lambda batches: _nearest(batches, k), f"qid {schema}, path string, sim double")
    return top(near, k, F.col("sim").desc(), "path")


def _cells(spark: SparkSession) -> int:
    """Groups of either side: their pairs are about as many as shuffle partitions. Each block is sent that many times."""
    return max(1, min(32, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))))


def _packed(rows: DataFrame, key: str, cells: int) -> DataFrame:
    """Blocks of rows ``(key, vec)``: dim, own (the group, which the key alone decides), keys in order, numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[pa.Array, np.ndarray]]] = {}
        sizes: Counter = Counter()

        def block(group: tuple[int, int]) -> pa.RecordBatch:
            parts = held.pop(group)
            sizes.pop(group)
            keys, numbers = pa.concat_arrays([p for p, _ in parts]), np.concatenate([n for _, n in parts])
            order = np.argsort(np.array(keys.to_pylist(), object), kind="stable")
            columns = [pa.array([group[0]], pa.int32()), pa.array([group[1]], pa.int32()), pa.array([keys.take(pa.array(order)).to_pylist()], pa.list_(keys.type)), pa.array([numbers[order].tobytes()], pa.binary())]
            return pa.record_batch(columns, names=["dim", "own", "keys", "numbers"])

        for batch in batches:
            length = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            own = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(length):
                step = max(1, BLOCK_CELLS // max(1, int(dim)))
                for cell in np.unique(own[length == dim]):
                    group, at = (int(dim), int(cell)), np.flatnonzero((length == dim) & (own == cell))
                    while len(at):
                        some, at = np.split(at, [step - sizes[group]])
                        part = batch.take(pa.array(some))
                        numbers = pc.list_flatten(part.column(1)).to_numpy(zero_copy_only=False).astype("<f8").reshape(len(some), int(dim))
                        held.setdefault(group, []).append((part.column(0), numbers))
                        sizes[group] += len(some)
                        if sizes[group] >= step:
                            yield block(group)
            while sum(n * dim for (dim, _), n in sizes.items()) > HELD_CELLS:
                yield block(max(sizes, key=lambda g: sizes[g] * g[0]))
        for group in list(held):
            yield block(group)

    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.where("vec is not null").select(key, "vec", F.pmod(F.xxhash64(key), F.lit(cells)).cast("int").alias("own"))
    return dealt.mapInArrow(work, f"dim int, own int, keys array<{kind}>, numbers binary")


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query within its pair of blocks; ties by path, in which blocks are sorted."""
    for batch in batches:
        for i in range(batch.num_rows):
            dim, qids, asked, paths, stored = (c[i] for c in batch.columns)
            qids, paths, dim = qids.values, paths.values, dim.as_py()
            q, v = (np.frombuffer(x.as_buffer(), "<f8").reshape(n, dim) for x, n in ((asked, len(qids)), (stored, len(paths))))
            size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))
            sim = np.round(np.divide(q @ v.T, size, out=np.zeros(size.shape), where=size > 0), 9)
            if k < len(paths):
                query, at = np.nonzero(sim >= np.partition(sim, -k, axis=1)[:, -k, None])
            else:
                query, at = (x.ravel() for x in np.indices(sim.shape))
            order = np.lexsort((at, -sim[query, at], query))
            query, at = query[order], at[order]
            start = np.searchsorted(query, np.arange(len(qids)))
            best = np.arange(len(query)) - start[query] < k
            query, at = query[best], at[best]
            yield pa.record_batch([qids.take(pa.array(query)), paths.take(pa.array(at)), pa.array(sim[query, at])], names=["qid", "path", "sim"])


def fused(lexical: DataFrame, semantic: DataFrame, leg: int = LEG) -> DataFrame:
    """Reciprocal-rank fusion of two ranked legs ``(qid, path, rank)``: qid, path, score."""
    legs = lexical.where(F.col("rank") <= leg).select("qid", "path", rrf("rank").alias("part")).unionByName(semantic.where(F.col("rank") <= leg).select("qid", "path", rrf("rank").alias("part")))
    return legs.groupBy("qid", "path").agg(F.round(F.sum("part"), 12).alias("score"))
