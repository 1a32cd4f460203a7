"""Tokens, index, ranked search, vectors and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import bucket, tokens
from ..functions.vectors import from_base64, to_base64
from ..lineage import cut
from ..operators import search
from .corpus import BASE_SQL, NOTES_SQL, OURS_SQL, notes, spread, table, version

QUERY, LIMIT, BATCH_LIMIT = "The tion of edereding and sur laquelle", 20, 10


def tokenize_counts(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(F.explode(tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def fnv_bucket_histogram(spark, sf_dir):
    terms = spread(table(spark, sf_dir, "documents")).select(F.explode(F.array_distinct(tokens("text"))).alias("term")).distinct()
    return terms.groupBy(bucket("term").alias("bucket")).agg(F.count("*").alias("terms"))


def index_postings(spark, sf_dir):
    return search.postings_of(notes(spark, sf_dir)).select("term", "path", "tf_title", "tf_tags", "tf_body")


def index_docs(spark, sf_dir):
    return search.docs_of(notes(spark, sf_dir)).select("path", "len")


def index_delta_equals_rebuild(spark, sf_dir):
    """The base's index brought to ours by a delta; the oracle builds ours anew."""
    from ..operators.versions import diff

    base, ours = version(spark, sf_dir, "base"), version(spark, sf_dir, "ours")
    changes = diff(base.select("path", "addr"), ours.select("path", "addr"))
    changed = ours.join(changes.where("type <> 'removed'").select("path"), "path", "left_semi")
    postings, docs = search.apply_delta(*search.full_build(base), changes.where("type = 'removed'"), changed)
    per_note = postings.groupBy("path").agg(F.count("*").alias("terms"), F.sum("tf_body").alias("tokens"))
    return docs.join(per_note, "path").select("path", "len", "terms", "tokens")


def term_df_idf(spark, sf_dir):
    postings, docs = search.full_build(notes(spark, sf_dir))
    return search.term_statistics(postings, docs).select("term", "df", F.round("idf", 9).alias("idf"))


def _index(rows):
    """Postings, read once per search, and the lengths, which are read twice."""
    return search.postings_of(rows), cut(search.docs_of(rows))


def _single(rows, k=LIMIT):
    postings, docs = _index(rows)
    found = search.search(postings, docs, QUERY, k)
    return search.materialised(found, rows.select("path", "addr", "title", "tags", "body").dropDuplicates(["addr"]).drop("path")).select("path", "title", F.round("score", 6).alias("score"))


def search_bm25(spark, sf_dir):
    return _single(notes(spark, sf_dir))


def search_bm25_at_base(spark, sf_dir):
    return _single(version(spark, sf_dir, "base"))


def search_bm25_batch(spark, sf_dir):
    rows = notes(spark, sf_dir)
    postings, docs = _index(rows)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return search.search_batch(postings, docs, queries, BATCH_LIMIT).select("qid", "path", "rank", F.round("score", 6).alias("score"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("path"), F.col("embedding").alias("vec"), "vec_id")


def cosine_topk(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    query = vectors.where("vec_id = 0").head()["vec"]
    return search.cosine_rank(vectors, query, LIMIT).select("path", F.round("sim", 6).alias("sim"))


def cosine_topk_batch(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "vec")
    return search.cosine_batch(vectors, queries, BATCH_LIMIT).select("qid", "path", "rank", F.round("sim", 6).alias("sim"))


def hybrid_rrf(spark, sf_dir):
    """Both legs of depth 50, fused by path; vector i belongs to document i."""
    rows = notes(spark, sf_dir)
    postings, docs = _index(rows)
    lexical = search.search_batch(postings, docs, spark.createDataFrame([(0, QUERY)], "qid long, query string"), search.LEG)
    vectors = rows.join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("path", F.col("embedding").alias("vec"), "vec_id")
    queries = table(spark, sf_dir, "embeddings").where("vec_id = 3").select(F.lit(0).cast("long").alias("qid"), F.col("embedding").alias("vec"))
    semantic = search.cosine_batch(vectors, queries, search.LEG)
    fused = search.fused(lexical, semantic)
    return search.top(fused, LIMIT, F.col("score").desc(), "path").select("path", "rank", F.round("score", 9).alias("score"))


def snippet(spark, sf_dir):
    rows = notes(spark, sf_dir)
    postings, docs = _index(rows)
    found = search.search(postings, docs, QUERY, LIMIT)
    return search.materialised(found, rows.select("addr", "title", "tags", "body").dropDuplicates(["addr"]), QUERY).select("path", "title", "snippet")


def vec_base64_roundtrip(spark, sf_dir):
    text = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", to_base64("embedding").alias("b64"))
    return text.select("vec_id", F.length("b64").cast("long").alias("chars"), (from_base64("b64") == F.col("embedding")).alias("equal"))


_TOKENS = "regexp_extract_all(lower(replace({0}, 'İ', 'i')), '[a-z0-9]+')"


def index_sql(source: str) -> str:
    one = lambda field, text: f"SELECT path, '{field}' AS field, unnest({_TOKENS.format(text)}) AS term FROM {source}"
    return f"""tok AS ({one("title", "title")} UNION ALL {one("tags", "lang")} UNION ALL {one("tags", "source")} UNION ALL {one("body", "body")}),
    postings AS (SELECT path, term, count(*) FILTER (field = 'title') AS tf_title, count(*) FILTER (field = 'tags') AS tf_tags, count(*) FILTER (field = 'body') AS tf_body FROM tok GROUP BY path, term),
    docs AS (SELECT s.path, CAST(3 * len({_TOKENS.format("title")}) + 2 * (len({_TOKENS.format("lang")}) + len({_TOKENS.format("source")})) + len({_TOKENS.format("body")}) AS BIGINT) AS len FROM {source} s)"""


_SCORES = """corpus AS (SELECT count(*) AS n, avg(len) AS avg_len FROM docs),
    dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    scored AS (SELECT q.qid, p.path, round(sum(ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d.len / c.avg_len))), 9) AS score
        FROM (SELECT *, 3 * tf_title + 2 * tf_tags + tf_body AS tf FROM postings) p JOIN q USING (term) JOIN dfs f USING (term) JOIN docs d USING (path) CROSS JOIN corpus c GROUP BY q.qid, p.path)"""

_Q = f"q AS (SELECT DISTINCT 0 AS qid, unnest({_TOKENS.format(chr(39) + QUERY + chr(39))}) AS term)"
_QS = f"q AS (SELECT DISTINCT item_id AS qid, unnest({_TOKENS.format('text')}) AS term FROM benchmark)"


def single_sql(notes_sql: str, source: str) -> str:
    return f"WITH {notes_sql}, {index_sql(source)}, {_Q}, {_SCORES} SELECT s.path, n.title, round(s.score, 6) AS score FROM scored s JOIN {source} n USING (path) ORDER BY s.score DESC, s.path LIMIT {LIMIT}"


def batch_sql(notes_sql: str, source: str) -> str:
    return f"""WITH {notes_sql}, {index_sql(source)}, {_QS}, {_SCORES} SELECT qid, path, rank, round(score, 6) AS score FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS INTEGER) AS rank FROM scored) WHERE rank <= {BATCH_LIMIT}"""


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(term, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
_PATH = "lpad(CAST(vec_id AS VARCHAR), 8, '0')"
_SIM = "round(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 9)"

SQL = {
    "tokenize_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term",
    "fnv_bucket_histogram": f"SELECT CAST({_FNV} % 64 AS INTEGER) AS bucket, count(*) AS terms FROM (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY 1",
    "index_postings": f"WITH {NOTES_SQL}, {index_sql('notes')} SELECT term, path, tf_title, tf_tags, tf_body FROM postings",
    "index_docs": f"WITH {NOTES_SQL}, {index_sql('notes')} SELECT path, len FROM docs",
    "index_delta_equals_rebuild": f"""WITH {BASE_SQL}, {OURS_SQL}, {index_sql('ours')}
        SELECT d.path, d.len, count(*) AS terms, CAST(sum(tf_body) AS BIGINT) AS tokens FROM docs d JOIN postings p USING (path) GROUP BY d.path, d.len""",
    "term_df_idf": f"WITH {NOTES_SQL}, {index_sql('notes')}, n AS (SELECT count(*) AS n FROM docs) SELECT term, count(*) AS df, round(ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM postings, n GROUP BY term",
    "search_bm25": single_sql(NOTES_SQL, "notes"),
    "search_bm25_at_base": single_sql(BASE_SQL, "base"),
    "search_bm25_batch": batch_sql(NOTES_SQL, "notes"),
    "cosine_topk": f"""SELECT path, round(sim, 6) AS sim FROM (SELECT {_PATH} AS path, {_SIM.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS sim FROM embeddings)
        ORDER BY sim DESC, path LIMIT {LIMIT}""",
    "cosine_topk_batch": f"""SELECT qid, path, rank, round(sim, 6) AS sim FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, path) AS INTEGER) AS rank FROM (
        SELECT b.vec_id AS qid, {_PATH.replace('vec_id', 'a.vec_id')} AS path, {_SIM.format('a.embedding', 'b.embedding')} AS sim FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0)) WHERE rank <= {BATCH_LIMIT}""",
    "hybrid_rrf": f"""WITH {NOTES_SQL}, {index_sql('notes')}, {_Q}, {_SCORES},
        lexical AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS rank FROM scored),
        semantic AS (SELECT path, row_number() OVER (ORDER BY sim DESC, path) AS rank FROM (SELECT n.path, {_SIM.format('e.embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 3)')} AS sim FROM embeddings e JOIN notes n ON n.doc_id = e.vec_id)),
        fused AS (SELECT path, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT * FROM lexical WHERE rank <= 50 UNION ALL SELECT * FROM semantic WHERE rank <= 50) GROUP BY path)
        SELECT path, rank, round(score, 9) AS score FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, path) AS INTEGER) AS rank FROM fused) WHERE rank <= {LIMIT}""",
    "vec_base64_roundtrip": "SELECT vec_id, CAST(4 * ((4 * len(embedding) + 2) // 3) AS BIGINT) AS chars, true AS equal FROM embeddings",
}

QUERIES = {n: globals()[n] for n in SQL} | {"snippet": snippet}
