"""Queries over a stored library: the repository's own paths through commits, index, transfer and collection.

The library is made once per session and table folder, in the shared folder: one snapshot of the
version base, one that brings its changes to ours, one that takes away what ours lacks.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import address
from ..lineage import cut, shared_dir
from ..operators import search
from ..operators.versions import diff
from ..plans.repository import Repository
from ..schema import LINKS, EngineConfig
from .corpus import BASE_SQL, NOTES_SQL, OURS_SQL, notes, table, version
from .retrieval import BATCH_LIMIT, LIMIT, QUERY, batch_sql, index_sql, single_sql
from .trees import NOTE_JSON_SQL

START = 1_700_000_000


def _empty(spark: SparkSession) -> Repository:
    tick = itertools.count(START)
    return Repository(spark, EngineConfig(f"{shared_dir(spark).rstrip('/')}/library-{uuid.uuid4().hex}", now=lambda: next(tick)))


def stamped(spark: SparkSession, sf_dir: str, *tables: str) -> tuple[str, str]:
    """The folder, and a hash of its tables' files with their sizes and times, by which what was made from them is kept."""
    found = []
    for name in tables or ("documents", "benchmark"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        found += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files]
    return sf_dir, hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def library(spark: SparkSession, sf_dir: str) -> tuple[Repository, str]:
    """The stored library and the address of its first snapshot."""
    known = spark.sparkContext.__dict__.setdefault("_marlstone_libraries", {})
    key = stamped(spark, sf_dir)
    if key not in known:
        repo = _empty(spark)
        inputs = lambda rows: rows.select("path", "title", "body", "tags", F.lit(None).cast(LINKS).alias("links"), "created_at")
        base, ours = version(spark, sf_dir, "base"), version(spark, sf_dir, "ours")
        first = repo.bulk_import(inputs(base))
        changes = cut(diff(base.select("path", "addr"), ours.select("path", "addr")).select("path", "type"))
        repo.bulk_import(inputs(ours.join(changes.where("type <> 'removed'"), "path", "left_semi")))
        repo.remove_notes(changes.where("type = 'removed'"))
        known[key] = repo, first
    return known[key]


def _hits(found: DataFrame) -> DataFrame:
    return found.select("path", "title", F.round("score", 6).alias("score"))


def library_search(spark, sf_dir):
    return _hits(library(spark, sf_dir)[0].search(QUERY, limit=LIMIT))


def library_search_at_base(spark, sf_dir):
    """The same at the first snapshot, over the one index."""
    repo, first = library(spark, sf_dir)
    return _hits(repo.search(QUERY, ref=first, limit=LIMIT))


def library_search_batch(spark, sf_dir):
    postings, docs = library(spark, sf_dir)[0].index()
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return search.search_batch(postings, docs, queries, BATCH_LIMIT).select("qid", "path", "rank", F.round("score", 6).alias("score"))


def library_notes(spark, sf_dir):
    return library(spark, sf_dir)[0].list_notes().select("path", "title", F.array_join("tags", ",").alias("tags"), "created_at", "body", "addr")


def library_diff(spark, sf_dir):
    repo, first = library(spark, sf_dir)
    return repo.diff(first, repo.branch)


def library_pull(spark, sf_dir):
    """Entries of a library that pulled the stored one."""
    copy = _empty(spark)
    copy.pull(library(spark, sf_dir)[0])
    return copy.entries(copy.head()).select("path", "type", "depth")


def library_restore(spark, sf_dir):
    """Notes of a library that was filled from the stored one's backup, at its first snapshot."""
    repo, first = library(spark, sf_dir)
    copy = _empty(spark)
    copy.restore(repo.dump())
    return copy.leaves(first)


def library_gc(spark, sf_dir):
    """Index rows that are left when only the newest snapshot keeps its index."""
    copy = _empty(spark)
    copy.pull(library(spark, sf_dir)[0])
    copy.gc(keep_last=1)
    per_note = copy.store.relation("postings").groupBy("path", "addr").agg(F.count("*").alias("terms"), F.sum("tf_body").alias("tokens"))
    return copy.store.relation("docs").join(per_note, ["path", "addr"]).select("path", "addr", "len", "terms", "tokens")


def library_branches(spark, sf_dir):
    """Branches made, described and moved: one project per source and one branch per language."""
    store = _empty(spark).store
    rows = notes(spark, sf_dir).groupBy(F.col("tags")[1].alias("source"), F.col("tags")[0].alias("lang")).agg(F.min("path").alias("first"), F.max("path").alias("last"))
    for r in rows.select("source", "lang", address("first").alias("a"), address("last").alias("b")).orderBy("source", "lang").collect():
        store.project_create(r["source"])
        store.branch_set(r["source"], r["lang"], r["a"], None)
        store.branch_describe(r["source"], r["lang"], f"notes in {r['lang']}")
        store.branch_set(r["source"], r["lang"], r["b"], r["a"])
    return store.small("branches").select("project", "name", "addr", "description")


_ADDR = f"'sha256:' || sha256({NOTE_JSON_SQL})"
# A directory stays when its last note goes.
_DIRS_LEFT = "SELECT DISTINCT dir, 'dir', 2 FROM base UNION SELECT DISTINCT dir, 'dir', 2 FROM ours UNION SELECT DISTINCT source, 'dir', 1 FROM base UNION SELECT DISTINCT source, 'dir', 1 FROM ours"

SQL = {
    "library_search": single_sql(OURS_SQL, "ours"),
    "library_search_at_base": single_sql(BASE_SQL, "base"),
    "library_search_batch": batch_sql(OURS_SQL, "ours"),
    "library_notes": f"WITH {OURS_SQL} SELECT path, title, least(lang, source) || ',' || greatest(lang, source) AS tags, created_at, body, {_ADDR} AS addr FROM ours",
    "library_diff": f"""WITH {BASE_SQL}, {OURS_SQL}, b AS (SELECT path, {_ADDR} AS addr FROM base), o AS (SELECT path, {_ADDR} AS addr FROM ours)
        SELECT path, CASE WHEN b.addr IS NULL THEN 'added' WHEN o.addr IS NULL THEN 'removed' ELSE 'updated' END AS type, b.addr AS "from", o.addr AS "to"
        FROM b FULL JOIN o USING (path) WHERE b.addr IS DISTINCT FROM o.addr""",
    "library_pull": f"WITH {BASE_SQL}, {OURS_SQL} SELECT path, 'note' AS type, 3 AS depth FROM ours UNION ALL SELECT * FROM ({_DIRS_LEFT})",
    "library_restore": f"WITH {BASE_SQL} SELECT path, {_ADDR} AS addr FROM base",
    "library_gc": f"""WITH {OURS_SQL}, {index_sql('ours')}
        SELECT d.path, any_value({_ADDR}) AS addr, d.len, count(*) AS terms, CAST(sum(tf_body) AS BIGINT) AS tokens FROM docs d JOIN postings p USING (path) JOIN ours USING (path) GROUP BY d.path, d.len""",
    "library_branches": f"""WITH {NOTES_SQL} SELECT source AS project, lang AS name, 'sha256:' || sha256(max(path)) AS addr, 'notes in ' || lang AS description FROM notes GROUP BY source, lang""",
}

QUERIES = {n: globals()[n] for n in SQL}
