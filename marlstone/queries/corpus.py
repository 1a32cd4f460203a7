"""Notes, versions and graphs derived from the driver's tables, and the same as SQL views.

path = source/lang/doc_id, title = first line, tags = lang and source, body = text. The
versions are functions of doc_id: base leaves out every 7th document; ours and theirs
delete, edit and add some more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import address

EDIT_BOTH, EDIT_THEIRS = "\nedited", "\nedited elsewhere"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """Documents over all cores: a file of one row group would be cut into words by one task. Larger tables stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() * 2 <= cores else docs


def note_address(title: Column, body: Column) -> Column:
    return address(F.concat(title, F.lit("\n"), body))


def shaped(docs: DataFrame) -> DataFrame:
    """Notes of documents ``(doc_id, text, lang, source)``."""
    slug = F.col("doc_id").cast("string")
    rows = docs.select(
        "doc_id",
        F.concat_ws("/", "source", "lang", slug).alias("path"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
        F.array("lang", "source").alias("tags"),
        F.col("text").alias("body"),
        (F.col("doc_id") + 1_700_000_000).alias("created_at"),
    )
    return rows.withColumn("addr", note_address(F.col("title"), F.col("body")))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spread(table(spark, sf_dir, "documents")))


def version(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Notes of one of the versions base, ours and theirs."""
    docs, d = spread(table(spark, sf_dir, "documents")), F.col("doc_id")
    base = d % 7 != 0
    if name == "base":
        return shaped(docs.where(base))
    if name == "ours":
        docs = docs.where((base & (d % 11 != 3)) | (d % 14 == 0))
        return shaped(docs.withColumn("text", F.when(base & (d % 5 == 1), F.concat("text", F.lit(EDIT_BOTH))).otherwise(F.col("text"))))
    docs = docs.where((base & (d % 13 != 5)) | (d % 21 == 0))
    edited = F.when(base & (d % 10 == 1), F.concat("text", F.lit(EDIT_BOTH))).when(base & (d % 10 == 6), F.concat("text", F.lit(EDIT_THEIRS))).otherwise(F.col("text"))
    return shaped(docs.withColumn("text", edited))


def _shaped_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT *, 'sha256:' || sha256(title || chr(10) || body) AS addr FROM (
      SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path, source || '/' || lang AS dir, source, lang,
             CAST(doc_id AS VARCHAR) AS slug, split_part(text, chr(10), 1) AS title, text AS body, 1700000000 + doc_id AS created_at FROM {source}))"""


NOTES_SQL = _shaped_sql("notes", "documents")
BASE_SQL = _shaped_sql("base", "(SELECT * FROM documents WHERE doc_id % 7 <> 0)")
OURS_SQL = _shaped_sql(
    "ours",
    """(SELECT doc_id, lang, source, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 1 THEN text || chr(10) || 'edited' ELSE text END AS text
        FROM documents WHERE (doc_id % 7 <> 0 AND doc_id % 11 <> 3) OR doc_id % 14 = 0)""",
)
THEIRS_SQL = _shaped_sql(
    "theirs",
    """(SELECT doc_id, lang, source, CASE WHEN doc_id % 7 <> 0 AND doc_id % 10 = 1 THEN text || chr(10) || 'edited'
               WHEN doc_id % 7 <> 0 AND doc_id % 10 = 6 THEN text || chr(10) || 'edited elsewhere' ELSE text END AS text
        FROM documents WHERE (doc_id % 7 <> 0 AND doc_id % 13 <> 5) OR doc_id % 21 = 0)""",
)

#: Directories of the notes, as (path, parent, slug, depth).
DIRS_SQL = """dirs AS (SELECT DISTINCT source AS path, '' AS parent, source AS slug, 1 AS depth FROM notes
    UNION ALL SELECT DISTINCT dir, source, lang, 2 FROM notes)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot edges from conversations: a turn's parent is the turn before; every third turn also merges two turns back."""
    turns = table(spark, sf_dir, "conversations").where("turn > 0")
    name = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    t = F.col("turn")
    parents = F.when((t % 3 == 0) & (t >= 2), F.array(t - 1, t - 2)).otherwise(F.array(t - 1))
    return turns.select(name(t).alias("child"), F.explode(parents).alias("p"), "conv_id").select("child", name(F.col("p")).alias("parent")).distinct()


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of every conversation."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return last.select("conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("start"))


GRAPH_SQL = """edges AS (SELECT DISTINCT 'c' || conv_id || '-' || turn AS child, 'c' || conv_id || '-' || p AS parent FROM (
      SELECT conv_id, turn, turn - 1 AS p FROM conversations WHERE turn > 0
      UNION ALL SELECT conv_id, turn, turn - 2 FROM conversations WHERE turn >= 2 AND turn % 3 = 0)),
    heads AS (SELECT conv_id, max(turn) AS turn, 'c' || conv_id || '-' || max(turn) AS start FROM conversations GROUP BY conv_id)"""
