"""Queries over a long stored history: the events as snapshots of one library.

Each event is a snapshot: every fifth one stands on a side line of its own, which the next one
merges; all others follow one another. The history is as long as the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_dir
from ..operators import lines
from ..sources.warehouse import Warehouse
from .corpus import table
from .library import stamped

SIDE = "event_id > 0 AND event_id % 5 = 0"


def _name(kind: str, number: Column) -> Column:
    return F.concat(F.lit(kind), F.lpad(number.cast("string"), 12, "0"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored snapshots; made once per session and state of the table."""
    known = spark.sparkContext.__dict__.setdefault("_marlstone_histories", {})
    key = stamped(spark, sf_dir, "events")
    if key not in known:
        number = F.col("event_id")
        side = F.expr(SIDE)
        own = F.when(side, _name("s", number)).otherwise(_name("m", number))
        after_side = (number > 1) & ((number - 1) % 5 == 0)
        parents = F.when(number == 0, F.array().cast("array<string>")).when(after_side, F.array(_name("m", number - 2), _name("s", number - 1))).otherwise(F.array(_name("m", number - 1)))
        snapshots = table(spark, sf_dir, "events").select(own.alias("addr"), parents.alias("parents"), F.unix_timestamp("ts").alias("time"), F.col("event_type").alias("message"))
        store = Warehouse(spark, f"{shared_dir(spark).rstrip('/')}/history-{key[-1]}")
        if not store.manifest().segments["snapshots"]:
            rest = {"root": F.lit("").alias("root"), "base": F.lit(None).cast("string").alias("base"), "chain": F.lit(0).alias("chain"), "indexed": F.lit(False).alias("indexed"), "vectors": F.lit(None).cast("string").alias("vectors")}
            store.append("snapshots", lines.labelled(snapshots.select("*", *rest.values())))
        known[key] = store
    return known[key].relation("snapshots")


def _newest(nodes: DataFrame) -> DataFrame:
    return nodes.where("addr LIKE 'm%'").agg(F.max("addr").alias("start"))


def history_log(spark, sf_dir):
    """First parents of the newest snapshot, back to the first one."""
    nodes = history(spark, sf_dir)
    return lines.log(nodes, _newest(nodes)).select("addr", F.col("depth").cast("long").alias("depth"))


def history_depths(spark, sf_dir):
    """How far every snapshot is from the newest one."""
    nodes = history(spark, sf_dir)
    return lines.depths(nodes, _newest(nodes)).select("addr", F.col("depth").cast("long").alias("depth"))


def _heads(nodes: DataFrame) -> DataFrame:
    last = lambda kind: F.max(F.when(F.col("addr").startswith(kind), F.col("addr")))
    return nodes.groupBy("message").agg(last("m").alias("a"), last("s").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def history_merge_bases(spark, sf_dir):
    """Where the newest snapshots of each type of event, one of either line, meet."""
    nodes = history(spark, sf_dir)
    heads = _heads(nodes)
    return lines.merge_bases(nodes, heads).join(heads, ["a", "b"]).select("message", "a", "b", "base")


def history_reach(spark, sf_dir):
    """How many snapshots the newest one of each type reaches; counted without reading them."""
    nodes = history(spark, sf_dir)
    heads = _heads(nodes).select("message", F.col("a").alias("start"))
    return lines.count(lines.closure(nodes, heads)).join(heads, "start").select("message", "start", "n")


_NODES = f"nodes AS (SELECT event_id AS i, event_type AS message, {SIDE} AS side, CASE WHEN {SIDE} THEN 's' ELSE 'm' END || lpad(CAST(event_id AS VARCHAR), 12, '0') AS addr FROM events)"
_MAIN = "main AS (SELECT i, addr, row_number() OVER (ORDER BY i DESC) - 1 AS depth FROM nodes WHERE NOT side)"
_LAST = "last AS (SELECT message, max(i) FILTER (WHERE NOT side) AS m, max(i) FILTER (WHERE side) AS s, max(addr) FILTER (WHERE NOT side) AS a, max(addr) FILTER (WHERE side) AS b FROM nodes GROUP BY message)"

SQL = {
    "history_log": f"WITH {_NODES}, {_MAIN} SELECT addr, depth FROM main",
    "history_depths": f"WITH {_NODES}, {_MAIN} SELECT addr, depth FROM main UNION ALL SELECT n.addr, m.depth + 1 FROM nodes n JOIN main m ON m.i = n.i + 1 WHERE n.side",
    "history_merge_bases": f"WITH {_NODES}, {_LAST} SELECT message, a, b, CASE WHEN m > s THEN b ELSE a END AS base FROM last WHERE a IS NOT NULL AND b IS NOT NULL",
    "history_reach": f"WITH {_NODES}, {_LAST} SELECT message, a AS start, m + 1 AS n FROM last WHERE a IS NOT NULL AND b IS NOT NULL",
}

QUERIES = {n: globals()[n] for n in SQL}
