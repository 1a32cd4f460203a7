"""Snapshot-graph operators over ``edges(child, parent)``.

Closures run as frontier joins: each step joins the frontier to the edges and drops
what was seen. Many starts share the same steps, so a batch costs as many joins as
its longest path. Visits keep their first, smallest depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AmbiguousRef, MultipleBases, NoCommonHistory, NotAncestor, NotFound
from ..lineage import cut


def edges_of(snapshots: DataFrame) -> DataFrame:
    """child, parent and the parent's place (after sorting)."""
    return snapshots.select(F.col("addr").alias("child"), F.posexplode(F.array_sort("parents")).alias("ord", "parent"))


def closure(edges: DataFrame, starts: DataFrame, every: int = 4) -> DataFrame:
    """(start, node, depth) of all nodes reachable from each start, itself included."""
    steps = edges.select(F.col("child").alias("node"), "parent")
    frontier = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    seen, depth = frontier, 0
    while True:
        depth += 1
        reached = frontier.join(steps, "node").select("start", F.col("parent").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % every == 0:
            seen = cut(seen)


def reachable(edges: DataFrame, heads: list[str]) -> DataFrame:
    """(node, depth) from several heads; the depth is the smallest over the heads."""
    spark = edges.sparkSession
    starts = spark.createDataFrame([(h,) for h in heads], "start string")
    return multi_source_depths(edges, starts)


def multi_source_depths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, depth): breadth-first over all starts at once."""
    steps = edges.select(F.col("child").alias("node"), "parent")
    frontier = cut(starts.select(F.col("start").alias("node")).distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while True:
        depth += 1
        frontier = cut(frontier.join(steps, "node").select(F.col("parent").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier)) if depth % 4 == 0 else seen.unionByName(frontier)


def first_parent_log(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth) along first parents (the least address after sorting); a cycle ends the walk."""
    first = edges.groupBy("child").agg(F.min("parent").alias("parent"))
    return closure(first, starts)


def is_ancestor(edges: DataFrame, ancestor: str | None, of: str) -> bool:
    """Whether ``ancestor`` is reachable from ``of``, inclusively; no snapshot is everyone's ancestor."""
    return ancestor is None or not reachable(edges, [of]).where(F.col("node") == ancestor).isEmpty()


def have_common_ancestor(edges: DataFrame, a: str, b: str) -> bool:
    return not reachable(edges, [a]).join(reachable(edges, [b]).select("node"), "node", "left_semi").isEmpty()


def merge_bases(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, base) for every pair: common ancestors that no other common ancestor of the pair reaches."""
    named = pairs.select("a", "b").distinct()
    reached = closure(edges, named.select(F.col("a").alias("start")).unionByName(named.select(F.col("b").alias("start"))))
    reached = reached.select("start", "node")
    common = named.join(reached.withColumnRenamed("start", "a"), "a").join(reached.withColumnRenamed("start", "b"), ["b", "node"]).select("a", "b", "node")
    common = cut(common)
    # A common ancestor is no base if it is a parent of another: common ancestors are closed under parents.
    worse = common.join(edges.select(F.col("child").alias("node"), "parent"), "node").select("a", "b", F.col("parent").alias("node")).distinct()
    return common.join(worse, ["a", "b", "node"], "left_anti").withColumnRenamed("node", "base")


def merge_base(edges: DataFrame, ours: str, theirs: str, explicit: str | None = None) -> str:
    """The one merge base; an explicit one must be among the candidates."""
    pairs = edges.sparkSession.createDataFrame([(ours, theirs)], "a string, b string")
    found = sorted(r["base"] for r in merge_bases(edges, pairs).collect())
    if not found:
        raise NoCommonHistory("no common ancestor")
    if explicit is not None:
        if explicit not in found:
            raise NotFound(f"{explicit} is no merge base")
        return explicit
    if len(found) > 1:
        raise MultipleBases(found)
    return found[0]


def abandoned_count(edges: DataFrame, head: str, target: str) -> int:
    """Snapshots that are lost when the head goes back to ``target``, which must be an ancestor."""
    from_head = reachable(edges, [head])
    if from_head.where(F.col("node") == target).isEmpty():
        raise NotAncestor(f"{target} is no ancestor of {head}")
    return from_head.join(reachable(edges, [target]).select("node"), "node", "left_anti").count()


def by_prefix(nodes: DataFrame, prefix: str) -> str:
    """The only node whose address starts with ``prefix``."""
    found = [r["node"] for r in nodes.where(F.col("node").startswith(prefix)).select("node").distinct().limit(2).collect()]
    if not found:
        raise NotFound(f"no snapshot {prefix!r}")
    if len(found) > 1:
        raise AmbiguousRef(f"{prefix!r} names several snapshots")
    return found[0]
