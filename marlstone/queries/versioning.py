"""Diff, stage, three-way merge and snapshot-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dag, tree, versions
from .corpus import BASE_SQL, GRAPH_SQL, OURS_SQL, THEIRS_SQL, graph, heads, version


def _leaves(spark, sf_dir, name):
    return version(spark, sf_dir, name).select("path", "addr")


def diff_base_ours(spark, sf_dir):
    return versions.diff(_leaves(spark, sf_dir, "base"), _leaves(spark, sf_dir, "ours"))


def diff_counts(spark, sf_dir):
    return diff_base_ours(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


def stage_status(spark, sf_dir):
    return versions.stage_changes(_leaves(spark, sf_dir, "base"), _leaves(spark, sf_dir, "theirs")).select("op", "path")


def stage_overlay(spark, sf_dir):
    """The changes from base to theirs, committed over ours."""
    changes = versions.stage_changes(_leaves(spark, sf_dir, "base"), _leaves(spark, sf_dir, "theirs"))
    return versions.overlay(_leaves(spark, sf_dir, "ours"), changes)


def _merged(spark, sf_dir):
    return versions.merge_leaves(*(_leaves(spark, sf_dir, n) for n in ("base", "ours", "theirs")))


def merge3_classify(spark, sf_dir):
    return _merged(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


def merge3_result(spark, sf_dir):
    return _merged(spark, sf_dir).where("addr is not null").select("path", "addr")


def merge3_conflicts(spark, sf_dir):
    c = lambda n: F.coalesce(f"{n}_addr", F.lit("")).alias(n)
    return _merged(spark, sf_dir).where("class in ('content', 'modify-delete', 'type')").select("path", F.col("class").alias("kind"), c("base"), c("ours"), c("theirs"))


def merge3_levels(spark, sf_dir):
    """Conflicts of the level-wise merge of whole trees; the leaf form must agree."""
    sides = []
    for name in ("base", "ours", "theirs"):
        sides.append(tree.tree_addresses(tree.with_dirs(_leaves(spark, sf_dir, name)))[0])
    _, conflicts, _ = versions.merge_levels(*sides)
    return conflicts


def merge_unrelated(spark, sf_dir):
    """Merge without a common base."""
    ours, theirs = _leaves(spark, sf_dir, "ours"), _leaves(spark, sf_dir, "theirs")
    return versions.merge_leaves(ours.limit(0), ours, theirs).groupBy("class").agg(F.count("*").alias("n"))


def dag_log(spark, sf_dir):
    """First-parent log of every head."""
    return dag.first_parent_log(graph(spark, sf_dir), heads(spark, sf_dir).select("start"))


def dag_ancestors(spark, sf_dir):
    return dag.closure(graph(spark, sf_dir), heads(spark, sf_dir).select("start"))


def dag_depths(spark, sf_dir):
    """Smallest depth over all heads at once."""
    return dag.multi_source_depths(graph(spark, sf_dir), heads(spark, sf_dir).select("start"))


def dag_merge_base(spark, sf_dir):
    """Bases of two turns of each conversation: the last and the one before the last but one, and the last two."""
    last = heads(spark, sf_dir).where("turn >= 3")
    name = lambda back: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    pairs = last.select(name(0).alias("a"), name(2).alias("b")).unionByName(last.select(name(1).alias("a"), name(0).alias("b")))
    return dag.merge_bases(graph(spark, sf_dir), pairs)


def dag_abandoned(spark, sf_dir):
    """How many snapshots a reset to the second turn would lose, per head."""
    edges, starts = graph(spark, sf_dir), heads(spark, sf_dir).where("turn >= 1")
    target = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-1"))
    closed = dag.closure(edges, starts.select("start")).groupBy("start").agg(F.count("*").alias("all"))
    below = dag.closure(edges, starts.select(target.alias("start"))).groupBy(F.col("start").alias("target")).agg(F.count("*").alias("kept"))
    return starts.select("start", target.alias("target")).join(closed, "start").join(below, "target").select("start", (F.col("all") - F.col("kept")).alias("abandoned"))


_ALL = f"WITH {BASE_SQL}, {OURS_SQL}, {THEIRS_SQL}"
_MERGED = f"""{_ALL}, sides AS (SELECT coalesce(b.path, o.path, t.path) AS path, b.addr AS base, o.addr AS ours, t.addr AS theirs
    FROM base b FULL OUTER JOIN ours o ON o.path = b.path FULL OUTER JOIN theirs t ON t.path = coalesce(b.path, o.path)),
  merged AS (SELECT *, CASE WHEN ours IS NOT DISTINCT FROM theirs THEN CASE WHEN ours IS NOT DISTINCT FROM base THEN 'unchanged' ELSE 'same' END
      WHEN theirs IS NOT DISTINCT FROM base THEN 'ours' WHEN ours IS NOT DISTINCT FROM base THEN 'theirs'
      WHEN ours IS NULL OR theirs IS NULL THEN 'modify-delete' ELSE 'content' END AS class FROM sides)"""
_CONFLICTS = _MERGED + " SELECT path, class AS kind, coalesce(base, '') AS base, coalesce(ours, '') AS ours, coalesce(theirs, '') AS theirs FROM merged WHERE class IN ('content', 'modify-delete')"


def _diff_sql(a: str, b: str, names: tuple[str, str, str]) -> str:
    return f"""SELECT coalesce(x.path, y.path) AS path, CASE WHEN x.addr IS NULL THEN '{names[0]}' WHEN y.addr IS NULL THEN '{names[1]}' ELSE '{names[2]}' END AS type, x.addr AS "from", y.addr AS "to"
        FROM {a} x FULL OUTER JOIN {b} y ON x.path = y.path WHERE x.addr IS DISTINCT FROM y.addr"""


_WALK = f"""WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT start, start AS node, 0 AS depth FROM heads
    UNION SELECT w.start, e.parent, w.depth + 1 FROM walk w JOIN {{0}} e ON e.child = w.node)"""

SQL = {
    "diff_base_ours": f"{_ALL} {_diff_sql('base', 'ours', ('added', 'removed', 'updated'))}",
    "diff_counts": f"{_ALL} SELECT type, count(*) AS n FROM ({_diff_sql('base', 'ours', ('added', 'removed', 'updated'))}) GROUP BY type",
    "stage_status": f"{_ALL} SELECT type AS op, path FROM ({_diff_sql('base', 'theirs', ('A', 'D', 'M'))})",
    "stage_overlay": f"""{_ALL}, ch AS ({_diff_sql('base', 'theirs', ('A', 'D', 'M'))})
        SELECT path, addr FROM ours WHERE path NOT IN (SELECT path FROM ch) UNION ALL SELECT path, "to" FROM ch WHERE type <> 'D'""",
    "merge3_classify": _MERGED + " SELECT class, count(*) AS n FROM merged GROUP BY class",
    "merge3_result": _MERGED + " SELECT path, addr FROM (SELECT path, CASE WHEN class = 'theirs' THEN theirs ELSE ours END AS addr FROM merged) WHERE addr IS NOT NULL",
    "merge3_conflicts": _CONFLICTS,
    "merge3_levels": _CONFLICTS,
    "merge_unrelated": f"""{_ALL} SELECT class, count(*) AS n FROM (SELECT CASE WHEN o.addr = t.addr THEN 'same' WHEN t.addr IS NULL THEN 'ours' WHEN o.addr IS NULL THEN 'theirs' ELSE 'content' END AS class
        FROM ours o FULL OUTER JOIN theirs t ON o.path = t.path) GROUP BY class""",
    "dag_log": _WALK.format("(SELECT child, min(parent) AS parent FROM edges GROUP BY child)") + " SELECT start, node, depth FROM walk",
    "dag_ancestors": _WALK.format("edges") + " SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node",
    "dag_depths": _WALK.format("edges") + " SELECT node, min(depth) AS depth FROM walk GROUP BY node",
    "dag_merge_base": f"""WITH RECURSIVE {GRAPH_SQL},
        pairs AS (SELECT DISTINCT a, b FROM (SELECT 'c' || conv_id || '-' || turn AS a, 'c' || conv_id || '-' || (turn - 2) AS b FROM heads WHERE turn >= 3
                  UNION ALL SELECT 'c' || conv_id || '-' || (turn - 1), 'c' || conv_id || '-' || turn FROM heads WHERE turn >= 3)),
        walk AS (SELECT a AS start, a AS node FROM pairs UNION SELECT b, b FROM pairs UNION SELECT w.start, e.parent FROM walk w JOIN edges e ON e.child = w.node),
        common AS (SELECT p.a, p.b, x.node FROM pairs p JOIN walk x ON x.start = p.a JOIN walk y ON y.start = p.b AND y.node = x.node),
        up AS (SELECT DISTINCT node AS start, node FROM common UNION SELECT u.start, e.parent FROM up u JOIN edges e ON e.child = u.node)
        SELECT a, b, node AS base FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN up u ON u.start = d.node AND u.node = c.node WHERE d.a = c.a AND d.b = c.b AND d.node <> c.node)""",
    "dag_abandoned": f"""WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT start, start AS node FROM heads WHERE turn >= 1 UNION SELECT w.start, e.parent FROM walk w JOIN edges e ON e.child = w.node)
        SELECT h.start, count(*) - 2 AS abandoned FROM heads h JOIN walk w ON w.start = h.start WHERE h.turn >= 1 GROUP BY h.start""",
}

QUERIES = {n: globals()[n] for n in SQL}
