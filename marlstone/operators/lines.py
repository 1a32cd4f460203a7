"""The snapshot graph as lines: long histories without a step per generation.

Every snapshot has a place on a line: a chain of snapshots of which each has the one
before it as first parent. ``ups`` are the coordinates of those parents that aren't its
line's one before. Whatever is reachable from a snapshot is then a beginning of some
lines, so a closure is one row (line, place) per line; it is found by joins over the
few edges between lines, and costs as many rounds as paths change lines, however long
the lines are. First-parent logs double their jumps from line to line.

Relations: ``nodes(addr, line, place, ups)``; a closure ``(start, line, place)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..errors import MultipleBases, NoCommonHistory, NotFound
from ..lineage import counted, cut

UPS = "array<struct<line: string, place: long>>"


def labelled(snapshots: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``snapshots(addr, parents, ...)`` with line, place and ups made anew; ``known`` nodes keep theirs.

    A line goes on with the least child that has its end as first parent. Places come by pointer
    jumping, in as many rounds as the logarithm of the longest line. Parents that aren't there have no edge.
    """
    rows = snapshots.drop("line", "place", "ups")
    edges = rows.select("addr", F.posexplode(F.array_sort("parents")).alias("ord", "parent"))
    here = rows.select(F.col("addr").alias("parent"))
    first = edges.where("ord = 0").join(here, "parent", "left_semi").groupBy("parent").agg(F.min("addr").alias("addr"))
    at = rows.select("addr").join(first, "addr", "left")
    at = cut(at.select("addr", F.coalesce("parent", "addr").alias("line"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("place")))
    moved = 1
    while moved:
        back = at.select(F.col("addr").alias("line"), F.col("line").alias("_line"), F.col("place").alias("_place"))
        more = Observation()
        at = cut(at.join(back, "line").observe(more, F.count(F.when(F.col("_place") > 0, 1)).alias("n")).select("addr", F.col("_line").alias("line"), (F.col("place") + F.col("_place")).alias("place")))
        moved = more.get["n"]
    every = at if known is None else at.unionByName(known.select("addr", "line", "place"))
    place = every.select(F.col("addr").alias("parent"), F.col("line").alias("_l"), F.col("place").alias("_p"))
    across = edges.join(at, "addr").join(place, "parent").where((F.col("ord") > 0) | (F.col("line") != F.col("_l")) | (F.col("place") != F.col("_p") + 1))
    ups = across.groupBy("addr").agg(F.sort_array(F.collect_list(F.struct("ord", F.col("_l").alias("line"), F.col("_p").alias("place")))).alias("_u"))
    ups = ups.select("addr", F.transform("_u", lambda u: F.struct(u["line"].alias("line"), u["place"].alias("place"))).alias("ups"))
    return rows.join(at, "addr").join(ups, "addr", "left").withColumn("ups", F.coalesce("ups", F.array().cast(UPS)))


def _across(nodes: DataFrame) -> DataFrame:
    """Edges between lines: (line, at) to (up_line, up_place)."""
    return nodes.where(F.size("ups") > 0).select("line", F.col("place").alias("at"), F.explode("ups").alias("u")).select("line", "at", F.col("u.line").alias("up_line"), F.col("u.place").alias("up_place"))


def placed(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """Coordinates of ``starts(start)``."""
    return starts.select("start").distinct().join(nodes.select(F.col("addr").alias("start"), "line", "place"), "start")


def closure(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, line, place): of every line the farthest place that is reachable from each start, itself included."""
    across = cut(_across(nodes))
    seen = frontier = cut(placed(nodes, starts))
    while True:
        steps = frontier.join(across, "line").where("at <= place").groupBy("start", F.col("up_line").alias("line")).agg(F.max("up_place").alias("place"))
        old = seen.select("start", "line", F.col("place").alias("_old"))
        frontier, n = counted(steps.join(old, ["start", "line"], "left").where("_old is null or place > _old").drop("_old"))
        if not n:
            return seen
        seen = cut(seen.unionByName(frontier).groupBy("start", "line").agg(F.max("place").alias("place")))


def members(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """(start, addr) of all nodes of closures."""
    far = reached.select("start", "line", F.col("place").alias("_far"))
    return nodes.select("addr", "line", "place").join(far, "line").where("place <= _far").select("start", "addr")


def count(reached: DataFrame) -> DataFrame:
    """(start, n): how many nodes each closure has, without reading them."""
    return reached.groupBy("start").agg(F.sum(F.col("place") + 1).alias("n"))


def log(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, addr, depth) along first parents."""
    first = nodes.where("place = 0 and size(ups) > 0").select("line", F.col("ups")[0].alias("u"))
    jump = cut(first.select("line", F.col("u.line").alias("to"), F.col("u.place").alias("enters"), F.lit(1).cast("long").alias("more")))
    reached = cut(placed(nodes, starts).withColumn("depth", F.lit(0).cast("long")))
    while True:  # after k rounds all lines within 2^k changes
        # From the place where a line is entered it takes that many steps to its start, and those of the jump.
        new, n = counted(reached.join(jump, "line").select("start", F.col("to").alias("line"), F.col("enters").alias("place"), (F.col("depth") + F.col("place") + F.col("more")).alias("depth")))
        if not n:
            break
        reached = cut(reached.unionByName(new))
        then = jump.select(F.col("line").alias("to"), F.col("to").alias("_to"), F.col("enters").alias("_enters"), F.col("more").alias("_more"))
        jump = cut(jump.join(then, "to").select("line", F.col("_to").alias("to"), F.col("_enters").alias("enters"), (F.col("more") + F.col("enters") + F.col("_more")).alias("more")))
    entered = reached.select("start", "line", F.col("place").alias("_in"), F.col("depth").alias("_depth"))
    return nodes.select("addr", "line", "place").join(entered, "line").where("place <= _in").select("start", "addr", (F.col("_depth") + F.col("_in") - F.col("place")).alias("depth"))


def depths(nodes: DataFrame, starts: DataFrame, below: int | None = None) -> DataFrame:
    """(addr, depth): the fewest edges from any start, of nodes less than ``below`` deep if that is given.

    On a line the depth of a place is that of the nearest place above it where the line is entered,
    so a round is one running minimum per line over the places where edges enter and leave it.
    """
    limit = F.lit(True) if below is None else F.col("depth") < below
    across = cut(_across(nodes))
    entered = cut(placed(nodes, starts).groupBy("line", "place").agg(F.lit(0).cast("long").alias("depth")).where(limit))
    above = Window.partitionBy("line").orderBy(F.col("place").desc()).rangeBetween(Window.unboundedPreceding, 0)
    frontier = entered
    while True:
        leaving = across.join(frontier.select("line").distinct(), "line", "left_semi")
        points = entered.join(frontier.select("line").distinct(), "line", "left_semi").select("line", "place", "depth").unionByName(leaving.select("line", F.col("at").alias("place"), F.lit(None).cast("long").alias("depth")).distinct())
        at = points.withColumn("_best", F.min(F.col("depth") + F.col("place")).over(above)).where("depth is null and _best is not null").select("line", F.col("place").alias("at"), (F.col("_best") - F.col("place")).alias("depth"))
        new = at.join(across, ["line", "at"]).groupBy(F.col("up_line").alias("line"), F.col("up_place").alias("place")).agg((F.min("depth") + 1).alias("depth")).where(limit)
        old = entered.select("line", "place", F.col("depth").alias("_old"))
        frontier, n = counted(new.join(old, ["line", "place"], "left").where("_old is null or depth < _old").drop("_old"))
        if not n:
            break
        entered = cut(entered.unionByName(frontier).groupBy("line", "place").agg(F.min("depth").alias("depth")))
    points = nodes.select("addr", "line", "place", F.lit(None).cast("long").alias("depth")).unionByName(entered.select(F.lit(None).cast("string").alias("addr"), "line", "place", "depth"))
    best = points.withColumn("_best", F.min(F.col("depth") + F.col("place")).over(above)).where("addr is not null and _best is not null")
    return best.select("addr", (F.col("_best") - F.col("place")).alias("depth")).where(limit)


def merge_bases(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, base) of ``pairs(a, b)``: common ancestors that no other common ancestor reaches.

    What two closures share is again a beginning of each line, so only its ends can be bases: those
    that no edge from what is shared on another line leads to.
    """
    named = pairs.select("a", "b").distinct()
    reached = closure(nodes, named.select(F.col("a").alias("start")).unionByName(named.select(F.col("b").alias("start"))))
    side = lambda n: named.join(reached.select(F.col("start").alias(n), "line", F.col("place").alias(f"_{n}")), n)
    ends = cut(side("a").join(side("b"), ["a", "b", "line"]).select("a", "b", "line", F.least("_a", "_b").alias("place")))
    inner = ends.join(_across(nodes), "line").where("at <= place").select("a", "b", F.col("up_line").alias("line"), F.col("up_place").alias("place")).distinct()
    tops = ends.join(inner, ["a", "b", "line", "place"], "left_anti")
    return tops.join(nodes.select("line", "place", F.col("addr").alias("base")), ["line", "place"]).select("a", "b", "base")


def is_ancestor(nodes: DataFrame, ancestor: str | None, of: str) -> bool:
    """Whether ``ancestor`` is reachable from ``of``, inclusively; no snapshot is everyone's ancestor."""
    if ancestor is None:
        return True
    at = nodes.where(F.col("addr") == ancestor).select("line", F.col("place").alias("_at"))
    return not closure(nodes, _one(nodes, of)).join(at, "line").where("_at <= place").isEmpty()


def merge_base(nodes: DataFrame, ours: str, theirs: str, explicit: str | None = None) -> str:
    """The one merge base; an explicit one must be among the candidates."""
    found = sorted(r["base"] for r in merge_bases(nodes, nodes.sparkSession.createDataFrame([(ours, theirs)], "a string, b string")).collect())
    if not found:
        raise NoCommonHistory("no common ancestor")
    if explicit is not None:
        if explicit not in found:
            raise NotFound(f"{explicit} is no merge base")
        return explicit
    if len(found) > 1:
        raise MultipleBases(found)
    return found[0]


def _one(nodes: DataFrame, *addrs: str) -> DataFrame:
    return nodes.sparkSession.createDataFrame([(a,) for a in addrs], "start string")


def reachable(nodes: DataFrame, heads: list[str]) -> DataFrame:
    """addr of everything that any of the heads reaches."""
    return members(nodes, closure(nodes, _one(nodes, *heads)).groupBy("line").agg(F.max("place").alias("place")).withColumn("start", F.lit(""))).select("addr")
