import random

import pytest
from pyspark.sql import functions as F

from marlstone import lineage
from marlstone.operators import lines


@pytest.fixture(scope="module")
def graph():
    """Forks, merges, several roots, and parents that aren't there."""
    rng, parents, names = random.Random(5), {}, []
    for i in range(70):
        name = f"n{rng.randrange(10**6):06d}x{i}"
        recent = names[-6:]
        parents[name] = sorted(set(rng.sample(recent, min(len(recent), rng.choice([0, 1, 1, 1, 1, 2])))))
        names.append(name)
    return parents, names


def closure(parents, start):
    depth, frontier = {start: 0}, [start]
    while frontier:
        frontier = [p for p in dict.fromkeys(p for n in frontier for p in parents[n] if p not in depth) if not depth.update({p: 0})]
    return set(depth)


def depths(parents, starts):
    found, frontier, at = {}, set(starts), 0
    while frontier:
        found |= {n: at for n in frontier}
        at += 1
        frontier = {p for n in frontier for p in parents[n]} - set(found)
    return found


@pytest.fixture(scope="module")
def nodes(spark, graph):
    rows = [(n, ps + ["gone"] if i % 9 == 0 else ps) for i, (n, ps) in enumerate(graph[0].items())]
    return lines.cut(lines.labelled(spark.createDataFrame(rows, "addr string, parents array<string>")))


def starts(spark, some):
    return spark.createDataFrame([(n,) for n in some], "start string")


def test_lines_hold_the_graph(spark, graph, nodes):
    parents, names = graph
    rows = {r["addr"]: r for r in nodes.collect()}
    at = {(r["line"], r["place"]): a for a, r in rows.items()}
    assert len(at) == len(names)
    for n, r in rows.items():
        before = [at[(r["line"], r["place"] - 1)]] if r["place"] else []
        assert sorted(before + [at[(u["line"], u["place"])] for u in r["ups"]]) == parents[n]
        assert not before or before[0] == parents[n][0]


def test_closures_logs_and_depths(spark, graph, nodes):
    parents, names = graph
    some = names[-8:]
    reached = lines.closure(nodes, starts(spark, some))
    assert {(r["start"], r["addr"]) for r in lines.members(nodes, reached).collect()} == {(s, n) for s in some for n in closure(parents, s)}
    assert {r["start"]: r["n"] for r in lines.count(reached).collect()} == {s: len(closure(parents, s)) for s in some}
    want = set()
    for s in some:
        at, n = 0, s
        while n:
            want.add((s, n, at))
            at, n = at + 1, parents[n][0] if parents[n] else None
    assert {tuple(r) for r in lines.log(nodes, starts(spark, some)).collect()} == want
    every = depths(parents, some[-3:])
    for below in (None, 1, 3):
        got = {r["addr"]: r["depth"] for r in lines.depths(nodes, starts(spark, some[-3:]), below).collect()}
        assert got == {n: d for n, d in every.items() if below is None or d < below}


def test_merge_bases(spark, graph, nodes):
    parents, names = graph
    rng = random.Random(7)
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(40)}
    want = set()
    for a, b in pairs:
        common = closure(parents, a) & closure(parents, b)
        want |= {(a, b, n) for n in common if not any(n != m and n in closure(parents, m) for m in common)}
    got = lines.merge_bases(nodes, spark.createDataFrame(sorted(pairs), "a string, b string"))
    assert {tuple(r) for r in got.collect()} == want


def test_new_lines_beside_known_ones(spark, graph, nodes):
    """Snapshots copied into a library whose own keep their places."""
    parents, names = graph
    rows = nodes.where(F.col("addr").isin(names[:40]))
    old = lines.cut(lines.labelled(rows))
    new = lines.cut(lines.labelled(nodes.where(F.col("addr").isin(names[40:])), old))
    both = old.unionByName(new)
    got = lines.members(both, lines.closure(both, starts(spark, names[-4:])))
    assert {(r["start"], r["addr"]) for r in got.collect()} == {(s, n) for s in names[-4:] for n in closure(parents, s)}


def jobs(spark, work):
    """Spark jobs that ``work`` starts."""
    spark.sparkContext.setJobGroup("counted", "")
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def test_long_chains_cost_few_jobs(spark):
    """Two thousand snapshots one after another, and a fork: a few actions, however long the history is.

    Adaptive execution would make a job of every shuffle, so it is off while they are counted.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    chain = spark.range(2_000).select(F.format_string("a%06d", "id").alias("addr"), F.when(F.col("id") == 0, F.array().cast("array<string>")).otherwise(F.array(F.format_string("a%06d", F.col("id") - 1))).alias("parents"))
    fork = spark.createDataFrame([("b", ["a001500"])], "addr string, parents array<string>")
    nodes = lines.cut(lines.labelled(chain.unionByName(fork)))
    head = starts(spark, ["a001999"])
    assert jobs(spark, lambda: _equal(lines.log(nodes, head).count(), 2_000)) < 40
    assert jobs(spark, lambda: _equal(lines.depths(nodes, head).agg(F.max("depth")).first()[0], 1_999)) < 40
    assert jobs(spark, lambda: _equal(lines.merge_base(nodes, "a001999", "b"), "a001500")) < 40
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert lines.is_ancestor(nodes, "a001500", "b") and not lines.is_ancestor(nodes, "a001501", "b")


def _equal(a, b):
    assert a == b


def test_estimates_of_a_loop_stay_small(spark):
    """Each round joins what was cut before with itself, as pointer jumping does: the estimate must not double its digits every time."""
    at = lineage.cut(spark.range(64).select(F.col("id").alias("a"), ((F.col("id") + 1) % 64).alias("b"), F.array(F.struct(F.col("id").cast("string").alias("x"))).alias("u")))
    for _ in range(10):
        at = lineage.cut(at.join(at.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"), "u"))
    assert at._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 128
    assert sorted((r["a"], r["b"], r["u"][0]["x"]) for r in at.collect()) == [(i, (i + 1024) % 64, str(i)) for i in range(64)]
