import pytest
from pyspark.sql import functions as F

from marlstone import errors as E
from marlstone.operators import dag, objects, search, tree, versions


def entries(spark, notes, dirs=()):
    rows = tree.with_dirs(spark.createDataFrame(list(notes.items()) or [("x", "x")], "path string, addr string").limit(len(notes)))
    if dirs:
        rows = rows.unionByName(tree.located(spark.createDataFrame([(d,) for d in dirs], "path string").select("path", F.lit("dir").alias("type"), F.lit(None).cast("string").alias("addr"))).select(*tree.COLUMNS))
    return tree.tree_addresses(rows)[0]


def merge(spark, base, ours, theirs):
    decided, conflicts, merged = versions.merge_levels(*(entries(spark, s) for s in (base, ours, theirs)))
    result = versions.merged_entries(entries(spark, ours), entries(spark, theirs), decided)
    leaves = {r["path"]: r["addr"] for r in tree.leaves(result).collect()}
    return leaves, {(c["path"], c["kind"]): (c["base"], c["ours"], c["theirs"]) for c in conflicts.collect()}, merged


BASE = {"owner": "o", "workflow/inbox": "i", "workflow/daily": "d", "go": "g", "seed": "s"}


def test_merge_worked_example(spark):
    ours = BASE | {"go": "g2", "workflow/inbox": "i2", "kb": "k"}
    theirs = {k: v for k, v in BASE.items() if k != "workflow/daily"} | {"go": "g2", "workflow/inbox": "i3"}
    leaves, conflicts, merged = merge(spark, BASE, ours, theirs)
    assert merged == 3 and conflicts == {("workflow/inbox", "content"): ("i", "i2", "i3")}
    assert leaves == {"owner": "o", "go": "g2", "seed": "s", "kb": "k", "workflow/inbox": "i2"}


@pytest.mark.parametrize(
    "base, ours, theirs, conflicts, merged",
    [
        ({"a": "1"}, {"a": "1", "z": "2"}, {"a": "1"}, {}, 1),
        ({"x": "1", "y": "1"}, {"x": "1", "y": "1"}, {"x": "2", "w": "3"}, {}, 3),
        ({"x": "1", "k": "1"}, {"x": "2", "k": "1"}, {"x": "2", "k": "1"}, {}, 1),
        ({"x": "1", "k": "1"}, {"k": "1"}, {"k": "1"}, {}, 1),
        ({"p": "1", "q": "1"}, {"p": "2"}, {"q": "2"}, {("p", "modify-delete"): ("1", "2", ""), ("q", "modify-delete"): ("1", "", "2")}, 0),
        ({"k": "1"}, {"k": "1", "n": "1"}, {"k": "1", "n": "2"}, {("n", "content"): ("", "1", "2")}, 0),
        ({}, {"a": "1"}, {"b": "1"}, {}, 2),
        # a whole subtree that only one side changed counts once
        ({"d/e/x": "1", "d/e/y": "1"}, {"d/e/x": "1", "d/e/y": "1"}, {"d/e/x": "2", "d/e/y": "2"}, {}, 1),
    ],
)
def test_merge_rows(spark, base, ours, theirs, conflicts, merged):
    leaves, found, n = merge(spark, base, ours, theirs)
    assert found == conflicts and n == merged
    for path in set(ours) & {p for p, _ in conflicts}:
        assert leaves[path] == ours[path]


def test_merge_type_conflict(spark):
    leaves, found, _ = merge(spark, {"go": "1"}, {"go/inner": "2"}, {"go": "3"})
    assert [k for k in found] == [("go", "type")] and found["go", "type"][0::2] == ("1", "3")
    assert leaves == {"go/inner": "2"}


def test_leaf_merge_agrees(spark):
    sides = [spark.createDataFrame(list(s.items()), "path string, addr string") for s in (BASE, BASE | {"go": "g2", "n": "1"}, BASE | {"go": "g3", "owner": "o2"})]
    got = {r["path"]: r["class"] for r in versions.merge_leaves(*sides).collect()}
    assert got == {"owner": "theirs", "workflow/inbox": "unchanged", "workflow/daily": "unchanged", "go": "content", "seed": "unchanged", "n": "ours"}


def test_diff_and_overlay(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, addr string")
    old, new = frame({"m": "1", "g/n": "1", "k": "1"}), frame({"moved": "1", "g/n": "2", "k": "1"})
    assert {tuple(r) for r in versions.diff(old, new).collect()} == {("m", "removed", "1", None), ("moved", "added", None, "1"), ("g/n", "updated", "1", "2")}
    staged = versions.stage_changes(old, new)
    assert {(r["op"], r["path"]) for r in staged.collect()} == {("D", "m"), ("A", "moved"), ("M", "g/n")}
    head = frame({"k": "9", "g/n": "7", "other": "1"})
    assert {tuple(r) for r in versions.overlay(head, staged).collect()} == {("k", "9"), ("g/n", "2"), ("other", "1"), ("moved", "1")}


def test_listings_and_links(spark):
    e = entries(spark, {"go/channel": "1", "go/adv/x": "2", "web/x": "3", "task": "4", "a/x": "5", "a-b": "6"}, dirs=["empty"])
    assert [r["name"] for r in tree.dir_ls(e).collect()] == ["a", "empty", "go", "web", "a-b", "task"]
    order = [r["path"] for r in tree.list_notes(e).orderBy(tree.tree_order("path")).collect()]
    assert order.index("a/x") < order.index("a-b")  # depth first by segment
    assert tree.resolve_link(e, "go/channel")["path"] == "go/channel" and tree.resolve_link(e, "task")["addr"] == "4"
    with pytest.raises(E.AmbiguousSlug) as error:
        tree.resolve_link(e, "x")
    assert error.value.candidates == ["a/x", "go/adv/x", "web/x"]
    with pytest.raises(E.NotFound):
        tree.resolve_link(e, "nope")
    with pytest.raises(E.EntryTypeConflict):
        tree.resolve_link(e, "go")
    assert tree.dir_exists(e, "go/adv") and not tree.dir_exists(e, "go/none")
    with pytest.raises(E.EntryTypeConflict):
        tree.check_dir(e, "task")
    text = tree.rendered(tree.nested(e))
    assert "empty/" in text and "  channel" in text
    assert [r["path"] for r in tree.type_clashes(spark.createDataFrame([("a",), ("a/b",), ("c",)], "path string")).collect()] == ["a"]


def test_tree_addresses_match_incremental(spark):
    notes = {"a/b/c": "1", "a/d": "2", "e": "3"}
    full, _, root = tree.tree_addresses(tree.with_dirs(spark.createDataFrame(list(notes.items()), "path string, addr string")))
    changed = full.withColumn("addr", F.when(F.col("path") == "a/d", "9").otherwise(F.col("addr")))
    dirty = spark.createDataFrame([("a",)], "path string")
    part, trees, new_root = tree.tree_addresses(changed, dirty)
    want, _, want_root = tree.tree_addresses(tree.with_dirs(spark.createDataFrame(list((notes | {"a/d": "9"}).items()), "path string, addr string")))
    assert new_root == want_root != root and trees.count() == 2
    assert {tuple(r) for r in part.select("path", "addr").collect()} == {tuple(r) for r in want.select("path", "addr").collect()}
    assert tree.tree_addresses(tree.with_dirs(spark.createDataFrame([], "path string, addr string")))[2] == tree.empty_root()


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def test_graph(spark):
    # two merges of the same two snapshots in both orders: two bases
    crab = edges(spark, [("o1", "r"), ("t1", "r"), ("m1", "o1"), ("m1", "t1"), ("m2", "t1"), ("m2", "o1")])
    with pytest.raises(E.MultipleBases) as error:
        dag.merge_base(crab, "m1", "m2")
    assert error.value.candidates == ["o1", "t1"]
    assert dag.merge_base(crab, "m1", "m2", "t1") == "t1" and dag.merge_base(crab, "o1", "t1") == "r" and dag.merge_base(crab, "m1", "o1") == "o1"
    with pytest.raises(E.NotFound):
        dag.merge_base(crab, "m1", "m2", "r")
    two = edges(spark, [("a", "b"), ("x", "y")])
    with pytest.raises(E.NoCommonHistory):
        dag.merge_base(two, "a", "x")
    assert dag.is_ancestor(crab, "r", "m2") and not dag.is_ancestor(crab, "m2", "r") and dag.is_ancestor(crab, None, "r")
    assert dag.abandoned_count(crab, "m1", "o1") == 2
    with pytest.raises(E.NotAncestor):
        dag.abandoned_count(crab, "o1", "t1")
    assert {tuple(r) for r in dag.reachable(crab, ["m1", "o1"]).collect()} == {("m1", 0), ("o1", 0), ("t1", 1), ("r", 1)}
    log = dag.first_parent_log(crab, spark.createDataFrame([("m1",)], "start string"))
    assert [r["node"] for r in log.orderBy("depth").collect()] == ["m1", "o1", "r"]
    nodes = spark.createDataFrame([("sha256:ab1",), ("sha256:ab2",), ("sha256:c",)], "node string")
    assert dag.by_prefix(nodes, "sha256:c") == "sha256:c"
    with pytest.raises(E.AmbiguousRef):
        dag.by_prefix(nodes, "sha256:ab")


NOTES = "path string, addr string, title string, tags array<string>, body string"


def test_search_order(spark):
    rows = spark.createDataFrame([("a", "1", "channel", [], "go"), ("b", "2", "go", [], "channel"), ("c", "3", "other", ["channel"], "x")], NOTES)
    postings, docs = search.full_build(rows)
    assert {r["path"]: r["len"] for r in docs.collect()} == {"a": 4, "b": 4, "c": 6}
    assert [r["path"] for r in search.search(postings, docs, "channel").collect()] == ["a", "c", "b"]
    assert search.search(postings, docs, " ,. ").count() == 0
    assert search.search(postings.limit(0), docs.limit(0), "go").count() == 0
    same = spark.createDataFrame([("p/one", "1", "t", [], "same"), ("p/two", "1", "t", [], "same")], NOTES)
    assert search.search(*search.full_build(same), "same").count() == 2  # equal notes at two paths
    changed = spark.createDataFrame([("b", "9", "neu", [], "neu")], NOTES)
    delta = search.apply_delta(postings, docs, spark.createDataFrame([("c",)], "path string"), changed)
    full = search.full_build(rows.where("path = 'a'").unionByName(changed))
    for x, y in zip(delta, full, strict=True):
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    assert {r["bucket"] for r in search.touched_buckets(postings, spark.createDataFrame([], "path string"), changed).collect()} <= set(range(64))


def test_fusion_tie(spark):
    one = spark.createDataFrame([(0, "tie/ddd", 1), (0, "tie/aaa", 2)], "qid long, path string, rank int")
    other = spark.createDataFrame([(0, "tie/aaa", 1), (0, "tie/ddd", 2)], "qid long, path string, rank int")
    got = search.top(search.fused(one, other), 5, F.col("score").desc(), "path").orderBy("rank").collect()
    assert [r["path"] for r in got] == ["tie/aaa", "tie/ddd"] and abs(got[0]["score"] - (1 / 61 + 1 / 62)) < 1e-9
    many = spark.createDataFrame([(0, f"n{i:03}", i) for i in range(1, 121)], "qid long, path string, rank int")
    assert search.fused(many, many).count() == 50


def test_objects(spark):
    rows = spark.createDataFrame([("blob", b"x"), ("blob", b"x"), ("blob", b"")], "kind string, data binary")
    found = objects.objects_of(rows)
    assert found.count() == 2 and objects.missing(found, found.where("size = 0")).count() == 1
    broken = found.withColumn("data", F.when(F.col("size") == 1, F.lit(b"y")).otherwise(F.col("data")))
    assert [r["problem"] for r in objects.fsck(broken).collect()] == ["content does not match address"]


def test_many_query_vectors_are_one_join(spark, monkeypatch):
    """Blocks of any size give what all pairs give: ties by path, zero, null and shorter vectors, repeated vectors."""
    import numpy as np

    from marlstone.operators import search

    monkeypatch.setattr(search, "_cells", lambda spark: 3)
    rng = np.random.default_rng(5)
    stored = [(f"p{i:03}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(230)]
    stored += [("zero", [0.0] * 4), ("none", None), ("short", [1.0, 2.0]), ("é", [1.0, 1.0, 1.0, 1.0])]
    asked = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(37)] + [(90, [0.0] * 4), (91, [1.0, 2.0]), (92, None), (93, [1.0])]

    def brute(vec, k):
        if vec is None:
            return []
        a = np.array(vec)
        found = []
        for path, other in stored:
            if other is not None and len(other) == len(vec):
                size = np.linalg.norm(a) * np.linalg.norm(other)
                found.append((-round(float(a @ other / size), 9) if size else 0.0, path))
        return [p for _, p in sorted(found)[:k]]

    vectors = spark.createDataFrame(stored, "path string, vec array<float>").repartition(4)
    queries = spark.createDataFrame(asked, "qid long, vec array<double>").repartition(3)
    for k, block in ((3, 12), (5, 1 << 18), (500, 60)):
        monkeypatch.setattr(search, "BLOCK_CELLS", block)
        monkeypatch.setattr(search, "HELD_CELLS", 2 * block)
        got = {}
        for r in search.cosine_batch(vectors, queries, k).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["path"])
        assert got == {qid: want for qid, vec in asked if (want := brute(vec, k))}
    plan = search.cosine_batch(vectors, queries, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Union" not in plan
    assert search.cosine_batch(vectors.limit(0), queries, 3).count() == search.cosine_batch(vectors, queries.limit(0), 3).count() == 0
