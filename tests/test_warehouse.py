import subprocess
import sys
import textwrap
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone import errors as E
from marlstone.plans.repository import Repository
from marlstone.schema import EngineConfig
from marlstone.sources import warehouse
from marlstone.sources.warehouse import LARGE, Warehouse

ROOT = str(Path(__file__).resolve().parent.parent)
WRITER = """
import sys
from pyspark.sql import SparkSession
from marlstone import errors as E
from marlstone.plans.repository import Repository
from marlstone.schema import EngineConfig
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
repo = Repository(spark, EngineConfig(sys.argv[1]))
for i in range(2):
    try:
        print("done", repo.set_note(f"{sys.argv[2]}/{i}", "t", f"by process {sys.argv[2]} {i}"))
    except E.HeadMoved:
        print("moved")
"""


@pytest.fixture
def few(spark):
    """Settings for a handful of rows: compiling code would cost more than it saves."""
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def unique(store):
    for name, (_, _, keys) in LARGE.items():
        rows = store.relation(name)
        whole = {"deltas": ["snapshot", "path"], "postings": ["path", "addr", "term"], "edges": ["src", "dst", "role"], "vectors": ["generation", "path"]}.get(name, keys)
        assert rows.groupBy(*whole).count().where("count > 1").isEmpty(), name


def test_racing_writers(spark, few, tmp_path):
    """Threads and processes commit to one branch: each commit is there once, or raised HeadMoved."""
    library = str(tmp_path / "library")
    repo = Repository(spark, EngineConfig(library))
    done = [repo.set_note("first", "t", "x")]

    def commit(i):
        handle = Repository(spark, EngineConfig(library)) if i % 2 else repo
        try:
            return handle.set_note(f"n/{i % 5}", "t", f"body {i}")
        except E.HeadMoved:
            return None

    others = [subprocess.Popen([sys.executable, "-c", textwrap.dedent(WRITER), library, str(i)], cwd=ROOT, stdout=subprocess.PIPE, text=True) for i in range(2)]
    with ThreadPoolExecutor(8) as pool:
        done += [a for a in pool.map(commit, range(16)) if a]
    for p in others:
        out = p.communicate(timeout=300)[0].split("\n")
        assert len([x for x in out if x]) == 2
        done += [x.split()[1] for x in out if x.startswith("done")]
    log = [r["addr"] for r in repo.log().collect()]
    assert sorted(log) == sorted(set(done)) and len(done) > 1
    assert {r["addr"] for r in repo.snapshots().select("addr").collect()} == set(done)  # nothing of those that failed
    unique(repo.store)
    assert repo.list_notes().count() == repo.leaves().count() == len({r["path"] for r in repo.leaves().collect()})
    assert repo.fsck().count() == 0


def test_the_same_rows_from_two_writers(spark, few, tmp_path):
    """Rows that another writer stored meanwhile are taken out of a transaction's own."""
    a, b = (Warehouse(spark, str(tmp_path / "library")) for _ in range(2))
    blobs = lambda *texts: spark.createDataFrame([("blob", t.encode()) for t in texts], "kind string, data binary")

    def late(tx):
        tx.put(blobs("x", "y"))
        b.put(blobs("y", "z"))

    a.transact(late)
    assert a.list().count() == 3
    unique(a)


def test_collections_beside_writers(spark, few, tmp_path):
    """A commit that counts on an object which a collection drops meanwhile stores it anew."""
    library = str(tmp_path / "library")
    repo = Repository(spark, EngineConfig(library))
    first = repo.set_note("a", "t", "kept")
    repo.set_note("b", "t", "given up")
    repo.reset(first)
    publish, other = repo.store.publish, Repository(spark, EngineConfig(library))

    def late(change):
        repo.store.publish = publish
        assert other.gc()["removed"] > 0
        return publish(change)

    repo.store.publish = late
    repo.set_note("b", "t", "given up")
    assert repo.note("b")["body"] == "given up" and repo.fsck().count() == 0
    unique(repo.store)


def test_a_branch_that_moves_during_a_collection(spark, few, tmp_path):
    library = str(tmp_path / "library")
    repo = Repository(spark, EngineConfig(library))
    repo.set_note("a", "t", "one")
    publish, other = repo.store.publish, Repository(spark, EngineConfig(library))

    def late(change):
        repo.store.publish = publish
        other.set_note("b", "t", "two")
        return publish(change)

    repo.store.publish = late
    repo.gc()
    assert {r["path"] for r in repo.leaves().collect()} == {"a", "b"} and repo.fsck().count() == 0


def test_merged_segments(spark, few, tmp_path, monkeypatch):
    """Many small commits leave few files; readers of the segments before go on; what was taken away goes in time."""
    monkeypatch.setattr(warehouse, "MERGED", 3)
    repo = Repository(spark, EngineConfig(str(tmp_path / "library"), indexed=False))
    store = repo.store
    store.retain = 3600
    before = None
    for i in range(7):
        repo.set_note(f"n{i}", "t", f"b{i}")
        before = repo.notes() if i == 0 else before
    assert before.count() == 1
    assert all(len(some) < 3 for some in store.manifest().segments.values())
    assert repo.leaves().count() == 7 and repo.fsck().count() == 0
    retired = len(store.manifest().retired)
    store.retain = 0
    assert store.vacuum() == retired and store.vacuum() == 0
    assert not store.manifest().retired and repo.list_notes().count() == 7
    (tmp_path / "library" / "notes" / "s-left").mkdir()
    assert store.vacuum_strays() == 0 and store.vacuum_strays(older=-10) == 1


def test_point_reads(spark, few, tmp_path):
    """A read by address opens the row groups that may hold it, by sorted files' statistics."""
    store = Warehouse(spark, str(tmp_path / "library"))
    rows = spark.range(0, 200_000, 1, 4).select(F.lit("blob").alias("kind"), F.encode(F.concat(F.lit("text "), F.col("id").cast("string")), "UTF-8").alias("data"))
    spark.conf.set("spark.hadoop.parquet.block.size", str(256 << 10))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(256 << 10))
    try:
        store.put(rows)
    finally:
        spark.conf.unset("spark.hadoop.parquet.block.size")
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    addr = store.list().orderBy("addr").head()["addr"]
    found = store.relation("objects").where(F.col("addr") == addr)
    assert found.count() == 1
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [IsNotNull(addr), EqualTo(addr," in plan.toString() or "EqualTo(addr" in plan.toString()
    scan = plan
    while scan.children().size():
        scan = scan.children().head()
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read < 100_000, read


def test_stores_without_atomic_creation_are_refused(spark, tmp_path, monkeypatch):
    store = Warehouse(spark, str(tmp_path / "library"))

    class Scheme:
        def getScheme(self):
            return "s3a"

    class Files:
        def getUri(self):
            return Scheme()

        def hasPathCapability(self, path, name):
            return False

    monkeypatch.setattr(store, "_fs", Files())
    with pytest.raises(E.EngineError, match="offers no creation"):
        store._publish(store._record(99), b"{}")


def test_restored_histories_are_deltas(spark, few, tmp_path):
    """A restore writes what changed from snapshot to snapshot, and every snapshot reads as before."""
    repo = Repository(spark, EngineConfig(str(tmp_path / "a"), indexed=True))
    repo.bulk_import(repo.inputs([{"path": f"d{i % 3}/n{i}", "title": "t", "body": f"b{i}"} for i in range(12)]))
    repo.set_note("d0/n0", "t", "new")
    repo.remove_note("d1/n1")
    repo.remove_dir("d2", recursive=True)
    repo.set_note("d2", "t", "now a note")
    copy = Repository(spark, EngineConfig(str(tmp_path / "b")))
    copy.restore(repo.dump())
    for r in repo.log().collect():
        rows = lambda x: {tuple(e) for e in x.entries(r["addr"]).select("path", "parent", "slug", "depth", "type", "addr").collect()}  # noqa: E731, B023
        assert rows(copy) == rows(repo)
    assert copy.store.relation("deltas").count() < 40 and copy.fsck().count() == 0


def test_vectors_are_objects(spark, few, tmp_path):
    """Backups, restores, transfers, collections and checks carry every generation of vectors."""
    from marlstone.functions.encoding import decode
    from marlstone.sources.embed import HashEmbedder

    hits = lambda r, ref=None: [tuple(x) for x in r.search_hybrid("beta", HashEmbedder(), ref).collect()]
    repo = Repository(spark, EngineConfig(str(tmp_path / "a")))
    repo.bulk_import(repo.inputs([{"path": p, "title": p, "body": b} for p, b in (("x/one", "alpha beta"), ("x/two", "beta"), ("y", "gamma"))]))
    first = repo.rebuild_embeddings(HashEmbedder())
    again = repo.rebuild_embeddings(HashEmbedder())
    assert repo.snapshot(first)["vectors"] == repo.snapshot(again)["vectors"] and repo.store.relation("vectors").count() == 3
    repo.set_note("z", "z", "delta beta")
    last = repo.rebuild_embeddings(HashEmbedder())
    objects = repo.store.relation("objects")
    root = decode(objects, "vecroot").where(F.col("addr") == repo.snapshot(last)["vectors"]).select("o.*").first()
    assert (root["model"], root["dim"], len(root["shards"])) == ("hash", 16, 64) and sum(s != "" for s in root["shards"]) in (1, 2, 3, 4)
    assert decode(objects, "snapshot").where(F.col("addr") == last).select("o.vec").first()[0] == repo.snapshot(last)["vectors"]
    assert repo.fsck().count() == 0
    want = {ref: hits(repo, ref) for ref in (first, last)}
    assert len(want[last]) == 4 and len(want[first]) == 3
    restored, pulled = (Repository(spark, EngineConfig(str(tmp_path / n))) for n in ("b", "c"))
    restored.restore(repo.dump())
    pulled.pull(repo)
    for copy in (restored, pulled):
        assert {ref: hits(copy, ref) for ref in (first, last)} == want and copy.fsck().count() == 0
    # A generation that the relation and a shard disagree on, on a snapshot that isn't the head.
    pulled.store.rewrite("vectors", lambda rows: rows.where("path <> 'y'"))
    assert {r["problem"] for r in pulled.fsck().collect()} == {"vector not in the relation: y"}
    restored.gc(keep_last=1)
    assert hits(restored) == want[last] and restored.fsck().count() == 0
    with pytest.raises(E.EngineError):
        hits(restored, first)
    assert decode(restored.store.relation("objects"), "vecroot").count() == 1


def test_vector_shards_have_fixed_bytes(spark):
    """Fields in order, items by path, components as little-endian 32-bit floats."""
    from marlstone.sources.embed import vector_objects

    rows = spark.createDataFrame([(p, "nomic-embed-text", 4, 7, [0.5, -1.25, 0.0, 3.75]) for p in ("go/zzz", "go/aaa")], "path string, model string, dim int, bucket int, vec array<float>")
    made, root = vector_objects(rows)
    data = {r["kind"]: bytes(r["data"]).decode() for r in made.collect()}
    vec = "AAAAPwAAoL8AAAAAAABwQA=="
    assert data["vecshard"] == f'{{"kind":"vecshard","model":"nomic-embed-text","dim":4,"items":[{{"path":"go/aaa","vec":"{vec}"}},{{"path":"go/zzz","vec":"{vec}"}}]}}'
    assert data["vecroot"].startswith('{"kind":"vecroot","model":"nomic-embed-text","dim":4,"shards":["","') and root.startswith("sha256:")
