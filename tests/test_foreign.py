"""Libraries in SQLite files and JDBC databases."""

import gzip
import hashlib
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from marlstone import errors as E
from marlstone.plans.repository import Repository
from marlstone.schema import EngineConfig
from marlstone.sources import foreign
from marlstone.sources.embed import HashEmbedder

KINDS = ("blob", "note", "tree", "snapshot", "indexroot", "indexshard", "vecroot", "vecshard")


@pytest.fixture(autouse=True)
def few(spark):
    """Settings for a handful of rows: compiling code would cost more than it saves."""
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def repo(spark, tmp_path):
    """Notes over three snapshots and two branches, with vectors."""
    made = Repository(spark, EngineConfig(str(tmp_path / "own")))
    made.bulk_import(made.inputs([{"path": f"d{i % 3}/n{i}", "title": f"t{i}", "body": f"body {i} alpha"} for i in range(9)]))
    made.set_note("d0/n0", "t", "beta ünï")
    made.rebuild_embeddings(HashEmbedder())
    made.store.branch_set("default", "kept", made.head())
    made.store.branch_describe("default", "kept", "a second branch")
    return made


def sqlite_file(repo, path, version="6", change=lambda row: row):
    """``repo`` as a SQLite library, shards compressed."""
    link = sqlite3.connect(path)
    link.executescript(
        "CREATE TABLE objects (addr text PRIMARY KEY, kind text NOT NULL, size integer NOT NULL, data blob NOT NULL);"
        "CREATE TABLE projects (name text PRIMARY KEY, created_at text NOT NULL, description text NOT NULL DEFAULT '');"
        "CREATE TABLE branches (project text NOT NULL, name text NOT NULL, addr text NOT NULL, updated_at text NOT NULL, description text NOT NULL DEFAULT '', PRIMARY KEY (project, name));"
        "CREATE TABLE meta (key text PRIMARY KEY, value text NOT NULL);"
    )
    for r in repo.store.relation("objects").collect():
        data = bytes(r["data"])
        stored = b"\x01" + gzip.compress(data) if r["kind"] == "vecshard" else data
        link.execute("INSERT INTO objects VALUES (?, ?, ?, ?)", change((r["addr"], r["kind"], len(stored), stored)))
    for r in repo.store.rows("projects"):
        link.execute("INSERT INTO projects VALUES (?, '2026-01-01T00:00:00.000Z', ?)", (r["name"], r["description"]))
    for r in repo.store.rows("branches"):
        link.execute("INSERT INTO branches VALUES (?, ?, ?, '2026-01-01T00:00:00.000Z', ?)", (r["project"], r["name"], r["addr"], r["description"]))
    link.execute("INSERT INTO meta VALUES ('schema_version', ?)", (version,))
    link.commit()
    link.close()
    return str(path)


def rows(df):
    return sorted((r["addr"], r["kind"], r["size"], bytes(r["data"])) for r in df.select("addr", "kind", "size", "data").collect())


def test_a_sqlite_library_reads_to_the_same_relations(spark, repo, tmp_path):
    path = sqlite_file(repo, tmp_path / "library.db")
    library = foreign.open_library(spark, "sqlite:" + path, partitions=5)
    assert rows(library.objects) == rows(repo.store.relation("objects"))
    assert library.objects.rdd.getNumPartitions() == 5
    assert {r["kind"] for r in library.objects.select("kind").distinct().collect()} >= {"blob", "note", "tree", "snapshot", "vecroot", "vecshard"}
    copy = Repository(spark, EngineConfig(str(tmp_path / "copy")))
    done = copy.restore_foreign(library)
    assert (done["branches"], done["version"]) == (2, 6) and done["objects"] == library.objects.count()
    assert copy.head() == repo.head() and copy.store.branch_get("default", "kept") == repo.head()
    assert {b["name"]: b["description"] for b in copy.store.branch_list()}["kept"] == "a second branch"
    assert [r["addr"] for r in copy.log().collect()] == [r["addr"] for r in repo.log().collect()]
    for ask in (lambda r: r.list_notes(), lambda r: r.search("alpha"), lambda r: r.search_hybrid("beta", HashEmbedder())):
        assert ask(copy).collect() == ask(repo).collect()
    assert copy.fsck().count() == 0
    with pytest.raises(E.LibraryNotEmpty):
        copy.restore_foreign(library)


def test_what_a_sqlite_library_can_have_wrong(spark, repo, tmp_path):
    fresh = Repository(spark, EngineConfig(str(tmp_path / "fresh")))
    with pytest.raises(E.NotFound):
        foreign.open_library(spark, str(tmp_path / "absent.db"))
    assert not os.path.exists(tmp_path / "absent.db")
    sqlite3.connect(tmp_path / "other.db").execute("CREATE TABLE t (x)").connection.close()
    with pytest.raises(E.NotFound, match="no table branches, meta, objects, projects"):
        foreign.open_library(spark, str(tmp_path / "other.db"))
    with pytest.raises(E.VersionMismatch):
        fresh.restore_foreign(foreign.open_library(spark, sqlite_file(repo, tmp_path / "old.db", version="5")))
    spoilt = sqlite_file(repo, tmp_path / "spoilt.db", change=lambda r: (*r[:3], r[3] + b" ") if r[1] == "note" else r)
    with pytest.raises(E.InvalidObject, match="damaged"):
        fresh.restore_foreign(foreign.open_library(spark, spoilt))
    assert fresh.store.is_empty()
    torn = sqlite_file(repo, tmp_path / "torn.db", change=lambda r: (*r[:3], r[3][:-9]) if r[1] == "vecshard" else r)
    with pytest.raises(Exception, match="a compressed vecshard can't be read"):
        foreign.open_library(spark, torn).objects.collect()


def test_ranges_of_addresses_hold_every_object_once(spark, tmp_path):
    link = sqlite3.connect(tmp_path / "many.db")
    link.executescript("CREATE TABLE objects (addr text PRIMARY KEY, kind text, size integer, data blob); CREATE TABLE projects (name text, created_at text, description text);"
                       "CREATE TABLE branches (project text, name text, addr text, updated_at text, description text); CREATE TABLE meta (key text, value text);")
    bodies = [str(i).encode() for i in range(3000)] + [b"", b"\x01\x02 no gzip, for a blob isn't compressed"]
    addresses = ["sha256:" + hashlib.sha256(b).hexdigest() for b in bodies]
    edges = [b.ljust(71, "0") for b in foreign.address_bounds(7)]  # the bounds themselves
    link.executemany("INSERT INTO objects VALUES (?, 'blob', ?, ?)", [(a, len(b), b) for a, b in zip(addresses + edges, bodies + [b"e"] * 6, strict=True)])
    link.commit()
    link.close()
    found = foreign.open_library(spark, str(tmp_path / "many.db"), partitions=7).objects
    assert sorted(r["addr"] for r in found.collect()) == sorted(addresses + edges)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 7 and max(sizes) < 550
    assert {bytes(r["data"]) for r in found.where("size > 10").collect()} == {bodies[-1]}
    empty = foreign.open_library(spark, str(tmp_path / "many.db"))
    assert empty.branches.count() == empty.projects.count() == 0


def test_kinds_that_may_be_compressed():
    for kind in KINDS:
        packed = b"\x01" + gzip.compress(b'{"kind":1}')
        assert foreign.inflated(kind, packed) == (b'{"kind":1}' if kind in foreign.COMPRESSED else packed)
        assert foreign.inflated(kind, b"\x01") == b"\x01" and foreign.inflated(kind, b"{}") == b"{}" and foreign.inflated(kind, b"") == b""


def test_a_jdbc_library_reads_to_the_same_relations(spark, repo, tmp_path):
    """By the embedded database that Spark brings along: the readers ask any database in the same way."""
    url = f"jdbc:derby:{tmp_path}/derby"
    names = {"objects": '"addr" varchar(80), "kind" varchar(20), "size" bigint, "data" blob', "projects": '"name" varchar(80), "created_at" timestamp, "description" varchar(200)',
             "branches": '"project" varchar(80), "name" varchar(80), "addr" varchar(80), "updated_at" timestamp, "description" varchar(200)', "meta": '"key" varchar(40), "value" varchar(40)'}
    link = spark._jvm.java.sql.DriverManager.getConnection(url + ";create=true")
    run = lambda sql: link.createStatement().execute(sql)
    for table, columns in names.items():
        run(f'CREATE TABLE "{table}" ({columns})')
    for r in repo.store.relation("objects").collect():
        data = bytes(r["data"])
        if r["kind"] == "vecshard":
            data = b"\x01" + gzip.compress(data)
        statement = link.prepareStatement('INSERT INTO "objects" VALUES (?, ?, ?, ?)')
        statement.setString(1, r["addr"]), statement.setString(2, r["kind"]), statement.setLong(3, len(data)), statement.setBytes(4, data)
        statement.execute()
    run("INSERT INTO \"projects\" VALUES ('default', CURRENT_TIMESTAMP, '')")
    run(f"INSERT INTO \"branches\" VALUES ('default', 'main', '{repo.head()}', CURRENT_TIMESTAMP, '')")
    run("INSERT INTO \"meta\" VALUES ('schema_version', '6')")
    link.close()
    library = foreign.open_library(spark, url, partitions=3)
    assert library.objects.schema.simpleString() == "struct<addr:string,kind:string,size:bigint,data:binary>"
    assert rows(library.objects) == rows(repo.store.relation("objects"))
    copy = Repository(spark, EngineConfig(str(tmp_path / "copy")))
    copy.restore_foreign(library)
    assert copy.head() == repo.head() and copy.search("alpha").collect() == repo.search("alpha").collect()
