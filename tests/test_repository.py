import json
import os
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from marlstone import errors as E
from marlstone.operators import search
from marlstone.plans import cli, http, repository, views
from marlstone.plans.repository import Repository
from marlstone.schema import EngineConfig
from marlstone.sources import formats
from marlstone.sources.embed import HashEmbedder
from marlstone.sources.warehouse import Warehouse
from marlstone.streaming.ingest import ingest

# Fixed value: the clock of the worked examples.
NOW = 1_700_000_000


class Clock:
    def __init__(self):
        self.at = NOW

    def __call__(self):
        self.at += 1
        return self.at


@pytest.fixture(autouse=True)
def tiny_tables(spark, request):
    """Settings for a handful of rows: compiling code would cost more than it saves. Tests marked ``usual`` keep those of users."""
    if request.node.get_closest_marker("usual"):
        yield
        return
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def repo(spark, tmp_path):
    return Repository(spark, EngineConfig(str(tmp_path / "library"), now=Clock()))


def paths(repo, ref=None):
    return sorted(r["path"] for r in repo.leaves(ref).collect())


def bulk(repo, notes, message="bulk"):
    return repo.bulk_import(repo.inputs([{"path": p, "title": p, "body": b} for p, b in notes.items()]), message)


def test_notes_history_and_search(repo):
    first = bulk(repo, {"go/channel": "channel and select", "hello": "hello world", "task": "a"})
    second = repo.set_note("hello", "Hello", "changed world", ["b", "a"])
    third = repo.remove_note("task")
    assert paths(repo) == ["go/channel", "hello"] and paths(repo, first) == ["go/channel", "hello", "task"]
    assert repo.note("hello")["tags"] == ["a", "b"] and repo.note("hello", first)["body"] == "hello world"
    assert [r["addr"] for r in repo.log().collect()] == [third, second, first]
    assert repo.resolve(second[:20]) == second and repo.resolve("main") == third
    assert {(r["path"], r["type"]) for r in repo.diff(first, "main").collect()} == {("hello", "updated"), ("task", "removed")}
    assert [r["path"] for r in repo.search("world").collect()] == ["hello"]
    assert [r["snippet"] for r in repo.search("channel", snippet=True).collect()] == ["【channel】 and select"]
    assert repo.search("hello", first).head()["path"] == "hello"
    assert repo.fsck().count() == 0
    with pytest.raises(E.NotFound):
        repo.note("task")
    with pytest.raises(E.EntryTypeConflict):
        repo.note("go")
    with pytest.raises(E.EntryTypeConflict):
        repo.set_note("hello/inner", "x")
    with pytest.raises(E.InvalidObject):
        repo.set_note("x", " ")
    assert repo.reset(first) == 2 and paths(repo) == ["go/channel", "hello", "task"]
    assert repo.unreachable_count() > 0
    repo.gc()
    assert repo.unreachable_count() == 0 and repo.fsck().count() == 0 and repo.note("hello")["body"] == "hello world"


def test_directories(repo):
    bulk(repo, {"a/b/c": "1", "a/d": "2"})
    made = repo.mkdir("a/new/deep")
    assert repo.mkdir("a/new") == made  # nothing to commit
    assert [r["name"] for r in repo.dir_ls("a").collect()] == ["b", "new", "d"]
    with pytest.raises(E.DirectoryNotEmpty):
        repo.remove_dir("a/b")
    repo.remove_dir("a/b", recursive=True)
    assert paths(repo) == ["a/d"] and repo.fsck().count() == 0
    tree = repo.dir_tree()
    assert tree["children"][0]["name"] == "a" and [c["name"] for c in tree["children"][0]["children"]] == ["d", "new"]


def test_bulk_last_wins_and_long_chains(repo):
    items = [{"path": "n", "title": "one"}, {"path": "m", "title": "m"}, {"path": "n", "title": "two"}]
    repo.bulk_import(repo.inputs(items).coalesce(1))
    assert repo.note("n")["title"] == "two"


def test_stage(repo):
    bulk(repo, {"a": "1", "c": "1"})
    repo.stage_note("a", "a", "2")
    repo.stage_note("b", "b", "1")
    bulk(repo, {"c": "2"})
    assert [tuple(r) for r in repo.stage_status().collect()] == [("M", "a"), ("A", "b")]
    assert repo.commit_stage() == 2
    assert {p: repo.note(p)["body"] for p in "abc"} == {"a": "2", "b": "1", "c": "2"}
    repo.stage_remove_note("a")
    assert [tuple(r) for r in repo.stage_status().collect()] == [("D", "a")]
    repo.abort_stage()
    assert repo.stage_status().count() == 0
    with pytest.raises(E.NothingStaged):
        repo.commit_stage()


def test_projects_are_separate(repo):
    repo.store.project_create("other", "second")
    assert not repo.store.project_create("other", "again")
    bulk(repo, {"a": "1"})
    other = repo.on(project="other")
    bulk(other, {"b": "1"})
    assert paths(repo) == ["a"] and paths(other) == ["b"]
    with pytest.raises(E.NotFound):
        other.note("a")
    assert [tuple(r) for r in views.project_rows(repo.store.project_stats()).collect()] == [("default", "", 1), ("other", "second", 1)]
    with pytest.raises(E.ProjectNotFound):
        bulk(repo.on(project="none"), {"a": "1"})
    repo.store.branch_describe("other", "main", "text")
    bulk(other, {"c": "1"})
    assert other.store.branch_list("other")[0]["description"] == "text"
    with pytest.raises(ValueError):
        repo.store.project_describe("other", "x" * 513)


def test_pull_and_merge(spark, repo, tmp_path):
    clock = Clock()
    bulk(repo, {"owner": "o", "workflow/inbox": "i", "workflow/daily": "d", "go": "g", "seed": "s"})
    copy = Repository(spark, EngineConfig(str(tmp_path / "copy"), now=clock))
    assert copy.pull(repo)["result"] == "fast-forward" and copy.head() == repo.head()
    assert copy.pull(repo)["result"] == "up to date"
    assert copy.search("g").count() == 1 and copy.fsck().count() == 0
    bulk(repo, {"go": "g2", "workflow/inbox": "i2", "kb": "k"})
    copy.bulk_import(copy.inputs([{"path": "go", "title": "go", "body": "g2", "created_at": repo.note("go")["created_at"]}, {"path": "workflow/inbox", "title": "workflow/inbox", "body": "i3"}]))
    copy.remove_note("workflow/daily")
    with pytest.raises(E.Diverged):
        repo.pull(copy)
    head = repo.head()
    with pytest.raises(E.MergeConflicts) as error:
        repo.merge_start(copy)
    assert error.value.auto_merged == 3 and [(c["path"], c["kind"]) for c in error.value.conflicts] == [("workflow/inbox", "content")]
    assert repo.head() == head
    with pytest.raises(E.Merging):
        repo.set_note("x", "x")
    with pytest.raises(E.NothingStaged):
        repo.merge_continue()
    row = views.merge_state_row("default", "main", repo.merge_state())
    assert row["state"] == "merging" and not row["can_continue"] and row["conflict_count"] == 1
    repo.stage_note("workflow/inbox", "workflow/inbox", "settled")
    assert repo.merge_state()["resolved"] == ["workflow/inbox"]
    done = repo.merge_continue()
    assert done["resolved"] == 1 and sorted(repo.snapshot(repo.head())["parents"]) == sorted([head, copy.head()])
    assert paths(repo) == ["go", "kb", "owner", "seed", "workflow/inbox"] and repo.note("workflow/inbox")["body"] == "settled"
    assert repo.merge_state() is None and repo.fsck().count() == 0 and repo.search("settled").count() == 1
    assert copy.pull(repo)["result"] == "fast-forward" and copy.head() == repo.head()


def test_unrelated_histories(spark, repo, tmp_path):
    bulk(repo, {"a": "1"})
    other = Repository(spark, EngineConfig(str(tmp_path / "other"), now=lambda: NOW + 500))
    bulk(other, {"b": "1"})
    with pytest.raises(E.NoCommonHistory):
        repo.pull(other)
    with pytest.raises(E.NoCommonHistory):
        repo.merge(other)
    assert repo.merge(other, allow_unrelated=True)["auto_merged"] == 2 and paths(repo) == ["a", "b"]
    assert other.pull(repo, force=True)["result"] == "fast-forward"


def test_hybrid(repo):
    assert repo.search_hybrid("alpha", HashEmbedder()).count() == 0
    bulk(repo, {"x/one": "alpha beta", "x/two": "beta", "y": "gamma"})
    with pytest.raises(E.NoVectors):
        repo.search_hybrid("alpha", HashEmbedder())
    with pytest.raises(E.EmbedFailed):
        repo.search_hybrid("alpha", None)
    repo.rebuild_embeddings(HashEmbedder())
    found = repo.search_hybrid("beta", HashEmbedder(), limit=2).collect()
    assert len(found) == 2 and found == repo.search_hybrid("beta", HashEmbedder(), limit=2).collect()
    with pytest.raises(E.ModelMismatch):
        repo.search_hybrid("alpha", HashEmbedder("another"))
    repo.rebuild_index()  # keeps the vectors
    assert repo.search_hybrid("beta", HashEmbedder()).count() == 3 and repo.fsck().count() == 0
    repo.set_note("z", "z")  # content drops them
    with pytest.raises(E.NoVectors):
        repo.search_hybrid("alpha", HashEmbedder())


def test_retention(repo):
    snapshots = [repo.set_note("n", "n", f"body{i}") for i in range(4)]
    repo.gc(keep_last=2)
    assert repo.search("body3").count() == 1 and repo.note("n", snapshots[0])["body"] == "body0"
    with pytest.raises(E.IndexPruned):
        repo.search("body0", snapshots[0])
    assert repo.fsck().count() == 0
    assert {r["check"]: r["status"] for r in repo.doctor()}["gc-protect"] == "warn"


def test_interchange(spark, repo, tmp_path):
    bulk(repo, {"a/one": "text\nmore", "two": "second"})
    folder = str(tmp_path / "md")
    assert formats.write_markdown(repo.export_markdown(), folder) == 2
    with pytest.raises(E.BadBatch):
        formats.write_markdown(repo.export_markdown(), folder)
    notes = formats.read_markdown(spark, folder)
    assert repo.import_markdown(notes) == {"changed": 0, "skipped": 2}
    with open(f"{folder}/two.md", "a") as f:
        f.write("!")
    assert repo.import_markdown(formats.read_markdown(spark, folder)) == {"changed": 1, "skipped": 1}
    assert repo.note("two")["body"] == "second!"
    os.makedirs(f"{folder}/two")
    with open(f"{folder}/two/x.md", "w") as f:
        f.write("no front matter")
    with open(f"{folder}/readme.txt", "w") as f:
        f.write("x")
    with pytest.raises(E.BadBatch) as error:
        formats.read_markdown(spark, folder)
    assert len(error.value.problems) == 3
    lines = str(tmp_path / "dump")
    repo.dump().write.text(lines)
    with pytest.raises(E.LibraryNotEmpty):
        repo.restore(spark.read.text(lines))
    fresh = Repository(spark, EngineConfig(str(tmp_path / "fresh"), now=Clock()))
    assert fresh.restore(spark.read.text(lines))["version"] == 6
    assert fresh.head() == repo.head() and paths(fresh) == paths(repo) and fresh.fsck().count() == 0
    assert fresh.search("second").count() == 1
    old = spark.read.text(lines).withColumn("value", F.regexp_replace("value", '"schema_version":6', '"schema_version":3'))
    with pytest.raises(E.VersionMismatch):
        fresh.restore(old, force=True)
    damaged = spark.read.text(lines).withColumn("value", F.regexp_replace("value", '"data":"[A-Za-z0-9+/=]+"', '"data":"eA=="'))
    with pytest.raises(E.InvalidObject):
        fresh.restore(damaged, force=True)


def test_two_writers_lose_nothing(spark, repo):
    """A second handle commits while the first one is about to publish: the first fails, and what it read is still whole."""
    bulk(repo, {"a": "1"})
    other = Repository(spark, EngineConfig(repo.config.warehouse, now=Clock()))
    publish = repo.store.publish

    def late(change):
        repo.store.publish = publish
        bulk(other, {"b": "from the other"})
        return publish(change)

    repo.store.publish = late
    with pytest.raises(E.HeadMoved):
        repo.set_note("c", "C")
    assert paths(repo) == ["a", "b"]
    repo.set_note("c", "C")
    assert paths(repo) == ["a", "b", "c"] and repo.log().count() == 3 and repo.fsck().count() == 0


def test_pointer_tables_take_all_changes(spark, tmp_path):
    """Many threads change one table at once; every change is there in the end."""
    store = Warehouse(spark, str(tmp_path / "library"))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: store.meta_set(f"k{i}", str(i)), range(40)))
    assert {store.meta_get(f"k{i}") for i in range(40)} == {str(i) for i in range(40)}
    assert not store._publish(store._record(store.manifest().version), b"[]")


@pytest.mark.usual
def test_plans_as_users_run_them(spark, tmp_path, monkeypatch):
    """Adaptive execution and code generation on; history longer than a chain of deltas, read and collected in one go."""
    monkeypatch.setattr(repository, "FULL_EVERY", 3)
    repo = Repository(spark, EngineConfig(str(tmp_path / "library"), now=Clock()))
    first = bulk(repo, {f"d{i % 3}/n{i}": f"word{i} common" for i in range(30)})
    addrs = [first] + [repo.set_note(f"d0/n{3 * (i % 2)}", "t", f"edit {i}") for i in range(4)]
    wanted = spark.createDataFrame([(a,) for a in addrs[::2]], "snapshot string")
    got = {(r["snapshot"], r["path"], r["addr"]) for r in repo.entries_of(wanted).collect()}
    assert got == {(a, r["path"], r["addr"]) for a in addrs[::2] for r in repo.entries(a).collect()}
    assert repo.search("common").count() == 28 and repo.fsck().count() == 0
    note = repo.note("d0/n0")
    files = spark.createDataFrame([("d0/n0", "t", [], "edit 0"), ("new", "t", [], "x")], "path string, title string, tags array<string>, body string")
    assert repo.import_markdown(files) == {"changed": 2, "skipped": 0}
    assert repo.note("d0/n0")["created_at"] == repo.note("d0/n0", addrs[1])["created_at"] != note["created_at"]
    kept = []
    repo.gc(keep_last=3, backup=kept.extend)
    assert [b["addr"] for b in kept] == [repo.head()] and repo.search("common").count() == 28
    assert repo.fsck().count() == 0


def test_rebuild_mends_the_index(spark, repo):
    bulk(repo, {"a": "alpha", "b": "beta"})
    store = repo.store
    store.rewrite("postings", store.relation("postings").withColumn("tf_body", F.col("tf_body") + 1))
    store.rewrite("docs", store.relation("docs").where("path = 'a'"))
    assert repo.search("beta").count() == 0 and "wrong postings in the index: a" in {r["problem"] for r in repo.fsck().collect()}
    repo.rebuild_index()
    assert repo.search("beta").count() == 1 and repo.fsck().count() == 0


def test_collection_stops_if_the_backup_fails(repo):
    first = bulk(repo, {"a": "1"})
    repo.set_note("a", "a", "2")
    repo.reset(first)
    n = repo.unreachable_count()

    def fail(rows):
        raise OSError("no room")

    with pytest.raises(OSError):
        repo.gc(backup=fail)
    assert n and repo.unreachable_count() == n


def test_bulk_lines_over_several_files(spark, repo, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    line = lambda p, b: json.dumps({"path": p, "title": p, "tags": [], "body": b}) + "\n"
    (folder / "1.jsonl").write_text(line("n", "first") + line("m", "m"))
    (folder / "2.jsonl").write_text(line("k", "k" * 50_000) + line("n", "last"))
    rows = formats.read_jsonl(spark, str(folder))
    none = {"links": F.lit(None).cast("array<struct<slug:string,rel:string>>"), "created_at": F.lit(None).cast("long")}
    repo.bulk_import(rows.repartition(3).withColumns(none))
    assert repo.note("n")["body"] == "last" and paths(repo) == ["k", "m", "n"]
    (folder / "3.jsonl").write_text(line("q", "q") + "\nnot json\n" + line("/bad/", "x"))
    with pytest.raises(E.BadBatch) as error:
        formats.read_jsonl(spark, str(folder))
    assert error.value.problems == ["3.jsonl line 3: not a bulk line", "3.jsonl line 4: bad path (/bad/)"]


def test_doctor_checks(spark, repo):
    bulk(repo, {"a": "1"})
    assert [r["check"] for r in repo.doctor()] == list(repo.CHECKS)
    assert [r["check"] for r in repo.doctor(["serve", "storage"], "http://127.0.0.1:9")] == ["storage", "serve"]
    assert repo.doctor(["serve"], "http://127.0.0.1:9")[0]["status"] == "warn"
    with pytest.raises(E.NotFound):
        repo.doctor(["none"])


def test_command_line_and_http_agree(spark, tmp_path):
    library = str(tmp_path / "library")
    run = lambda *a: cli.run(spark, ["--library", library, *a])
    run("note-set", "go/channel", "--title", "Channel", "--body", "about channel", "--tags", "go, x")
    with open(tmp_path / "bulk.jsonl", "w") as f:
        f.write(json.dumps({"path": "b", "title": "B", "tags": [], "body": "bulk"}) + "\n\n")
    run("bulk-import", str(tmp_path / "bulk.jsonl"))
    repo = Repository(spark, EngineConfig(library))
    get = lambda url: http.answer(repo, "GET", url)
    assert get("/api/v1/search?q=channel")[1] == run("search", "channel")
    assert get("/api/v1/log?limit=1")[1] == run("log", "-n", "1")
    assert get("/api/v1/note?path=b")[1] == run("note-get", "b") == {"path": "b", "title": "B", "tags": [], "body": "bulk"}
    assert get("/api/v1/note?path=none")[0] == 404 and get("/api/v1/search?q=a&limit=0")[0] == 400 and get("/nothing")[0] == 404
    assert get("/api/v1/search?q=a&mode=hybrid")[0] == 409 and get("/healthz")[1]["schema_version"] == "6"
    assert get("/api/v1/merge-state")[1]["state"] == "idle"
    body = json.dumps({"path": "c", "title": "C"}).encode()
    assert http.answer(repo, "POST", "/api/v1/note", body)[0] == 403
    assert http.answer(repo, "POST", "/api/v1/note", body, "Bearer x", "t")[0] == 401
    assert http.answer(repo, "POST", "/api/v1/note", body, "Bearer t", "t")[0] == 200
    assert [r["slug"] for r in run("note-ls")] == ["b", "c", "channel"]
    assert run("doctor")[1]["status"] == "ok" and "channel" in run("dir-tree")


def test_stream(spark, repo, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text(json.dumps({"path": "a", "title": "A", "tags": [], "body": "x"}) + "\nnot json\n")
    for _ in range(2):  # the second run finds nothing new
        ingest(repo, str(folder), str(tmp_path / "checkpoint")).awaitTermination()
    assert paths(repo) == ["a"] and repo.log().count() == 1
    (folder / "2.jsonl").write_text(json.dumps({"path": "b", "title": "B", "tags": [], "body": "y"}) + "\n")
    ingest(repo, str(folder), str(tmp_path / "checkpoint")).awaitTermination()
    assert paths(repo) == ["a", "b"] and repo.log().count() == 2


def test_postings_travel_and_lie_by_note(spark, tmp_path):
    """No path and address is sent or stored with every term, and lengths summed from postings are those of the notes."""
    body = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), (i * (F.col("id") % 7 + 1)).cast("string"))))
    rows = spark.range(300).select(F.concat(F.lit("a/n"), F.col("id").cast("string")).alias("path"), F.lit("!").alias("title"), F.when(F.col("id") == 0, "").otherwise(body).alias("body"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("array<struct<slug: string, rel: string>>").alias("links"), F.lit(1).cast("long").alias("created_at"))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    plan = search.postings_of(rows.withColumn("addr", F.sha2("path", 256)))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert "hashpartitioning(path" in plan and not re.search(r"hashpartitioning\([^)]*term", plan)
    repo = Repository(spark, EngineConfig(str(tmp_path / "lib"), now=lambda: 7))
    repo.bulk_import(rows)
    (segment,) = repo.store.manifest().segments["postings"]
    assert segment["rows"] == 299 * 200 and segment["bytes"] < 15 * segment["rows"]
    want = search.docs_of(repo.list_notes())
    assert sorted(map(tuple, repo.store.relation("docs").collect())) == sorted(map(tuple, want.collect()))
    assert [r["len"] for r in want.collect()].count(0) == 1


def test_postings_are_written_by_themselves(spark, tmp_path, monkeypatch):
    """A commit's small writes don't wait behind the index, and a commit without new notes doesn't read any."""
    from marlstone.sources.warehouse import Warehouse

    repo, open_now, seen, write = Repository(spark, EngineConfig(str(tmp_path / "lib"))), set(), [], Warehouse.write_segment

    def watched(self, name, *args, **kwargs):
        seen.append((name, sorted(open_now)))
        open_now.add(name)
        try:
            return write(self, name, *args, **kwargs)
        finally:
            open_now.discard(name)

    monkeypatch.setattr(Warehouse, "write_segment", watched)
    repo.bulk_import(repo.inputs([{"path": "a/x", "title": "X", "body": "one"}, {"path": "a/y", "title": "Y", "body": "two"}]))
    names = [n for n, _ in seen]
    assert dict(seen)["postings"] == [] and {"objects", "edges", "deltas", "snapshots"} <= set(names[: names.index("postings")])
    seen.clear()
    repo.remove_notes(spark.createDataFrame([("a/x",)], "path string"))
    assert not {"postings", "docs"} & {n for n, _ in seen}
    seen.clear()
    repo.gc(keep_last=1)
    assert dict(seen)["postings"] == [] and [n for n, _ in seen][-1] == "postings"
    assert {r["path"] for r in repo.search("two").collect()} == {"a/y"}
