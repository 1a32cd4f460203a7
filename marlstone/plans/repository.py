"""A versioned knowledge base: the commit protocol and everything built on it.

A commit is one transaction of the warehouse: immutable rows (objects and their references,
notes, entry deltas, index rows) and the branch that moves with them are published together or
not at all. Snapshots keep what changed against their base; every ``FULL_EVERY`` snapshots the
whole relation is written. Each has a place on a line of the graph (operators/lines.py), so
history costs no step per snapshot. The index is keyed by path and address, so a commit only
adds rows for pairs never indexed before, and the index of any snapshot is what its entries select.

Deliberate choices: vectors of a snapshot are transferred with it; listings are depth
first by segment; parents are sorted by address, and the log follows the first of them;
tags are compared sorted; a missing index or vector relation never fails a collection.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from ..functions.encoding import decode, encode_note
from ..functions.scalars import address, ancestors_of, note_path, path_parts, tags_equal, tags_or_empty
from ..lineage import at_once, counted, cut, shared_dir
from ..operators import dag, lines, objects, search, tree, versions
from ..schema import ENTRIES, LINKS, NOTE_INPUT, EngineConfig
from ..sources import formats
from ..sources.embed import Embedder, check_uniform, embedded, vector_objects, vectors_of
from ..sources.foreign import ForeignLibrary
from ..sources.warehouse import Manifest, Transaction, Warehouse, open_warehouse

FULL_EVERY = 16
STAGE_MESSAGE, MERGE_MESSAGE = "stage base", "merge"


def canonical(fields: dict) -> str:
    """Canonical JSON of a small object built on the driver."""
    text = json.dumps({k: v for k, v in fields.items() if v not in (None, [], "") or k in ("entries", "message")}, ensure_ascii=False, separators=(",", ":"))
    for plain, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        text = text.replace(plain, code)
    return text


def is_note_path(path: str) -> bool:
    try:
        note_path(path)
    except E.InvalidPath:
        return False
    return True


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Repository:
    """A project's branch in a warehouse. Handles are cheap; state lives in the warehouse."""

    def __init__(self, spark: SparkSession, config: EngineConfig, warehouse: Warehouse | None = None):
        self.spark, self.config = spark, config
        self.store = warehouse or open_warehouse(spark, config.warehouse)
        self.project, self.branch = config.project, config.branch

    def on(self, **changes) -> Repository:
        """The same library under another project, branch or clock."""
        return Repository(self.spark, replace(self.config, **changes), self.store)

    # snapshots

    def head(self) -> str | None:
        try:
            return self.store.branch_get(self.project, self.branch)
        except E.BranchNotFound:
            return None

    def snapshots(self) -> DataFrame:
        return self.store.relation("snapshots")

    def snapshot(self, addr: str) -> Row:
        # Between collections a snapshot's row never changes, so once read it stays good for this library's handles.
        known, epoch = self.store.known_snapshots, self.store.manifest().epoch
        if epoch != self.store.known_epoch:
            known.clear()
            self.store.known_epoch = epoch
        if addr not in known:
            row = self.snapshots().where(F.col("addr") == addr).head()
            if row is None:
                raise E.NotFound(f"no snapshot {addr}")
            known[addr] = row
        return known[addr]

    def _has_snapshot(self, addr: str) -> bool:
        try:
            self.snapshot(addr)
        except E.NotFound:
            return False
        return True

    def project_heads(self, every: bool = False) -> list[str]:
        return sorted({b["addr"] for b in self.store.branch_list(None if every else self.project)})

    def resolve(self, name: str) -> str:
        """A full address, a short one, a branch, or a prefix of a snapshot reachable from this project."""
        if name.startswith("sha256:") and len(name) == 71:
            return self.snapshot(name)["addr"]
        if not name.startswith("sha256:"):
            try:
                return self.store.branch_get(self.project, name)
            except E.BranchNotFound:
                pass
        prefix = name if name.startswith("sha256:") else "sha256:" + name
        return dag.by_prefix(lines.reachable(self.snapshots(), self.project_heads()).withColumnRenamed("addr", "node"), prefix)

    def _at(self, ref: str | None) -> str | None:
        return self.head() if ref is None else self.resolve(ref)

    def empty_entries(self) -> DataFrame:
        return self.spark.createDataFrame([], ENTRIES)

    def entries(self, addr: str | None) -> DataFrame:
        """Entries of a snapshot, from its chain of deltas; the newest row of a path counts."""
        if addr is None:
            return self.empty_entries()
        chain = [self.snapshot(addr)]
        while chain[-1]["chain"]:
            chain.append(self.snapshot(chain[-1]["base"]))
        names = [s["addr"] for s in chain]
        rows = self.store.relation("deltas").where(F.col("snapshot").isin(names))
        if len(names) > 1:
            age = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))
            latest = rows.withColumn("_age", age[F.col("snapshot")]).groupBy("path").agg(F.min_by(F.struct("parent", "slug", "depth", "type", "addr", "deleted"), "_age").alias("e"))
            rows = latest.select("path", "e.*")
        return rows.where("not deleted").select(*tree.COLUMNS)

    def entries_of(self, wanted: DataFrame, paths: DataFrame | None = None) -> DataFrame:
        """Entries of all snapshots of ``wanted(snapshot)`` with their snapshot, of ``paths(path)`` alone if given.

        As many joins as a chain is long at most, however many snapshots, then one aggregation.
        """
        links = self.snapshots().select(F.col("addr").alias("member"), "base", "chain")
        frontier = wanted.select("snapshot").distinct().join(links, F.col("snapshot") == F.col("member")).select("snapshot", "member", "base", "chain", F.lit(0).alias("age"))
        members = []
        for age in range(1, FULL_EVERY + 1):
            frontier = cut(frontier)
            members.append(frontier.select("snapshot", "member", "age"))
            more = frontier.where("chain > 0").select("snapshot", F.col("base").alias("member"))
            if more.isEmpty():
                break
            frontier = more.join(links, "member").select("snapshot", "member", "base", "chain", F.lit(age).alias("age"))
        rows = self.store.relation("deltas").withColumnRenamed("snapshot", "member")
        if paths is not None:
            rows = rows.join(paths.select("path"), "path", "left_semi")
        latest = rows.join(union(members), "member").groupBy("snapshot", "path").agg(F.min_by(F.struct("parent", "slug", "depth", "type", "addr", "deleted"), "age").alias("e"))
        return latest.select("snapshot", "path", "e.*").where("not deleted").select("snapshot", *tree.COLUMNS)

    def leaves(self, ref: str | None = None) -> DataFrame:
        return tree.leaves(self.entries(self._at(ref)))

    def notes(self) -> DataFrame:
        return self.store.relation("notes")

    # commits

    def _commit(self, changes: DataFrame, message: str, parents: list[str] | None = None, base: str | None = "", expected: str | None = "", vectors: str = "") -> str:
        """One snapshot of ``changes(path, type, addr, deleted)``, published by itself."""
        head = self.head()
        return self.store.transact(lambda tx: self._commit_in(tx, changes, message, head, parents, base, expected=expected, vectors=vectors))

    def _commit_in(self, tx: Transaction, changes: DataFrame, message: str, head: str | None, parents: list[str] | None = None, base: str | None = "", new_objects: list[DataFrame] = (), expected: str | None = "", vectors: str = "") -> str:
        """Applies ``changes(path, type, addr, deleted)`` to a snapshot's entries and adds the result to a transaction.

        Without ``parents`` the branch's ``head`` is the only one. The write fails if the head isn't that any more,
        or ``expected`` if that is given.
        """
        base = head if base == "" else base
        parents = ([head] if head else []) if parents is None else parents
        old = self.entries(base)
        changes = cut(tree.located(changes.select("path", "type", "addr", "deleted")))
        adds, dirs = changes.where("not deleted"), old.where("type = 'dir'").select("path")
        above = changes.select(F.explode(ancestors_of("path")).alias("path")).distinct()
        needed = adds.select(F.explode(ancestors_of("path")).alias("path")).distinct().join(dirs, "path", "left_anti").join(adds.select("path"), "path", "left_anti")
        clash = needed.join(old.where("type = 'note'").join(changes.where("deleted").select("path"), "path", "left_anti").select("path"), "path", "left_semi").unionByName(adds.where("type = 'note'").select("path").join(dirs.join(changes.where("deleted").select("path"), "path", "left_anti"), "path", "left_semi")).head()
        if clash:
            raise E.EntryTypeConflict(f"{clash['path']!r} is a note and a directory")
        added = adds.unionByName(tree.located(needed.select("path", F.lit("dir").alias("type"), F.lit(None).cast("string").alias("addr"), F.lit(False).alias("deleted"))))
        now = cut(old.join(changes.select("path"), "path", "left_anti").select(*tree.COLUMNS).unionByName(added.select(*tree.COLUMNS)))
        dirty = cut(above.unionByName(added.where("type = 'dir'").select("path")).distinct().join(now.where("type = 'dir'").select("path"), "path", "left_semi"))
        built, trees, root = tree.tree_addresses(now, dirty)
        time = self.config.now()
        # A generation that is stored as objects is named by its root's address.
        data = canonical({"kind": "snapshot", "root": root, "parents": sorted(parents), "time": time, "message": message, "vec": vectors if vectors.startswith("sha256:") else ""})
        addr = "sha256:" + hashlib.sha256(data.encode()).hexdigest()
        chain = self.snapshot(base)["chain"] + 1 if base else 0
        chain = chain % FULL_EVERY
        touched = dirty.unionByName(added.select("path")).distinct()
        delta = built if not chain else built.join(touched, "path", "left_semi")
        delta = delta.withColumn("deleted", F.lit(False))
        if chain:
            delta = delta.unionByName(changes.where("deleted").select(*tree.COLUMNS, "deleted").join(adds.select("path"), "path", "left_anti"))
        fresh = not self._has_snapshot(addr)
        own = self.spark.createDataFrame([("snapshot", data.encode())], "kind string, data binary")

        def snapshot() -> None:
            line, place, ups = self._line(addr, sorted(parents), head)
            row = [(addr, root, sorted(parents), time, message, base, chain, self.config.indexed, vectors or None, line, place, ups)]
            tx.append("snapshots", self.spark.createDataFrame(row, self.snapshots().schema))

        writes = [lambda: tx.put(union([*new_objects, trees, own]))]
        if fresh:
            writes += [lambda: tx.append("deltas", delta.withColumn("snapshot", F.lit(addr))), snapshot]
        at_once(*writes)
        if fresh and self.config.indexed:
            # By itself: it takes all cores for as long as there are texts, and a small write's broadcast that waits for a core
            # fails after spark.sql.broadcastTimeout.
            self._index(tx, tree.leaves(added.where("type = 'note'")))
        tx.move(self.project, self.branch, addr, head if expected == "" else expected)
        return addr

    def _line(self, addr: str, parents: list[str], head: str | None) -> tuple[str, int, list[tuple[str, int]]]:
        """A new snapshot's line, place and other parents' coordinates. The branch's line goes on where no other snapshot
        has taken the place; stages and the like always begin their own."""
        at = [(r["line"], r["place"]) for r in (self.snapshot(p) for p in parents)]
        if parents and parents[0] == head and self.config.indexed:
            line, place = at[0][0], at[0][1] + 1
            if self.snapshots().where((F.col("line") == line) & (F.col("place") == place)).isEmpty():
                return line, place, at[1:]
        return addr, 0, at

    def _index(self, tx: Transaction, pairs: DataFrame) -> None:
        """Index rows of (path, address) pairs that have none yet. Lengths are summed from the postings, so texts are read once."""
        pairs, n = counted(tx.lacking("docs", pairs).select("path", "addr"))
        if not n:
            return
        notes = tx.relation("notes")
        segment = tx.append("postings", self._postings(notes, pairs), dealt=True)
        made = self.store.read_segments("postings", [segment] if segment else [])
        tx.append("docs", search.docs_from(made, pairs.join(notes.select("addr"), "addr", "left_semi")))

    def _postings(self, notes: DataFrame, pairs: DataFrame) -> DataFrame:
        """Postings of ``pairs(path, addr)``: the join deals notes by address, and terms are counted there."""
        rows = pairs.join(notes.select("addr", "title", "tags", "body").hint("merge"), "addr")
        return search.bucketed(search.postings_of(rows, together=True))

    def _index_rows(self, tx: Transaction, pairs: DataFrame) -> dict[str, DataFrame]:
        rows = pairs.join(tx.relation("notes").select("addr", "title", "tags", "body"), "addr")
        return {"postings": self._postings(tx.relation("notes"), pairs), "docs": search.docs_of(rows)}

    def _encoded(self, inputs: DataFrame) -> tuple[DataFrame, str]:
        """Checked notes with their canonical form and address, in a compressed file of their own: texts are most of a commit.
        The caller forgets it."""
        bad = inputs.where(F.coalesce(F.trim("title"), F.lit("")) == "").union(inputs.where(~formats.valid_path("path"))).select("path", "title").head()
        if bad and not is_note_path(bad["path"]):
            raise E.InvalidPath(bad["path"])
        if bad:
            raise E.InvalidObject(f"{bad['path']!r} has no title")
        rows = inputs.select("path", "title", tags_or_empty("tags").alias("tags"), F.coalesce("created_at", F.lit(self.config.now())).alias("created_at"), "links", F.coalesce("body", F.lit("")).alias("body"))
        rows = rows.withColumn("json", encode_note("title", "tags", "created_at", address("body"), "links")).withColumn("addr", address("json"))
        folder = f"{shared_dir(self.spark).rstrip('/')}/notes-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder), folder

    def _commit_notes(self, inputs: DataFrame, message: str) -> str:
        """Notes and the snapshot that has them, in one transaction."""
        head = self.head()
        rows, folder = self._encoded(inputs)

        def work(tx: Transaction) -> str:
            tx.append("notes", tx.lacking("notes", rows.dropDuplicates(["addr"]), rows).withColumn("tags", F.array_sort("tags")), dealt=True)
            new = [rows.select(F.lit("blob").alias("kind"), F.col("body").cast("binary").alias("data")), rows.select(F.lit("note").alias("kind"), F.col("json").cast("binary").alias("data"))]
            return self._commit_in(tx, self._note_changes(rows), message, head, new_objects=new)

        try:
            return self.store.transact(work)
        finally:
            self.store.forget(folder)

    def inputs(self, items: list[dict]) -> DataFrame:
        """Note inputs from plain values."""
        return self.spark.createDataFrame([(i["path"], i.get("title"), i.get("body", ""), i.get("tags"), i.get("links"), i.get("created_at")) for i in items], NOTE_INPUT)

    def _writable(self) -> None:
        if self.merge_state() is not None:
            raise E.Merging(f"{self.branch} has an unfinished merge")

    def _note_changes(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("path", F.lit("note").alias("type"), "addr", F.lit(False).alias("deleted"))

    def set_note(self, path: str, title: str, body: str = "", tags: list[str] | None = None, links: list | None = None, created_at: int | None = None, message: str = "set note") -> str:
        return self.bulk_import(self.inputs([{"path": path, "title": title, "body": body, "tags": tags, "links": links, "created_at": created_at}]), message)

    def bulk_import(self, inputs: DataFrame, message: str = "bulk import") -> str:
        """All inputs in one snapshot; of several with one path the last (by ``seq`` if there is one) counts."""
        self._writable()
        if "seq" not in inputs.columns:
            inputs = inputs.withColumn("seq", F.monotonically_increasing_id())
        return self._commit_notes(tree.last_wins(inputs, "path", "seq"), message)

    def _one(self, path: str, ref: str | None = None) -> Row:
        parts = path_parts(note_path(path))
        wanted = ["/".join(parts[:i]) for i in range(1, len(parts) + 1)]
        found = {r["path"]: r for r in self.entries(self._at(ref)).where(F.col("path").isin(wanted)).collect()}
        for p in wanted[:-1]:
            if p in found and found[p]["type"] == "note":
                raise E.EntryTypeConflict(f"{p!r} is a note")
        if path not in found:
            raise E.NotFound(path)
        if found[path]["type"] != "note":
            raise E.EntryTypeConflict(f"{path!r} is a directory")
        return found[path]

    def remove_note(self, path: str, message: str = "remove note") -> str:
        self._writable()
        self._one(path)
        return self._commit(self.spark.createDataFrame([(path, "note", None, True)], "path string, type string, addr string, deleted boolean"), message)

    def remove_notes(self, paths: DataFrame, message: str = "remove notes") -> str:
        """Takes away all notes of ``paths(path)`` in one snapshot; paths without a note are no error."""
        self._writable()
        gone = self.leaves().join(paths.select("path"), "path", "left_semi")
        return self._commit(gone.select("path", F.lit("note").alias("type"), "addr", F.lit(True).alias("deleted")), message)

    def note(self, path: str, ref: str | None = None) -> Row:
        """One note, now or at a snapshot."""
        entry = self._one(path, ref)
        return self.notes().where(F.col("addr") == entry["addr"]).withColumn("path", F.lit(path)).head()

    def list_notes(self, directory: str = "", ref: str | None = None, bodies: bool = True) -> DataFrame:
        entries = self.entries(self._at(ref))
        tree.check_dir(entries, directory)
        return tree.walk_notes(entries, self.notes(), directory, bodies)

    def mkdir(self, path: str, message: str = "mkdir") -> str | None:
        """Creates a directory and those above it; nothing is committed if it is there."""
        self._writable()
        parts = path_parts(path)
        entries = self.entries(self.head())
        if not parts or tree.dir_exists(entries, path):
            return self.head()
        return self._commit(self.spark.createDataFrame([(path, "dir", None, False)], "path string, type string, addr string, deleted boolean"), message)

    def remove_dir(self, path: str, recursive: bool = False, message: str = "remove dir") -> str:
        self._writable()
        entries = self.entries(self.head())
        tree.check_dir(entries, path)
        below = entries.where((F.col("path") == path) | F.col("path").startswith(path + "/"))
        if not recursive and below.count() > 1:
            raise E.DirectoryNotEmpty(path)
        return self._commit(below.select("path", "type", "addr", F.lit(True).alias("deleted")), message)

    def resolve_link(self, slug: str, ref: str | None = None) -> dict:
        return tree.resolve_link(self.entries(self._at(ref)), slug)

    def dir_ls(self, path: str = "", ref: str | None = None) -> DataFrame:
        entries = self.entries(self._at(ref))
        tree.check_dir(entries, path)
        return tree.dir_ls(entries, path)

    def dir_tree(self, ref: str | None = None) -> dict:
        return tree.nested(self.entries(self._at(ref)), self.notes())

    def all_trees(self) -> dict[str, dict]:
        """Every project's tree; projects without snapshots are empty."""
        out = {}
        for p in self.store.project_stats().collect():
            view = self.on(project=p["name"])
            out[p["name"]] = view.dir_tree()
        return out

    # history

    def log(self, ref: str | None = None) -> DataFrame:
        """Snapshots along first parents, newest first."""
        start = self._at(ref)
        if start is None:
            return self.snapshots().limit(0).withColumn("depth", F.lit(0))
        return lines.log(self.snapshots(), self._starts(start)).select("addr", F.col("depth").cast("int").alias("depth")).join(self.snapshots(), "addr").orderBy("depth")

    def _starts(self, *addrs: str) -> DataFrame:
        return self.spark.createDataFrame([(a,) for a in addrs], "start string")

    def diff(self, base: str | None, tip: str | None) -> DataFrame:
        """Changed notes between two references; none is the empty tree."""
        side = lambda ref: tree.leaves(self.entries(None if ref is None else self.resolve(ref)))
        return versions.diff(side(base), side(tip)).orderBy("path")

    def reset(self, ref: str) -> int:
        """Moves the branch back to an ancestor; gives the number of snapshots given up."""
        target, head = self.resolve(ref), self.head()
        if head is None:
            raise E.NotFound("the branch has no snapshot")
        reached = cut(lines.closure(self.snapshots(), self._starts(head, target)))
        at = self.snapshot(target)
        if reached.where((F.col("start") == head) & (F.col("line") == at["line"]) & (F.col("place") >= at["place"])).isEmpty():
            raise E.NotAncestor(f"{target} is no ancestor of {head}")
        sizes = {r["start"]: r["n"] for r in lines.count(reached).collect()}
        lost = sizes[head] - sizes[target]
        self.store.branch_set(self.project, self.branch, target, head)
        return lost

    # search

    def index(self, ref: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Postings and docs of a snapshot: what its entries select."""
        addr = self._at(ref)
        pairs = tree.leaves(self.entries(addr))
        if addr is not None:
            if not self.snapshot(addr)["indexed"]:
                raise E.NoIndex(addr)
            keep = self.store.meta_get("gc.keep_last", None)
            if keep is not None and int(keep) > 0:
                if lines.depths(self.snapshots(), self._starts(*self.project_heads(every=True)), int(keep)).where(F.col("addr") == addr).isEmpty():
                    raise E.IndexPruned(addr)
        pick = lambda rows: rows.join(pairs, ["path", "addr"], "left_semi")
        return pick(self.store.relation("postings")), pick(self.store.relation("docs"))

    def search(self, query: str, ref: str | None = None, limit: int | None = None, snippet: bool = False) -> DataFrame:
        postings, docs = self.index(ref)
        found = search.search(postings, docs, query, limit)
        return search.materialised(found, self.notes(), query if snippet else None).orderBy(F.col("score").desc(), "path", "addr")

    def rebuild_index(self, message: str = "rebuild index") -> str:
        """Makes every index row of the head's notes anew, whatever the index holds for them, in a new snapshot, which
        keeps the head's vectors."""
        head = self.head()
        if head is None:
            raise E.NotFound("nothing to index")
        pairs = cut(tree.leaves(self.entries(head)))

        def rebuilt(record: Manifest) -> dict[str, DataFrame]:
            out = {}
            for name, rows in self._index_rows(Transaction(self.store), pairs).items():
                old = self.store.read_segments(name, record.segments[name])
                out[name] = old.join(pairs, ["path", "addr"], "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))
            return out

        self.store.replace_segments(rebuilt)
        nothing = self.spark.createDataFrame([], "path string, type string, addr string, deleted boolean")
        return self._commit(nothing, message, vectors=self.snapshot(head)["vectors"] or "")

    def rebuild_embeddings(self, embedder: Embedder, message: str = "rebuild embeddings") -> str:
        head = self.head()
        if head is None:
            raise E.NotFound("nothing to embed")
        rows = tree.leaves(self.entries(head)).join(self.notes().select("addr", "title", "body"), "addr")
        vectors = cut(embedded(rows, embedder))
        check_uniform(vectors)
        made, generation = vector_objects(vectors)
        if made is None:
            generation = hashlib.sha256(f"{head} {embedder.model} {self.config.now()}".encode()).hexdigest()
        nothing = self.spark.createDataFrame([], "path string, type string, addr string, deleted boolean")

        def work(tx: Transaction) -> str:
            # The same notes and model give the same generation, which may be there.
            tx.append("vectors", tx.lacking("vectors", vectors.withColumn("generation", F.lit(generation)), self._starts(generation).withColumnRenamed("start", "generation")))
            return self._commit_in(tx, nothing, message, head, new_objects=[] if made is None else [made], vectors=generation)

        return self.store.transact(work)

    def search_hybrid(self, query: str, embedder: Embedder | None, ref: str | None = None, limit: int | None = None) -> DataFrame:
        """Lexical and vector legs of depth 50, fused by rank; every precondition fails loudly."""
        addr = self._at(ref)
        if addr is None:
            return self.spark.createDataFrame([], "path string, score double")
        if embedder is None:
            raise E.EmbedFailed("no embedding provider")
        generation = self.snapshot(addr)["vectors"]
        if not generation:
            raise E.NoVectors(addr)
        vectors = self.store.relation("vectors").where(F.col("generation") == generation)
        first = vectors.head()
        if first is None:
            raise E.NoVectors(addr)
        if first["model"] != embedder.model:
            raise E.ModelMismatch(f"vectors are by {first['model']!r}, the query by {embedder.model!r}")
        try:
            vector = embedder.embed([query])[0]
        except E.EmbedFailed:
            raise
        except Exception as e:
            raise E.EmbedFailed(str(e)) from e
        postings, docs = self.index(ref)
        qid = F.lit(0).cast("long").alias("qid")
        lexical = search.top(search.search(postings, docs, query).select(qid, "path", "addr", "score"), search.LEG, F.col("score").desc(), "path", "addr")
        semantic = search.top(search.cosine_rank(vectors, vector, search.LEG).select(qid, "path", "sim"), search.LEG, F.col("sim").desc(), "path")
        found = search.fused(lexical, semantic).select("path", "score").orderBy(F.col("score").desc(), "path")
        return found if limit is None else found.limit(limit)

    # stage

    def _side(self, suffix: str) -> Repository:
        return self.on(branch=f"{self.branch}-{suffix}", indexed=False)

    def _work_branch(self) -> Repository:
        """Where staged writes go: the merge's branch while merging, else the stage."""
        if self.merge_state() is not None:
            return self._side("merge")
        side = self._side("stage")
        if side.head() is None:
            head = self.head()
            base = self._marker(side, head)
            self.store.branch_set(self.project, side.branch, base)
        return side

    def _marker(self, side: Repository, head: str | None, message: str = STAGE_MESSAGE) -> str:
        """A snapshot that only marks where a stage or merge began."""
        nothing = self.spark.createDataFrame([], "path string, type string, addr string, deleted boolean")
        return side._commit(nothing, message, parents=[head] if head else [], base=head)

    def _base_of(self, side: Repository) -> str:
        """The marker that a work branch began with: the last one along its first parents."""
        marks = (STAGE_MESSAGE, MERGE_MESSAGE + " base")
        row = side.log().where(F.col("message").isin(*marks)).orderBy("depth").head()
        return row["addr"]

    def stage_note(self, path: str, title: str, body: str = "", tags: list[str] | None = None) -> str:
        side = self._work_branch()
        return side._commit_notes(side.inputs([{"path": note_path(path), "title": title, "body": body, "tags": tags}]), "stage")

    def stage_remove_note(self, path: str) -> str:
        side = self._work_branch()
        side._one(path)
        return side._commit(self.spark.createDataFrame([(path, "note", None, True)], "path string, type string, addr string, deleted boolean"), "stage")

    def stage_remove_dir(self, path: str) -> str:
        side = self._work_branch()
        entries = side.entries(side.head())
        tree.check_dir(entries, path)
        below = entries.where((F.col("path") == path) | F.col("path").startswith(path + "/"))
        return side._commit(below.select("path", "type", "addr", F.lit(True).alias("deleted")), "stage")

    def _staged(self, side: Repository) -> DataFrame:
        return versions.stage_changes(side.leaves(self._base_of(side)), side.leaves())

    def stage_status(self) -> DataFrame:
        side = self._side("stage")
        if side.head() is None:
            return self.spark.createDataFrame([], "op string, path string")
        return self._staged(side).select("op", "path").orderBy("path")

    @staticmethod
    def _as_changes(staged: DataFrame) -> DataFrame:
        return staged.select("path", F.lit("note").alias("type"), "addr", (F.col("op") == "D").alias("deleted"))

    def commit_stage(self, message: str = "commit stage") -> int:
        """Applies the stage over the present head in one snapshot; gives the number of changes."""
        self._writable()
        side = self._side("stage")
        if side.head() is None:
            raise E.NothingStaged(self.branch)
        staged = cut(self._staged(side))
        n = staged.count()
        if not n:
            raise E.NothingStaged(self.branch)
        # Deleting what the head no longer has is no change.
        present = self.leaves().select("path")
        changes = staged.where("op <> 'D'").unionByName(staged.where("op = 'D'").join(present, "path", "left_semi"))
        self._commit(self._as_changes(changes), message)
        self.store.branch_delete(self.project, side.branch)
        return n

    def abort_stage(self) -> None:
        self.store.branch_delete(self.project, self._side("stage").branch)

    # transfer and merge

    def _copy_from(self, source: Repository, head: str, move: bool, ours: str | None = None) -> int:
        """Everything reachable from ``head`` that is missing here, and the branch if it is to ``move``, in one transaction;
        gives the number of objects."""
        reached = cut(lines.reachable(source.snapshots(), [head]))
        marked = cut(objects.marked(source.store.relation("edges"), reached.withColumnRenamed("addr", "node")))

        def work(tx: Transaction) -> int:
            new = tx.append("objects", tx.lacking("objects", source.store.relation("objects").join(marked, "addr", "left_semi")), dealt=True)
            tx.append("edges", tx.lacking("edges", source.store.relation("edges").join(marked.withColumnRenamed("addr", "src"), "src", "left_semi")))
            lacking = cut(tx.lacking("snapshots", source.snapshots().join(reached, "addr", "left_semi")))
            deltas = source.store.relation("deltas").join(lacking.select(F.col("addr").alias("snapshot")), "snapshot", "left_semi")
            held = cut(deltas.where("type = 'note' and not deleted").select("path", "addr").distinct())
            tx.append("notes", tx.lacking("notes", source.notes().join(held, "addr", "left_semi")), dealt=True)
            pairs = cut(tx.lacking("docs", held))
            # Postings are made again: sending texts takes less room than sending a path and an address for each of their terms.
            self._index(tx, source.store.relation("docs").join(pairs, ["path", "addr"], "left_semi").select("path", "addr"))
            generations = lacking.where("vectors is not null").select(F.col("vectors").alias("generation")).distinct()
            tx.append("vectors", tx.lacking("vectors", source.store.relation("vectors").join(generations, "generation", "left_semi")))
            tx.append("deltas", deltas)
            tx.append("snapshots", self._on_lines(tx, source, lacking, reached))
            if move:
                tx.move(self.project, self.branch, head, ours)
            return new["rows"] if new else 0

        return self.store.transact(work)

    def _on_lines(self, tx: Transaction, source: Repository, lacking: DataFrame, reached: DataFrame) -> DataFrame:
        """Snapshots to copy, with the source's coordinates where these agree with those here, else with new ones."""
        here = tx.relation("snapshots")
        shared = source.snapshots().join(reached, "addr", "left_semi").select("addr", "line", "place").join(here.select("addr", F.col("line").alias("_l"), F.col("place").alias("_p")), "addr").where("line <> _l or place <> _p")
        taken = lacking.select("line", "place").join(here.select("line", "place"), ["line", "place"], "left_semi")
        if shared.isEmpty() and taken.isEmpty():
            return lacking
        return cut(lines.labelled(lacking, here))

    def _remote_head(self, source: Repository, project: str, branch: str) -> str | None:
        source.store.project_get(project)
        return source.on(project=project, branch=branch).head()

    def pull(self, source: Repository, project: str | None = None, branch: str | None = None, force: bool = False) -> dict:
        """Fast-forwards to another library's branch; diverged branches fail unless forced."""
        self._writable()
        theirs = self._remote_head(source, project or self.project, branch or self.branch)
        ours = self.head()
        if theirs is None or theirs == ours:
            return {"result": "up to date", "objects": 0}
        if ours is not None and self._has_snapshot(theirs) and lines.is_ancestor(self.snapshots(), theirs, ours):
            return {"result": "ahead", "objects": 0}
        forward = lines.is_ancestor(source.snapshots(), ours, theirs)
        if not forward and not force:
            mine = lines.reachable(self.snapshots(), [ours])
            if not lines.reachable(source.snapshots(), [theirs]).join(mine, "addr", "left_semi").isEmpty():
                raise E.Diverged("both sides have snapshots of their own: merge, or force")
            raise E.NoCommonHistory("the histories never meet: force, or merge as unrelated")
        n = self._copy_from(source, theirs, True, ours)
        return {"result": "fast-forward" if forward else "forced", "objects": n}

    def merge(self, source: Repository, project: str | None = None, branch: str | None = None, base: str | None = None, allow_unrelated: bool = False, message: str = MERGE_MESSAGE) -> dict:
        """Three-way merge; conflicts leave everything as it was and raise MergeConflicts."""
        self._writable()
        theirs = self._remote_head(source, project or self.project, branch or self.branch)
        ours = self.head()
        if theirs is None or theirs == ours:
            return {"result": "up to date", "auto_merged": 0}
        if ours is not None and self._has_snapshot(theirs) and lines.is_ancestor(self.snapshots(), theirs, ours):
            return {"result": "up to date", "auto_merged": 0}
        forward = lines.is_ancestor(source.snapshots(), ours, theirs)
        self._copy_from(source, theirs, forward, ours)
        if forward:
            return {"result": "fast-forward", "auto_merged": 0}
        try:
            root = lines.merge_base(self.snapshots(), ours, theirs, base)
        except E.NoCommonHistory:
            if not allow_unrelated:
                raise
            root = None
        changes, conflicts, merged = self._three_way(root, ours, theirs)
        if conflicts:
            error = E.MergeConflicts(conflicts, merged)
            error.base, error.ours, error.theirs, error.changes = root, ours, theirs, changes
            raise error
        addr = self._commit(changes, message, parents=[ours, theirs], base=ours, expected=ours)
        return {"result": "merged", "auto_merged": merged, "snapshot": addr, "base": root}

    def _three_way(self, base: str | None, ours: str, theirs: str) -> tuple[DataFrame, list[dict], int]:
        """Changes to ours' entries, conflicts and the number of entries merged by themselves."""
        sides = [cut(self.entries(s)) for s in (base, ours, theirs)]
        decided, conflicts, merged = versions.merge_levels(*sides)
        decided = cut(decided)
        gone = versions.taken_from_theirs(sides[1], decided).select("path", "type", "addr", F.lit(True).alias("deleted"))
        come = versions.taken_from_theirs(sides[2], decided).select("path", "type", "addr", F.lit(False).alias("deleted"))
        changes = come.unionByName(gone.join(come.select("path"), "path", "left_anti"))
        return cut(changes), [r.asDict() for r in conflicts.collect()], merged

    # merge state

    def _state_key(self) -> str:
        return f"merge.{self.project}.{self.branch}"

    def merge_start(self, source: Repository, **options) -> dict:
        """Merges, or keeps what merged on the branch ``<branch>-merge`` until the conflicts are settled."""
        try:
            return self.merge(source, **options)
        except E.MergeConflicts as e:
            side = self._side("merge")
            # Conflicting entries stand as in ours until they are settled.
            side._commit(e.changes, MERGE_MESSAGE + " base", parents=[e.ours], base=e.ours)
            state = {"base": e.base or "", "theirs": e.theirs, "ours": e.ours, "conflicts": e.conflicts, "auto_merged": e.auto_merged}
            self.store.meta_set(self._state_key(), json.dumps(state))
            raise

    def merge_state(self) -> dict | None:
        """The unfinished merge with its conflicts split into settled and open ones."""
        text = self.store.meta_get(self._state_key(), None)
        if text is None:
            return None
        state = json.loads(text)
        side = self._side("merge")
        if side.head() is None:
            return state | {"resolved": [], "unresolved": [c["path"] for c in state["conflicts"]]}
        # Settled explicitly, or standing otherwise than in ours.
        touched = {r["path"] for r in self._staged(side).select("path").collect()}
        paths = [c["path"] for c in state["conflicts"]]
        now = {r["path"]: r["addr"] for r in side.leaves().where(F.col("path").isin(paths)).collect()}
        done = [c["path"] for c in state["conflicts"] if c["path"] in touched or (c["ours"] != "" and c["kind"] != "type" and now.get(c["path"], "") != c["ours"])]
        return state | {"resolved": done, "unresolved": [p for p in paths if p not in done]}

    def merge_continue(self, message: str = MERGE_MESSAGE) -> dict:
        """Lands the merge with what was settled; conflicts left open keep ours."""
        state = self.merge_state()
        if state is None:
            raise E.NoMergeState(self.branch)
        if self.head() != state["ours"]:
            raise E.HeadMoved("the branch moved since the merge began: abort it")
        side = self._side("merge")
        if side.head() is None:
            raise E.BranchNotFound("the merge's branch is gone: abort the merge")
        settled = cut(self._staged(side))
        n = settled.count()
        if not n:
            raise E.NothingStaged("no conflict is settled yet")
        old, new = self.entries(state["ours"]), side.entries(side.head())
        changes = new.join(old.select("path", "type", "addr"), ["path", "type", "addr"], "left_anti").where("type = 'note'").select("path", "type", "addr", F.lit(False).alias("deleted"))
        empty_dirs = new.where("type = 'dir'").join(old.select("path"), "path", "left_anti").select("path", "type", F.lit(None).cast("string").alias("addr"), F.lit(False).alias("deleted"))
        gone = old.join(new.select("path", "type"), ["path", "type"], "left_anti").select("path", "type", "addr", F.lit(True).alias("deleted"))
        changes = changes.unionByName(empty_dirs)
        changes = changes.unionByName(gone.join(changes.select("path"), "path", "left_anti"))
        addr = self._commit(changes, message, parents=[state["ours"], state["theirs"]], base=state["ours"], expected=state["ours"])
        self._drop_merge(side)
        return {"snapshot": addr, "base": state["base"], "ours": state["ours"], "theirs": state["theirs"], "resolved": n}

    def _drop_merge(self, side: Repository) -> None:
        self.store.meta_delete(self._state_key())
        self.store.branch_delete(self.project, side.branch)

    def merge_abort(self) -> int:
        """Gives the merge up; the number of settled conflicts that are lost."""
        if self.merge_state() is None:
            raise E.NoMergeState(self.branch)
        side = self._side("merge")
        n = self._staged(side).count() if side.head() is not None else 0
        self._drop_merge(side)
        return n

    # integrity and lifecycle

    def _alive(self) -> DataFrame:
        """node: every snapshot that a branch of any project reaches."""
        heads = self.project_heads(every=True)
        return lines.reachable(self.snapshots(), heads).withColumnRenamed("addr", "node") if heads else self.spark.createDataFrame([], "node string")

    def _marked(self) -> DataFrame:
        return objects.marked(self.store.relation("edges"), self._alive())

    def unreachable_count(self) -> int:
        return objects.unreachable(self.store.list(), self._marked()).count()

    def gc(self, keep_last: int | None = None, backup: Callable[[list[dict]], object] | None = None) -> dict:
        """Drops what no branch of any project reaches; with ``keep_last`` also indexes and vectors of older snapshots.

        ``backup`` gets the branch table before anything is dropped; if it raises, nothing is. Rows that others add
        meanwhile stay; if a branch moves meanwhile, what is reachable is found anew.
        """
        if backup is not None:
            backup(self.export_branches())
        keep = keep_last if keep_last is not None else int(self.store.meta_get("gc.keep_last", None) or 0)
        if keep_last is not None:
            self.store.meta_set("gc.keep_last", str(keep_last))
        removed = 0

        def kept(record: Manifest) -> dict[str, DataFrame]:
            nonlocal removed
            read = lambda name: self.store.read_segments(name, record.segments[name])
            heads = sorted({b["addr"] for b in record.rows("branches")})
            snapshots = read("snapshots")
            alive = cut(lines.reachable(snapshots, heads)) if heads else self.spark.createDataFrame([], "addr string")
            newest = cut(lines.depths(snapshots, self._starts(*heads), keep).select("addr")) if keep and heads else alive
            # Snapshots at the depth of ``keep`` or deeper let go of their indexes and vectors.
            nodes = alive.join(newest.withColumn("depth", F.lit(0)), "addr", "left").select(F.col("addr").alias("node"), F.coalesce("depth", F.lit(keep)).alias("depth"))
            marked = cut(objects.marked(read("edges"), nodes, keep or None))
            removed = objects.unreachable(read("objects").select("addr"), marked).count()
            # A snapshot's chain of deltas stays as long as the snapshot does.
            chains, frontier = alive, alive
            for _ in range(FULL_EVERY):
                frontier = snapshots.where("chain > 0").join(frontier, "addr", "left_semi").select(F.col("base").alias("addr"))
                chains = chains.unionByName(frontier)
            chains = cut(chains.distinct())
            deltas = read("deltas").join(chains.withColumnRenamed("addr", "snapshot"), "snapshot", "left_semi")
            pairs = cut(tree.leaves(self.entries_of(newest.select(F.col("addr").alias("snapshot")))).distinct())
            docs = read("docs").join(pairs, ["path", "addr"], "left_semi")
            generations = snapshots.join(newest, "addr", "left_semi").where("vectors is not null").select(F.col("vectors").alias("generation")).distinct()
            return {
                "objects": read("objects").join(marked, "addr", "left_semi"),
                "edges": read("edges").join(marked.withColumnRenamed("addr", "src"), "src", "left_semi"),
                # Made again from the notes, as in transfers.
                "postings": self._postings(read("notes"), docs.select("path", "addr")),
                "docs": docs,
                "vectors": read("vectors").join(generations, "generation", "left_semi"),
                "notes": read("notes").join(deltas.where("type = 'note'").select("addr"), "addr", "left_semi"),
                "deltas": deltas,
                # Long histories that went from hand to hand get long lines again.
                "snapshots": cut(lines.labelled(snapshots.join(chains, "addr", "left_semi"))),
            }

        self.store.replace_segments(kept, settled=True)
        self.store.vacuum_strays()
        return {"removed": removed, "keep_last": keep}

    def export_branches(self) -> list[dict]:
        """The branch table as rows, for a backup before a collection."""
        return [{"project": b["project"], "name": b["name"], "addr": b["addr"]} for b in self.store.branch_list()]

    def fsck(self) -> DataFrame:
        """Violations among the objects, and of the relations that were made from them."""
        alive = cut(self.snapshots().join(self._alive().withColumnRenamed("node", "addr"), "addr", "left_semi"))
        heads, keep = self.project_heads(every=True), int(self.store.meta_get("gc.keep_last", None) or 0)
        newest = lines.depths(self.snapshots(), self._starts(*heads), keep) if keep and heads else alive
        pruned = cut(alive.select("addr").join(newest.select("addr"), "addr", "left_anti"))
        found = objects.fsck(self.store.relation("objects"), exempt=pruned)
        told = cut(alive.where("vectors is not null").join(pruned, "addr", "left_anti").select(F.col("addr").alias("snapshot"), F.col("vectors").alias("generation")))
        if not told.isEmpty():
            found = found.unionByName(objects.fsck_vectors(self.store.relation("objects"), self.store.relation("vectors"), told, self.entries_of(told)))
        tips = self.entries_of(self.spark.createDataFrame([(h,) for h in self.project_heads(every=True)], "snapshot string"))
        relations = objects.fsck_relations(self.store.relation("objects"), self.notes(), alive, tips, self.store.relation("docs"), self.store.relation("postings"))
        stored = objects.fsck_edges(self.store.relation("objects"), self.store.relation("edges"))
        return found.unionByName(relations).unionByName(stored).orderBy("addr", "problem")

    CHECKS = ("storage", "fsck", "version", "config", "gc-protect", "serve")

    def doctor(self, only: list[str] | None = None, serve_url: str = "http://127.0.0.1:8080") -> list[dict]:
        """Checks as rows of check, status (ok, warn, fail) and detail; ``only`` some of CHECKS, in their order."""
        if unknown := [c for c in only or () if c not in self.CHECKS]:
            raise E.NotFound(f"no check {unknown[0]!r}; there are {', '.join(self.CHECKS)}")

        def fsck() -> tuple[str, str]:
            bad = self.fsck().count()
            return "fail" if bad else "ok", f"{bad} problems"

        def config() -> tuple[str, str]:
            known = any(p["name"] == self.project for p in self.store.project_stats().collect())
            return "ok" if known else "warn", f"{self.project}/{self.branch}"

        def protect() -> tuple[str, str]:
            keep = self.store.meta_get("gc.keep_last", None)
            return ("ok", "all indexes kept") if keep is None else ("warn", f"indexes of the newest {keep} kept")

        def serve() -> tuple[str, str]:
            try:
                with urllib.request.urlopen(f"{serve_url}/healthz", timeout=2) as answer:
                    return ("ok" if answer.status == 200 else "warn"), f"{serve_url} answers {answer.status}"
            except OSError:
                return "warn", f"nothing serves at {serve_url}"

        run = {"storage": lambda: ("ok", self.store.describe()), "fsck": fsck, "version": lambda: ("ok", self.store.meta_get("schema_version")), "config": config, "gc-protect": protect, "serve": serve}
        return [dict(zip(("check", "status", "detail"), (c, *run[c]()), strict=True)) for c in self.CHECKS if not only or c in only]

    # interchange

    def export_markdown(self, ref: str | None = None) -> DataFrame:
        return formats.to_markdown(self.list_notes(ref=ref))

    def import_markdown(self, notes: DataFrame, message: str = "import markdown") -> dict:
        """Adds and changes notes; equal ones are skipped, times come from the newest equal note on the first-parent line."""
        self._writable()
        mine = self.leaves().join(self.notes(), "addr").select("path", F.col("title").alias("t"), F.col("tags").alias("g"), F.col("body").alias("b"))
        same = (F.col("title") == F.col("t")) & tags_equal("tags", "g") & (F.col("body") == F.col("b"))
        changed = cut(notes.join(mine, "path", "left").where(~F.coalesce(same, F.lit(False))).select("path", "title", "tags", "body"))
        n, total = changed.count(), notes.count()
        if n:
            times = self._inherited_times(changed)
            self.bulk_import(changed.join(times, "path", "left").withColumn("links", F.lit(None).cast(LINKS)), message)
        return {"changed": n, "skipped": total - n}

    def _inherited_times(self, changed: DataFrame) -> DataFrame:
        """created_at of the newest note equal to each changed one along the first parents."""
        if not self.head():
            return self.spark.createDataFrame([], "path string, created_at long")
        walked = cut(self.log().select(F.col("addr").alias("snapshot"), F.col("depth").alias("age")))
        seen = self.entries_of(walked, changed.select("path")).where("type = 'note'").join(walked, "snapshot").groupBy("path", "addr").agg(F.min("age").alias("age"))
        past = seen.join(self.notes(), "addr").select("path", F.col("title").alias("t"), F.col("tags").alias("g"), F.col("body").alias("b"), "created_at", "age")
        equal = changed.join(past, "path").where((F.col("title") == F.col("t")) & tags_equal("tags", "g") & (F.col("body") == F.col("b")))
        return equal.groupBy("path").agg(F.min_by("created_at", "age").alias("created_at"))

    def dump(self) -> DataFrame:
        """The library as backup lines."""
        return formats.backup_lines(self.store.relation("objects"), self.store.small("projects"), self.store.small("branches"), self.config.now())

    def restore(self, lines: DataFrame, force: bool = False) -> dict:
        """Fills an empty library (or, forced, a wiped one) from backup lines, after checking every object."""
        self._fillable(force)
        rows = cut(formats.parse_backup(lines))
        version = formats.check_header(rows)
        named = lambda kind: rows.where(F.col("type") == kind).collect()
        return self._filled(formats.parse_objects(lines), named("project"), named("branch"), version, force)

    def restore_foreign(self, library: ForeignLibrary, force: bool = False) -> dict:
        """Fills an empty library (or, forced, a wiped one) from one in a database, after checking every object."""
        self._fillable(force)
        version = library.version()
        found = library.objects.withColumn("intact", address("data") == F.col("addr"))
        return self._filled(found, library.projects.collect(), library.branches.collect(), version, force)

    def _fillable(self, force: bool) -> None:
        if not force and not self.store.is_empty():
            raise E.LibraryNotEmpty("the library holds objects: force to replace them")

    def _filled(self, found: DataFrame, projects: list[Row], branches: list[Row], version: int, force: bool) -> dict:
        found = cut(found)
        bad = found.where("not coalesce(intact, false)").head()
        if bad:
            raise E.InvalidObject(f"{bad['addr']} is damaged")
        if force:
            self.store.wipe()
        for r in projects:
            if not self.store.project_create(r["name"], r["description"] or ""):
                self.store.project_describe(r["name"], r["description"] or "")
        self.store.transact(lambda tx: self._relations_from_objects(tx, found.select("kind", "data")))
        for b in branches:
            self.store.branch_set(b["project"], b["name"], b["addr"])
            if b["description"]:
                self.store.branch_describe(b["project"], b["name"], b["description"])
        return {"objects": found.count(), "projects": len(projects), "branches": len(branches), "version": version}

    def _relations_from_objects(self, tx: Transaction, found: DataFrame) -> None:
        """Objects, and notes, snapshots, entries and index rows out of the objects alone."""
        tx.put(found)
        everything = tx.relation("objects")
        blobs = everything.where("kind = 'blob'").select(F.col("addr").alias("body_addr"), F.col("data").cast("string").alias("body"))
        notes = decode(everything, "note").select("addr", F.col("o.meta.title").alias("title"), tags_or_empty("o.meta.tags").alias("tags"), F.col("o.meta.created_at").alias("created_at"), F.col("o.links").alias("links"), F.col("o.body").alias("body_addr"))
        tx.append("notes", notes.join(blobs, "body_addr").drop("body_addr"))
        steps = cut(decode(everything, "tree").select(F.col("addr").alias("tree"), F.explode("o.entries").alias("e")).select("tree", "e.slug", "e.type", "e.addr"))
        snaps = decode(everything, "snapshot").select("addr", "o.root", F.coalesce("o.parents", F.array().cast("array<string>")).alias("parents"), "o.time", "o.message", F.col("o.vec").alias("vectors"))
        tx.append("vectors", vectors_of(everything))
        snaps = cut(lines.labelled(snaps))
        # Along its line a snapshot differs from the one before by few entries; every FULL_EVERY-th place stands whole.
        chain = (F.col("place") % FULL_EVERY).cast("int")
        before = snaps.select("line", (F.col("place") + 1).alias("place"), F.col("addr").alias("base"), F.col("root").alias("base_root"))
        snaps = cut(snaps.join(before, ["line", "place"], "left").withColumn("chain", chain))
        tx.append("deltas", tree.deltas_of(steps, snaps))
        tx.append("snapshots", snaps.withColumns({"base": F.when(F.col("chain") > 0, F.col("base")), "indexed": F.lit(True)}))
        self._index(tx, tree.leaves(tx.relation("deltas").where("not deleted")).distinct())
