"""Content-addressed objects: put, closure, integrity, garbage, transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import decode, note_problem, snapshot_problem, tree_problem
from ..functions.scalars import address, is_kind
from ..lineage import counted, cut
from ..schema import KINDS


def objects_of(rows: DataFrame) -> DataFrame:
    """addr, kind, size and data of ``rows(kind, data)``, each address once."""
    data = F.col("data").cast("binary")
    return rows.select(address("data").alias("addr"), "kind", F.octet_length(data).cast("long").alias("size"), data.alias("data")).dropDuplicates(["addr"])


def missing(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Objects of ``rows`` whose address isn't in ``existing``."""
    return rows.join(existing.select("addr"), "addr", "left_anti")


def decoded(objects: DataFrame) -> dict[str, DataFrame]:
    """Objects of each kind that has contents, parsed once and kept."""
    present = {r["kind"] for r in objects.select("kind").distinct().where(is_kind("kind")).collect()}
    return {k: cut(decode(objects, k).select("addr", "kind", "o")) if k in present else decode(objects.limit(0), k).select("addr", "kind", "o") for k in KINDS if k != "blob"}


def object_edges(objects: DataFrame, parsed: dict[str, DataFrame] | None = None) -> DataFrame:
    """(src, dst, role): what each object refers to. Vectors of a snapshot are references like any other."""
    parsed = parsed or {k: decode(objects, k) for k in KINDS if k != "blob"}
    note, tree, snap, index, shard, vec = (parsed[k] for k in ("note", "tree", "snapshot", "indexroot", "indexshard", "vecroot"))
    one = lambda rows, c, role: rows.select(F.col("addr").alias("src"), c.alias("dst"), F.lit(role).alias("role"))
    many = lambda rows, c, role: rows.select(F.col("addr").alias("src"), F.explode(c).alias("dst"), F.lit(role).alias("role"))
    postings = F.flatten(F.transform(F.map_values(F.col("o.postings")), lambda l: F.transform(l, lambda p: p["a"])))
    parts = [
        one(note, F.col("o.body"), "body"),
        many(tree, F.transform(F.col("o.entries"), lambda e: e["addr"]), "entry"),
        one(snap, F.col("o.root"), "root"),
        many(snap, F.col("o.parents"), "parent"),
        one(snap, F.col("o.index"), "index"),
        one(snap, F.col("o.vec"), "vec"),
        many(index, F.col("o.shards"), "shard"),
        many(shard, postings, "posting"),
        many(vec, F.col("o.shards"), "shard"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("dst is not null and dst <> ''").distinct()


def marked(edges: DataFrame, snapshots: DataFrame, keep_last: int | None = None, content: DataFrame | None = None) -> DataFrame:
    """Addresses reachable from ``snapshots(node, depth)``.

    With ``keep_last`` snapshots at that depth or deeper don't hold on to their index and
    vectors. References to objects that are gone are followed no further and never fail.
    """
    if keep_last is not None:
        old = snapshots.where(F.col("depth") >= keep_last).select(F.col("node").alias("src"))
        pruned = edges.where("role in ('index', 'vec')").join(old, "src", "left_semi")
        edges = edges.join(pruned.select("src", "dst", "role"), ["src", "dst", "role"], "left_anti")
    steps = cut(edges.where("role <> 'parent'").select("src", "dst").distinct())
    frontier = cut(snapshots.select(F.col("node").alias("addr")).distinct())
    seen, turn = frontier, 0
    while True:
        turn += 1
        frontier, n = counted(frontier.join(steps, F.col("addr") == F.col("src")).select(F.col("dst").alias("addr")).distinct().join(seen, "addr", "left_anti"))
        if not n:
            return seen
        seen = seen.unionByName(frontier)
        if turn % 4 == 0:
            seen = cut(seen)


def unreachable(objects: DataFrame, mark: DataFrame) -> DataFrame:
    """Objects the mark phase didn't reach."""
    return objects.join(mark.select("addr"), "addr", "left_anti")


def fsck(objects: DataFrame, entries: DataFrame | None = None, vectors: DataFrame | None = None, exempt: DataFrame | None = None) -> DataFrame:
    """addr, kind and problem of every violation.

    Checks: stored bytes hash to their address, kinds are known, objects decode and validate,
    references exist, tree entries point to the kind they say. ``exempt(addr)`` lists snapshots
    whose index was pruned on purpose. ``vectors`` are held against the entries' paths.
    """
    problem = lambda rows, text: rows.select("addr", "kind", text.alias("problem"))
    found = [
        problem(objects.where(F.col("addr") != address("data")), F.lit("content does not match address")),
        problem(objects.where(~is_kind("kind")), F.lit("unknown kind")),
    ]
    parsed = decoded(objects)
    for kind, check in (("note", note_problem), ("tree", tree_problem), ("snapshot", snapshot_problem), ("indexroot", None), ("indexshard", None), ("vecroot", None), ("vecshard", None)):
        rows = parsed[kind]
        wrong = F.when(F.col("o").isNull(), "does not decode")
        wrong = wrong.otherwise(check(F.col("o"))) if check else wrong
        found.append(problem(rows.withColumn("_w", wrong).where("_w is not null"), F.col("_w")))
    edges = cut(object_edges(objects, parsed))
    known = objects.select(F.col("addr").alias("dst"), F.col("kind").alias("dst_kind"))
    named = edges.join(objects.select(F.col("addr").alias("src"), "kind"), "src")
    lost = named.join(known, "dst", "left_anti")
    if exempt is not None:
        roles = F.explode(F.array(F.lit("index"), F.lit("vec"))).alias("role")
        lost = lost.join(exempt.select(F.col("addr").alias("src"), roles), ["src", "role"], "left_anti")
    found.append(lost.select(F.col("src").alias("addr"), "kind", F.concat(F.lit("missing reference: "), "dst").alias("problem")))
    entry = parsed["tree"].select("addr", "kind", F.explode("o.entries").alias("e")).join(known, F.col("e.addr") == F.col("dst"))
    expected = F.when(F.col("e.type") == "dir", "tree").otherwise("note")
    found.append(problem(entry.where(F.col("dst_kind") != expected), F.concat(F.lit("entry "), F.col("e.slug"), F.lit(" is a "), F.col("e.type"), F.lit(" but points to a "), F.col("dst_kind"))))
    if vectors is not None and entries is not None:
        shape = vectors.groupBy("generation").agg(F.countDistinct("model").alias("models"), F.countDistinct(F.size("vec")).alias("dims"))
        found.append(shape.where("models > 1 or dims > 1").select(F.col("generation").alias("addr"), F.lit("vecroot").alias("kind"), F.lit("vectors of several models or lengths").alias("problem")))
        stray = vectors.join(entries.where("type = 'note'").select("path"), "path", "left_anti")
        found.append(stray.select(F.col("generation").alias("addr"), F.lit("vecroot").alias("kind"), F.concat(F.lit("vector without note: "), "path").alias("problem")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.orderBy("addr", "problem")


def fsck_relations(objects: DataFrame, notes: DataFrame, snapshots: DataFrame, entries: DataFrame, docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Violations of the relations that queries read: rows of reachable ``snapshots`` and of the heads' ``entries`` whose
    object or note is gone, and index rows that aren't what their note gives."""
    from .search import docs_of, postings_of

    known = objects.select("addr")
    row = lambda rows, kind, text: rows.select("addr", F.lit(kind).alias("kind"), text.alias("problem"))
    found = [
        row(snapshots.join(known, "addr", "left_anti"), "snapshot", F.lit("row without object")),
        row(entries.join(known, "addr", "left_anti").select("addr", "path").distinct(), "tree", F.concat(F.lit("entry without object: "), "path")),
        row(entries.where("type = 'note'").join(notes.select("addr"), "addr", "left_anti").select("addr", "path").distinct(), "note", F.concat(F.lit("entry without note: "), "path")),
    ]
    pairs = docs.select("path", "addr").distinct()
    rows = cut(pairs.join(notes.select("addr", "title", "tags", "body"), "addr"))
    keys, counts = ["path", "addr", "term"], ["tf_title", "tf_tags", "tf_body"]
    # Counted per row, so that rows twice, rows too many and rows with other counts all show.
    have = lambda df, sign, columns: df.select(*columns, F.lit(sign).alias("n"))
    differ = lambda a, b, columns: have(a, 1, columns).unionByName(have(b, -1, columns)).groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
    found.append(row(differ(docs, docs_of(rows), ["path", "addr", "len"]), "note", F.concat(F.lit("wrong length in the index: "), "path")))
    found.append(row(differ(postings, postings_of(rows), keys + counts).select("addr", "path").distinct(), "note", F.concat(F.lit("wrong postings in the index: "), "path")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def fsck_vectors(objects: DataFrame, vectors: DataFrame, told: DataFrame, entries: DataFrame) -> DataFrame:
    """Violations of every generation of vectors that a snapshot of ``told(snapshot, generation)`` names: shards of another
    model or length than their root, components that don't fit, vectors of paths that the snapshot (``entries``) lacks,
    and rows of the relation that the shards don't hold, or the reverse."""
    used = told.select("generation").distinct()
    roots = decode(objects, "vecroot").select(F.col("addr").alias("generation"), F.col("o.model").alias("model"), F.col("o.dim").alias("dim"), F.explode("o.shards").alias("shard")).where("shard <> ''").join(used, "generation", "left_semi")
    shards = decode(objects, "vecshard").select(F.col("addr").alias("shard"), F.col("o.model").alias("_model"), F.col("o.dim").alias("_dim"), F.col("o.items").alias("items"))
    both = roots.join(shards, "shard")
    items = cut(both.select("generation", "dim", F.explode("items").alias("i")).select("generation", "dim", F.col("i.path").alias("path"), F.octet_length(F.unbase64("i.vec")).alias("n")))
    row = lambda rows, kind, text: rows.select(F.col("generation").alias("addr"), F.lit(kind).alias("kind"), text.alias("problem"))
    stored = vectors.join(used, "generation", "left_semi").select("generation", "path", "model", F.size("vec").alias("n"))
    shape = stored.groupBy("generation").agg(F.countDistinct("model").alias("models"), F.countDistinct("n").alias("dims"))
    as_objects = used.where(F.col("generation").startswith("sha256:"))
    stray = stored.select("generation", "path").join(told, "generation").join(entries.where("type = 'note'").select("snapshot", "path"), ["snapshot", "path"], "left_anti")
    # What objects hold is compared with the relation where objects hold the generation at all.
    held, kept = items.select("generation", "path"), stored.select("generation", "path").join(as_objects, "generation", "left_semi")
    found = [
        row(both.where("not (_model <=> model and _dim <=> dim)"), "vecroot", F.concat(F.lit("shard of another model or length: "), "shard")),
        row(items.where("n <> 4 * dim"), "vecroot", F.concat(F.lit("wrong length of the vector of "), "path")),
        row(shape.where("models > 1 or dims > 1"), "vecroot", F.lit("vectors of several models or lengths")),
        row(stray.select("generation", "path").distinct(), "vecroot", F.concat(F.lit("vector without note: "), "path")),
        row(held.join(kept, ["generation", "path"], "left_anti"), "vecroot", F.concat(F.lit("vector not in the relation: "), "path")),
        row(kept.join(held, ["generation", "path"], "left_anti"), "vecroot", F.concat(F.lit("vector in no shard: "), "path")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def fsck_edges(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored references that aren't what the objects say."""
    keys = ["src", "dst", "role"]
    said = cut(object_edges(objects.where("kind <> 'blob'")))
    row = lambda rows, text: rows.select(F.col("src").alias("addr"), F.lit("edge").alias("kind"), F.concat(F.lit(text), "dst").alias("problem"))
    return row(said.join(edges, keys, "left_anti"), "reference not stored: ").unionByName(row(edges.join(said, keys, "left_anti"), "stored reference that no object has: "))


def to_transfer(source: DataFrame, local: DataFrame, head: str) -> DataFrame:
    """Objects reachable from ``head`` in ``source``, history included, that ``local`` lacks."""
    edges = object_edges(source)
    start = source.sparkSession.createDataFrame([(head, 0)], "node string, depth int")
    reached = marked(edges.withColumn("role", F.lit("any")), start)
    return missing(source.join(reached, "addr", "left_semi"), local)
