"""Hierarchy operators over the entries relation.

``entries(path, parent, slug, depth, type, addr)`` holds one row per note and per
directory of a snapshot, empty directories included; the root is the empty path
and has no row of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AmbiguousSlug, EntryTypeConflict, NotFound
from ..functions.encoding import EMPTY_TREE, addressed, encode_tree
from ..functions.scalars import ancestors_of, depth_of, in_dir, parent_of, path_parts, slug_of, tree_order
from ..lineage import cut

COLUMNS = ("path", "parent", "slug", "depth", "type", "addr")


def located(rows: DataFrame) -> DataFrame:
    """Adds parent, slug and depth to rows with a path."""
    return rows.withColumns({"parent": parent_of("path"), "slug": slug_of("path"), "depth": depth_of("path")})


def with_dirs(leaves: DataFrame) -> DataFrame:
    """Entries of notes ``(path, addr)`` and all directories above them (their addresses unset)."""
    dirs = leaves.select(F.explode(ancestors_of("path")).alias("path")).distinct()
    notes = leaves.select("path", F.lit("note").alias("type"), "addr")
    return located(notes.unionByName(dirs.select("path", F.lit("dir").alias("type"), F.lit(None).cast("string").alias("addr")))).select(*COLUMNS)


def leaves(entries: DataFrame) -> DataFrame:
    """Notes only: path and address."""
    return entries.where("type = 'note'").select("path", "addr")


def flatten(tree_entries: DataFrame, root: str) -> DataFrame:
    """Entries below a root tree, from ``tree_entries(tree, slug, type, addr)``; one join per level."""
    return flatten_all(tree_entries, tree_entries.sparkSession.createDataFrame([("", root)], "name string, root string")).drop("name")


def flatten_all(tree_entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries below every tree of ``roots(name, root)``, with the name; one join per level for all of them.

    A tree that stands at several paths is joined at each of them, so equal subtrees are no problem.
    """
    steps = tree_entries.select(F.col("tree").alias("_tree"), "slug", "type", "addr")
    level = steps.join(roots.select("name", F.col("root").alias("_tree")), "_tree").select("name", F.col("slug").alias("path"), F.lit("").alias("parent"), "slug", F.lit(1).alias("depth"), "type", "addr")
    found, depth = level, 1
    while True:
        above = cut(level.where("type = 'dir'").select("name", F.col("path").alias("_path"), F.col("addr").alias("_tree")))
        if above.isEmpty():
            return found
        depth += 1
        level = cut(steps.join(above, "_tree").select("name", F.concat_ws("/", "_path", "slug").alias("path"), F.col("_path").alias("parent"), "slug", F.lit(depth).alias("depth"), "type", "addr"))
        found = found.unionByName(level)


def deltas_of(tree_entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (snapshot, path, ..., deleted) by which trees differ from those before them, for ``roots(addr, root, base_root)``;
    whole trees where ``chain`` is 0. One pair of joins per level for all of them, and only below directories that differ.
    """
    steps = tree_entries.select(F.col("tree").alias("_tree"), "slug", "type", "addr")
    level = roots.select(F.col("addr").alias("snapshot"), F.lit("").alias("parent"), F.col("root").alias("new"), F.when(F.col("chain") > 0, F.col("base_root")).alias("old"))
    found, depth = None, 0
    while True:
        depth += 1
        level = cut(level.where("not new <=> old"))
        side = lambda c, p: level.select("snapshot", "parent", F.col(c).alias("_tree")).join(steps, "_tree").select("snapshot", "parent", "slug", F.col("type").alias(f"{p}_type"), F.col("addr").alias(f"{p}_addr"))  # noqa: E731, B023
        both = cut(side("new", "n").join(side("old", "o"), ["snapshot", "parent", "slug"], "full_outer").where("not (n_type <=> o_type and n_addr <=> o_addr)"))
        path = F.when(F.col("parent") == "", F.col("slug")).otherwise(F.concat_ws("/", "parent", "slug"))
        rows = both.select("snapshot", path.alias("path"), "parent", "slug", F.lit(depth).alias("depth"), F.coalesce("n_type", "o_type").alias("type"), F.coalesce("n_addr", "o_addr").alias("addr"), F.col("n_type").isNull().alias("deleted"))
        found = rows if found is None else found.unionByName(rows)
        tree_at = lambda p: F.when(F.col(f"{p}_type") == "dir", F.col(f"{p}_addr"))
        level = both.where("n_type = 'dir' or o_type = 'dir'").select("snapshot", path.alias("parent"), tree_at("n").alias("new"), tree_at("o").alias("old"))
        if level.isEmpty():
            return found


def tree_addresses(entries: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Entries with directory addresses computed bottom-up, the new tree objects, and the root's address.

    ``only(path)`` limits the work to those directories (all others keep the address they have);
    it must hold every ancestor of every directory in it. One aggregation per level.
    """
    spark = entries.sparkSession
    dirty = None if only is None else only.select("path").distinct()
    wanted = entries if dirty is None else entries.join(dirty.select(F.col("path").alias("parent")).unionByName(spark.createDataFrame([("",)], "parent string")).distinct(), "parent", "left_semi")
    work = cut(wanted.select(*COLUMNS))
    todo = entries.where("type = 'dir'").select("path", "depth") if dirty is None else entries.where("type = 'dir'").join(dirty, "path", "left_semi").select("path", "depth")
    todo = cut(todo)
    deepest = todo.agg(F.max("depth")).collect()[0][0] or 0
    known = spark.createDataFrame([], "path string, new_addr string")
    objects = None
    for depth in range(deepest, -1, -1):
        rows = work.where(F.col("depth") == depth + 1).join(known, "path", "left").withColumn("addr", F.coalesce("new_addr", "addr"))
        built = rows.groupBy(F.col("parent").alias("path")).agg(F.collect_list(F.struct("slug", "type", "addr")).alias("e")).select("path", encode_tree("e").alias("json"))
        at = todo.where(F.col("depth") == depth).select("path") if depth else spark.createDataFrame([("",)], "path string")
        level = cut(at.join(built, "path", "left").select("path", addressed(F.coalesce("json", F.lit(EMPTY_TREE))).alias("o")).select("path", F.col("o.addr").alias("new_addr"), F.col("o.data").alias("data")))
        known = level.select("path", "new_addr") if depth == deepest else known.unionByName(level.select("path", "new_addr"))
        part = level.select(F.lit("tree").alias("kind"), "data")
        objects = part if objects is None else objects.unionByName(part)
    root = known.where("path = ''").head()["new_addr"]
    done = entries.join(known, "path", "left").withColumn("addr", F.coalesce("new_addr", "addr")).select(*COLUMNS)
    return done, objects, root


def empty_root() -> str:
    import hashlib

    return "sha256:" + hashlib.sha256(EMPTY_TREE.encode()).hexdigest()


# listings


def list_notes(entries: DataFrame, directory: str = "") -> DataFrame:
    """Notes below a directory, at any depth; order by ``tree_order`` where rows are shown."""
    return entries.where((F.col("type") == "note") & in_dir("path", directory))


def walk_notes(entries: DataFrame, notes: DataFrame, directory: str = "", bodies: bool = True) -> DataFrame:
    """Notes below a directory with title, tags and time, depth first; bodies are read only if asked for."""
    wanted = ["addr", "title", "tags", "created_at"] + ["body"] * bodies
    return list_notes(entries, directory).join(notes.select(*wanted), "addr").orderBy(tree_order("path"))


def check_dir(entries: DataFrame, path: str) -> None:
    """Raises unless ``path`` is a directory."""
    parts = path_parts(path)
    above = ["/".join(parts[:i]) for i in range(1, len(parts) + 1)]
    kinds = {r["path"]: r["type"] for r in entries.where(F.col("path").isin(above)).select("path", "type").collect()} if above else {}
    for p in above:
        if kinds.get(p) == "note":
            raise EntryTypeConflict(f"{p!r} is a note")
        if p not in kinds:
            raise NotFound(f"no directory {p!r}")


def dir_exists(entries: DataFrame, path: str) -> bool:
    try:
        check_dir(entries, path)
    except NotFound:
        return False
    return True


def dir_ls(entries: DataFrame, path: str = "") -> DataFrame:
    """Direct children, directories first, then by name."""
    return entries.where(F.col("parent") == path).select(F.col("slug").alias("name"), "type", "addr").orderBy(F.expr("type = 'dir'").desc(), "name")


def dir_counts(entries: DataFrame) -> DataFrame:
    """Per directory: notes at any depth below, and direct children."""
    below = list_notes(entries).select(F.explode(ancestors_of("path")).alias("dir")).groupBy("dir").agg(F.count("*").alias("notes"))
    children = entries.where("parent <> ''").groupBy(F.col("parent").alias("dir")).agg(F.count("*").alias("children"))
    return entries.where("type = 'dir'").select(F.col("path").alias("dir")).join(below, "dir", "left").join(children, "dir", "left").select("dir", F.coalesce("notes", F.lit(0)).alias("notes"), F.coalesce("children", F.lit(0)).alias("children"))


def nested(entries: DataFrame, notes: DataFrame | None = None) -> dict:
    """The tree as nested dicts, assembled on the driver for one screen of output."""
    rows = entries if notes is None else entries.join(notes.select("addr", "title"), "addr", "left")
    root: dict = {"name": "", "type": "dir", "path": "", "children": []}
    at = {"": root}
    for r in rows.orderBy(tree_order("path")).toLocalIterator():
        node = {"name": r["slug"], "type": r["type"], "path": r["path"]}
        if r["type"] == "dir":
            node["children"] = []
        elif notes is not None:
            node["title"] = r["title"]
        at[r["path"]] = node
        at[r["parent"]]["children"].append(node)
    return root


def rendered(node: dict, indent: int = 0) -> str:
    """A nested tree as indented text; empty directories are shown."""
    lines = [] if not indent and not node["name"] else ["  " * (indent - 1) + node["name"] + ("/" if node["type"] == "dir" else "")]
    for child in node.get("children", ()):
        lines.append(rendered(child, indent + 1))
    return "\n".join(lines)


# links


def resolve_links(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Every ``link``: an exact path first (a directory is an error), else a leaf name if it is the only one.

    status is one of path, leaf, directory, ambiguous, missing; ``n`` counts the notes with that leaf name
    (``link_candidates`` lists them: a frequent name is a number here, never a list).
    """
    wanted = links.select("link").distinct()
    exact = entries.select(F.col("path").alias("link"), F.col("type").alias("exact_type"), F.col("addr").alias("exact_addr"))
    leaf = _named(entries, wanted).groupBy("link").agg(F.count("*").alias("n"), F.min(F.struct("path", "addr")).alias("leaf"))
    found = wanted.join(exact, "link", "left").join(leaf, "link", "left")
    status = F.when(F.col("exact_type") == "note", "path").when(F.col("exact_type") == "dir", "directory").when(F.col("n") == 1, "leaf").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return found.withColumn("status", status).select(
        "link",
        "status",
        F.when(F.col("status") == "path", F.col("link")).when(F.col("status") == "leaf", F.col("leaf.path")).alias("path"),
        F.when(F.col("status") == "path", F.col("exact_addr")).when(F.col("status") == "leaf", F.col("leaf.addr")).alias("addr"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _named(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    return list_notes(entries).select(F.col("slug").alias("link"), "path", "addr").join(wanted, "link", "left_semi")


def link_candidates(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """(link, path) of every note that an ambiguous link of ``resolved`` could mean."""
    return _named(entries, resolved.where("status = 'ambiguous'").select("link")).select("link", "path")


def resolve_link(entries: DataFrame, slug: str) -> dict:
    resolved = resolve_links(entries, entries.sparkSession.createDataFrame([(slug,)], "link string"))
    row = resolved.head()
    if row["status"] == "directory":
        raise EntryTypeConflict(f"{slug!r} is a directory")
    if row["status"] == "ambiguous":
        raise AmbiguousSlug(slug, [r["path"] for r in link_candidates(entries, resolved).orderBy("path").collect()])
    if row["status"] == "missing":
        raise NotFound(f"no note {slug!r}")
    return {"path": row["path"], "slug": row["path"].split("/")[-1], "addr": row["addr"]}


# problems in a batch of paths


def type_clashes(paths: DataFrame) -> DataFrame:
    """Paths of notes that also stand above another note."""
    above = paths.select(F.explode(ancestors_of("path")).alias("path")).distinct()
    return paths.select("path").join(above, "path", "left_semi")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


