"""Objects, integrity, garbage, transfer, projects and branches, interchange formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.encoding import encode_note
from ..functions.scalars import address
from ..operators import objects
from ..operators.tree import last_wins
from ..sources import formats, registry
from .corpus import BASE_SQL, NOTES_SQL, OURS_SQL, THEIRS_SQL, notes, table, version
from .trees import NOTE_JSON_SQL


def _store(spark, sf_dir):
    """Edges and objects of three snapshots: base, ours (its child) and theirs; each snapshot has an index."""
    edges, found = None, None
    for name in ("base", "ours", "theirs"):
        rows = version(spark, sf_dir, name)
        body = address("body")
        parts = [
            rows.select(F.lit(name).alias("src"), F.col("addr").alias("dst"), F.lit("root").alias("role")),
            rows.select(F.col("addr").alias("src"), body.alias("dst"), F.lit("body").alias("role")),
            spark.createDataFrame([(name, f"index-{name}", "index")], "src string, dst string, role string"),
        ]
        kinds = [rows.select("addr", F.lit("note").alias("kind")), rows.select(body.alias("addr"), F.lit("blob").alias("kind")), spark.createDataFrame([(name, "snapshot"), (f"index-{name}", "indexroot")], "addr string, kind string")]
        for p in parts:
            edges = p if edges is None else edges.unionByName(p)
        for k in kinds:
            found = k if found is None else found.unionByName(k)
    return edges.distinct(), found.distinct()


def gc_unreachable(spark, sf_dir):
    """What a collection drops when only ours (and its parent base) is a branch head."""
    edges, found = _store(spark, sf_dir)
    snapshots = spark.createDataFrame([("ours", 0), ("base", 1)], "node string, depth int")
    return objects.unreachable(found, objects.marked(edges, snapshots))


def gc_keep_last(spark, sf_dir):
    """The same with indexes kept for the newest snapshot only."""
    edges, found = _store(spark, sf_dir)
    snapshots = spark.createDataFrame([("ours", 0), ("base", 1)], "node string, depth int")
    return objects.unreachable(found, objects.marked(edges, snapshots, keep_last=1))


def _faulty(spark, sf_dir):
    """Blobs and notes with some blobs tampered with and some lost."""
    rows = notes(spark, sf_dir).groupBy("body").agg(F.min("doc_id").alias("id"))
    damaged = F.when(F.col("id") % 97 == 5, F.concat("body", F.lit("x"))).otherwise(F.col("body")).cast("binary")
    blobs = rows.where("id % 89 <> 3").select(address("body").alias("addr"), F.lit("blob").alias("kind"), F.octet_length(damaged).cast("long").alias("size"), damaged.alias("data"))
    json = encode_note("title", "tags", "created_at", address("body"))
    return blobs.unionByName(objects.objects_of(notes(spark, sf_dir).select(F.lit("note").alias("kind"), json.alias("data"))))


def fsck_violations(spark, sf_dir):
    return objects.fsck(_faulty(spark, sf_dir))


def transfer_missing(spark, sf_dir):
    """Addresses of theirs that base doesn't have."""
    return objects.missing(version(spark, sf_dir, "theirs").select("addr").distinct(), version(spark, sf_dir, "base"))


def _projects(spark, sf_dir):
    projects = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("description"))
    projects = projects.unionByName(spark.createDataFrame([("EMPTY", "no branches")], "name string, description string"))
    branches = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return projects, branches.select(F.col("r_name").alias("project"), F.col("n_name").alias("name"), address("n_name").alias("addr"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("description"), "n_nationkey")


def project_stats(spark, sf_dir):
    return registry.project_stats(*_projects(spark, sf_dir))


def branch_upsert(spark, sf_dir):
    """Every third branch advances, and each project gets a new one; descriptions stay."""
    projects, branches = _projects(spark, sf_dir)
    moved = branches.where("n_nationkey % 3 = 0").select("project", "name", address(F.concat(F.lit("next "), "name")).alias("addr"))
    new = projects.select(F.col("name").alias("project"), F.lit("new").alias("name"), address("name").alias("addr"))
    return registry.branch_upsert(branches.drop("n_nationkey"), moved.unionByName(new))


def bulk_last_wins(spark, sf_dir):
    """A batch with several inputs per path; the last one counts."""
    rows = notes(spark, sf_dir).select(F.concat_ws("/", F.get("tags", F.lit(1)), (F.col("doc_id") % 50).cast("string")).alias("path"), "doc_id", "title")
    return last_wins(rows, "path", "doc_id").select("path", "doc_id", "title")


def jsonl_roundtrip(spark, sf_dir):
    lines = formats.to_jsonl(notes(spark, sf_dir))
    return formats.parse_jsonl(lines).select("path", "title", F.array_join("tags", ",").alias("tags"), address("body").alias("body_addr"))


def md_roundtrip(spark, sf_dir):
    files = formats.to_markdown(notes(spark, sf_dir))
    return formats.parse_markdown(files).select("path", "title", F.array_join("tags", ",").alias("tags"), address("body").alias("body_addr"), "problem")


def dump_roundtrip(spark, sf_dir):
    """Objects through backup lines and back, verified."""
    blobs = objects.objects_of(notes(spark, sf_dir).select(F.lit("blob").alias("kind"), F.col("body").alias("data")))
    return formats.parse_objects(formats.object_lines(blobs)).select("addr", "kind", "size", "intact")


_STORE = f"""WITH {BASE_SQL}, {OURS_SQL}, {THEIRS_SQL},
  named AS (SELECT 'base' AS v, addr, body FROM base UNION ALL SELECT 'ours', addr, body FROM ours UNION ALL SELECT 'theirs', addr, body FROM theirs),
  live AS (SELECT addr FROM named WHERE v <> 'theirs' UNION SELECT 'sha256:' || sha256(body) FROM named WHERE v <> 'theirs'),
  dead AS (SELECT DISTINCT addr, 'note' AS kind FROM named WHERE addr NOT IN (FROM live) UNION SELECT DISTINCT 'sha256:' || sha256(body), 'blob' FROM named WHERE 'sha256:' || sha256(body) NOT IN (FROM live)
           UNION ALL SELECT 'theirs', 'snapshot' UNION ALL SELECT 'index-theirs', 'indexroot')"""

_PROJECTS = """WITH projects AS (SELECT r_name AS name, 'region ' || r_regionkey AS description FROM region UNION ALL SELECT 'EMPTY', 'no branches'),
  branches AS (SELECT r_name AS project, n_name AS name, 'sha256:' || sha256(n_name) AS addr, 'nation ' || n_nationkey AS description, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"""

SQL = {
    "gc_unreachable": _STORE + " SELECT addr, kind FROM dead",
    "gc_keep_last": _STORE + " SELECT addr, kind FROM dead UNION ALL SELECT 'index-base', 'indexroot'",
    "fsck_violations": f"""WITH {NOTES_SQL}, texts AS (SELECT body, min(doc_id) AS id FROM notes GROUP BY body)
        SELECT 'sha256:' || sha256(body) AS addr, 'blob' AS kind, 'content does not match address' AS problem FROM texts WHERE id % 97 = 5 AND id % 89 <> 3
        UNION ALL SELECT DISTINCT 'sha256:' || sha256({NOTE_JSON_SQL}), 'note', 'missing reference: sha256:' || sha256(body) FROM notes WHERE body IN (SELECT body FROM texts WHERE id % 89 = 3)
        UNION ALL SELECT DISTINCT 'sha256:' || sha256({NOTE_JSON_SQL}), 'note', 'no title' FROM notes WHERE trim(title) = ''""",
    "transfer_missing": f"WITH {BASE_SQL}, {THEIRS_SQL} SELECT DISTINCT addr FROM theirs WHERE addr NOT IN (SELECT addr FROM base)",
    "project_stats": _PROJECTS + " SELECT p.name, p.description, count(b.name) AS branches FROM projects p LEFT JOIN branches b ON b.project = p.name GROUP BY p.name, p.description",
    "branch_upsert": _PROJECTS
    + """ SELECT project, name, CASE WHEN n_nationkey % 3 = 0 THEN 'sha256:' || sha256('next ' || name) ELSE addr END AS addr, description FROM branches
        UNION ALL SELECT name, 'new', 'sha256:' || sha256(name), '' FROM projects""",
    "bulk_last_wins": f"""WITH {NOTES_SQL}, keyed AS (SELECT source || '/' || (doc_id % 50) AS path, doc_id, title FROM notes)
        SELECT path, max(doc_id) AS doc_id, arg_max(title, doc_id) AS title FROM keyed GROUP BY path""",
    "jsonl_roundtrip": f"WITH {NOTES_SQL} SELECT path, title, lang || ',' || source AS tags, 'sha256:' || sha256(body) AS body_addr FROM notes",
    "md_roundtrip": f"WITH {NOTES_SQL} SELECT path, title, lang || ',' || source AS tags, 'sha256:' || sha256(body) AS body_addr, CAST(NULL AS VARCHAR) AS problem FROM notes",
    "dump_roundtrip": "SELECT DISTINCT 'sha256:' || sha256(text) AS addr, 'blob' AS kind, CAST(strlen(text) AS BIGINT) AS size, true AS intact FROM documents",
}

QUERIES = {n: globals()[n] for n in SQL}
