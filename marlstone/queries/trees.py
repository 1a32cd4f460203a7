"""Listings, hierarchy, links and content addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.encoding import encode_note
from ..functions.scalars import address, is_address, short_address, slug_of, summary
from ..lineage import cut
from ..operators import objects, tree
from .corpus import DIRS_SQL, NOTES_SQL, notes, table

LINE_SQL = "coalesce(list_filter(list_transform(string_split({0}, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda l: l <> '')[1], '')"
SUMMARY_SQL = f"CASE WHEN length({LINE_SQL}) > 120 THEN left({LINE_SQL}, 120) || '…' ELSE {LINE_SQL} END".format("body")


def entries(spark, sf_dir):
    """Entries of the notes; every directory's address is named after its path."""
    found = tree.with_dirs(notes(spark, sf_dir).select("path", "addr"))
    return found.withColumn("addr", F.coalesce("addr", F.concat(F.lit("t:"), "path")))


def _listed(rows):
    return rows.select("path", slug_of("path").alias("slug"), "title", F.array_join("tags", ",").alias("tags"), "created_at", summary("body").alias("summary"))


def note_list(spark, sf_dir):
    return _listed(tree.list_notes(notes(spark, sf_dir).withColumn("type", F.lit("note"))))


def note_list_dir(spark, sf_dir):
    return _listed(tree.list_notes(notes(spark, sf_dir).withColumn("type", F.lit("note")), "src1/en"))


def note_get(spark, sf_dir):
    return notes(spark, sf_dir).where("path = 'src7/en/7'").select("path", "title", F.array_join("tags", ",").alias("tags"), "body", summary("body").alias("summary"))


def note_summary(spark, sf_dir):
    return notes(spark, sf_dir).select("path", summary("body").alias("summary"))


def dir_ls(spark, sf_dir):
    e = entries(spark, sf_dir)
    return tree.dir_ls(e, "").select(F.lit("").alias("dir"), "name", "type").unionByName(tree.dir_ls(e, "src3").select(F.lit("src3").alias("dir"), "name", "type")).unionByName(tree.dir_ls(e, "src3/en").select(F.lit("src3/en").alias("dir"), "name", "type"))


def dir_counts(spark, sf_dir):
    return tree.dir_counts(entries(spark, sf_dir))


def tree_flatten_recursive(spark, sf_dir):
    steps = entries(spark, sf_dir).select(F.concat(F.lit("t:"), "parent").alias("tree"), "slug", "type", "addr")
    return tree.flatten(steps, "t:").select("path", "type", "depth", "addr")


def tree_addresses(spark, sf_dir):
    """Canonical addresses of all directories, the root as the empty path."""
    built, _, root = tree.tree_addresses(tree.with_dirs(notes(spark, sf_dir).select("path", "addr")))
    return built.where("type = 'dir'").select("path", "addr").unionByName(spark.createDataFrame([("", root)], "path string, addr string"))


def _link_entries(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("conv"), F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("turn").cast("string")).alias("path"), F.col("role").alias("addr"))
    return tree.with_dirs(notes(spark, sf_dir).select("path", "addr").unionByName(turns))


def _links(spark, sf_dir):
    d, text = F.col("doc_id"), F.col("doc_id").cast("string")
    link = F.when(d % 4 == 0, F.col("path")).when(d % 4 == 1, text).when(d % 4 == 2, F.concat(F.lit("nope"), text)).otherwise(F.regexp_extract("path", "^(.*)/", 1))
    found = notes(spark, sf_dir).select(link.alias("link")).distinct()
    entries = _link_entries(spark, sf_dir)
    return entries, tree.resolve_links(entries, found)


def link_resolve_exact(spark, sf_dir):
    return _links(spark, sf_dir)[1].where("status in ('path', 'directory')").select("link", "status", "addr")


def link_resolve_leaf(spark, sf_dir):
    return _links(spark, sf_dir)[1].where("status in ('leaf', 'missing')").select("link", "status", "path", "addr")


def link_ambiguous(spark, sf_dir):
    """One row per note that an ambiguous link could mean."""
    entries, found = _links(spark, sf_dir)
    found = cut(found.where("status = 'ambiguous'"))
    return tree.link_candidates(entries, found).join(found.select("link", "n"), "link").select("link", "n", "path")


def content_address(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", address("text").alias("addr"), short_address(address("text")).alias("short"))


def dedup_objects(spark, sf_dir):
    return objects.objects_of(table(spark, sf_dir, "documents").select(F.lit("blob").alias("kind"), F.col("text").alias("data"))).select("addr", "kind", "size")


def address_validate(spark, sf_dir):
    a, d = address("text"), F.col("doc_id")
    damaged = F.when(d % 4 == 1, F.substring(a, 1, 70)).when(d % 4 == 2, F.upper(a)).when(d % 4 == 3, F.concat(a, F.lit("0"))).otherwise(a)
    return table(spark, sf_dir, "documents").select("doc_id", is_address(damaged).alias("valid"))


def note_encoding(spark, sf_dir):
    """Addresses of the canonical JSON of notes."""
    return notes(spark, sf_dir).select("path", address(encode_note("title", "tags", "created_at", address("body"))).alias("addr"))


_ROWS = "SELECT path, slug, title, lang || ',' || source AS tags, created_at, {s} AS summary FROM notes".format(s=SUMMARY_SQL)

LINKS_SQL = f"""WITH {NOTES_SQL},
  leaves AS (SELECT path, slug, addr FROM notes UNION ALL
             SELECT 'conv/c' || conv_id || '/' || turn, CAST(turn AS VARCHAR), role FROM conversations),
  every AS (SELECT path, 'note' AS type, addr FROM leaves UNION ALL SELECT DISTINCT source, 'dir', NULL FROM notes UNION ALL SELECT DISTINCT dir, 'dir', NULL FROM notes
            UNION ALL SELECT DISTINCT 'conv', 'dir', NULL FROM conversations UNION ALL SELECT DISTINCT 'conv/c' || conv_id, 'dir', NULL FROM conversations),
  links AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN slug WHEN 2 THEN 'nope' || slug ELSE dir END AS link FROM notes),
  by_slug AS (SELECT slug, count(*) AS n, min(path) AS path, arg_min(addr, path) AS addr FROM leaves GROUP BY slug),
  found AS (SELECT l.link, CASE WHEN e.type = 'note' THEN 'path' WHEN e.type = 'dir' THEN 'directory' WHEN s.n = 1 THEN 'leaf' WHEN s.n > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
                   e.addr AS exact_addr, s.n, s.path, s.addr
            FROM links l LEFT JOIN every e ON e.path = l.link LEFT JOIN by_slug s ON s.slug = l.link)
"""


def _json(expression: str) -> str:
    for plain, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        expression = f"replace({expression}, '{plain}', '{code}')"
    return expression


NOTE_JSON_SQL = _json(
    "'{\"kind\":\"note\",\"meta\":{\"title\":' || CAST(to_json(title) AS VARCHAR) || ',\"tags\":[' || CAST(to_json(least(lang, source)) AS VARCHAR) || ',' || CAST(to_json(greatest(lang, source)) AS VARCHAR) || "
    "'],\"created_at\":' || created_at || ',\"schema_version\":1},\"body\":\"sha256:' || sha256(body) || '\"}'"
)

TREE_SQL = f"""WITH {NOTES_SQL},
  langs AS (SELECT dir AS path, source, lang, 'sha256:' || sha256('{{"kind":"tree","entries":[' || string_agg('{{"slug":"' || slug || '","type":"note","addr":"' || addr || '"}}', ',' ORDER BY slug) || ']}}') AS addr FROM notes GROUP BY dir, source, lang),
  sources AS (SELECT source AS path, 'sha256:' || sha256('{{"kind":"tree","entries":[' || string_agg('{{"slug":"' || lang || '","type":"dir","addr":"' || addr || '"}}', ',' ORDER BY lang) || ']}}') AS addr FROM langs GROUP BY source)
SELECT path, addr FROM langs UNION ALL SELECT path, addr FROM sources UNION ALL
SELECT '', 'sha256:' || sha256('{{"kind":"tree","entries":[' || string_agg('{{"slug":"' || path || '","type":"dir","addr":"' || addr || '"}}', ',' ORDER BY path) || ']}}') FROM sources"""

SQL = {
    "note_list": f"WITH {NOTES_SQL} {_ROWS}",
    "note_list_dir": f"WITH {NOTES_SQL} {_ROWS} WHERE starts_with(path, 'src1/en/')",
    "note_get": f"WITH {NOTES_SQL} SELECT path, title, lang || ',' || source AS tags, body, {SUMMARY_SQL} AS summary FROM notes WHERE path = 'src7/en/7'",
    "note_summary": f"WITH {NOTES_SQL} SELECT path, {SUMMARY_SQL} AS summary FROM notes",
    "dir_ls": f"""WITH {NOTES_SQL}, {DIRS_SQL} SELECT parent AS dir, slug AS name, 'dir' AS type FROM dirs WHERE parent IN ('', 'src3')
        UNION ALL SELECT 'src3/en', slug, 'note' FROM notes WHERE dir = 'src3/en'""",
    "dir_counts": f"""WITH {NOTES_SQL} SELECT source AS dir, count(*) AS notes, count(DISTINCT lang) AS children FROM notes GROUP BY source
        UNION ALL SELECT dir, count(*), count(*) FROM notes GROUP BY dir""",
    "tree_flatten_recursive": f"""WITH RECURSIVE {NOTES_SQL}, {DIRS_SQL},
        steps AS (SELECT parent, slug, 'dir' AS type, 't:' || path AS addr FROM dirs UNION ALL SELECT dir, slug, 'note', addr FROM notes),
        walk AS (SELECT slug AS path, type, 1 AS depth, addr FROM steps WHERE parent = ''
                 UNION ALL SELECT w.path || '/' || s.slug, s.type, w.depth + 1, s.addr FROM walk w JOIN steps s ON w.type = 'dir' AND s.parent = w.path)
        SELECT path, type, depth, addr FROM walk""",
    "tree_addresses": TREE_SQL,
    "link_resolve_exact": LINKS_SQL + "SELECT link, status, exact_addr AS addr FROM found WHERE status IN ('path', 'directory')",
    "link_resolve_leaf": LINKS_SQL + "SELECT link, status, CASE WHEN status = 'leaf' THEN path END AS path, CASE WHEN status = 'leaf' THEN addr END AS addr FROM found WHERE status IN ('leaf', 'missing')",
    "link_ambiguous": LINKS_SQL + "SELECT f.link, f.n, l.path FROM found f JOIN leaves l ON l.slug = f.link WHERE f.status = 'ambiguous'",
    "content_address": "SELECT doc_id, 'sha256:' || sha256(text) AS addr, left('sha256:' || sha256(text), 16) AS short FROM documents",
    "dedup_objects": "SELECT DISTINCT 'sha256:' || sha256(text) AS addr, 'blob' AS kind, CAST(strlen(text) AS BIGINT) AS size FROM documents",
    "address_validate": """SELECT doc_id, regexp_full_match(CASE doc_id % 4 WHEN 1 THEN left(a, 70) WHEN 2 THEN upper(a) WHEN 3 THEN a || '0' ELSE a END, 'sha256:[0-9a-f]{64}') AS valid
        FROM (SELECT doc_id, 'sha256:' || sha256(text) AS a FROM documents)""",
    "note_encoding": f"WITH {NOTES_SQL} SELECT path, 'sha256:' || sha256({NOTE_JSON_SQL}) AS addr FROM notes",
}

QUERIES = {n: globals()[n] for n in SQL}
