"""Interchange formats: bulk JSON lines, Markdown files with front matter, library backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import BadBatch, VersionMismatch
from ..functions.scalars import address, col, split_tags, tags_or_empty, trimmed, valid_path
from ..operators.tree import type_clashes
from ..schema import LIBRARY_VERSION, OLDEST_BACKUP

BULK = "path string, title string, tags array<string>, body string"
BACKUP = "type string, schema_version int, created_at long, addr string, kind string, size long, data string, name string, description string, project string"

# Front matter.
FENCE, TITLE_KEY, TAGS_KEY = "---\n", "title: ", "tags: "

# JSON lines


def to_jsonl(notes: DataFrame) -> DataFrame:
    """One line per note."""
    return notes.select(F.to_json(F.struct("path", "title", tags_or_empty("tags").alias("tags"), "body")).alias("value"))


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """path, title, tags, body and ``problem`` of every line that isn't blank, and its ``seq`` if it has one."""
    rows = lines.where(trimmed("value") != "")
    parsed = F.from_json("value", BULK)
    rows = rows.withColumn("o", parsed)
    wrong = F.when(F.col("o").isNull() | F.col("o.path").isNull(), "not a bulk line").when(~valid_path("o.path"), "bad path").when(F.get_json_object("value", "$.tags").isNotNull() & ~F.get_json_object("value", "$.tags").startswith("["), "tags must be an array")
    return rows.select("o.path", "o.title", "o.tags", F.coalesce("o.body", F.lit("")).alias("body"), wrong.alias("problem"), *(["seq"] if "seq" in lines.columns else []))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and ``seq`` (file, part of it, row) of every line: the order of the input, over several files by their names."""
    lines = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return lines.select("value", place.alias("seq"))


def line_numbers(lines: DataFrame) -> DataFrame:
    """file, start, the least row and the lines of the file before it, of every part of the input."""
    parts = lines.groupBy("seq.file", "seq.start").agg(F.count("*").alias("n"), F.min("seq.row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")
    return parts.select("file", "start", "first", before.alias("before"))


#: Bad lines that an error spells out; all are counted.
SHOWN = 20


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Bulk lines of a file or folder with their order (``seq``); raises with file and line of what is wrong."""
    lines = read_lines(spark, path)
    found = parse_jsonl(lines)
    wrong = found.where("problem is not null")
    n = wrong.count()
    if n:
        at = wrong.orderBy("seq").limit(SHOWN).select("path", "problem", "seq.*").join(line_numbers(lines), ["file", "start"])
        number = (F.col("row") - F.col("first") + F.col("before") + 1).alias("line")
        shown = at.select("file", number, "path", "problem").orderBy("file", "line").collect()
        texts = [f"{r['file'].rsplit('/', 1)[-1]} line {r['line']}: {r['problem']}" + (f" ({r['path']})" if r["path"] else "") for r in shown]
        raise BadBatch(texts + ([f"and {n - len(shown)} more"] if n > len(shown) else []))
    return found.drop("problem")


# Markdown


def markdown(title: Column | str, tags: Column | str, body: Column | str) -> Column:
    tag_line = F.when(F.size(tags_or_empty(tags)) > 0, F.concat(F.lit(TAGS_KEY), F.array_join(col(tags), ", "), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(FENCE + TITLE_KEY), col(title), F.lit("\n"), tag_line, F.lit(FENCE), col(body))


def to_markdown(notes: DataFrame) -> DataFrame:
    """(path, content); the file's name is the path with .md."""
    return notes.select("path", markdown("title", "tags", "body").alias("content"))


def parse_markdown(files: DataFrame) -> DataFrame:
    """path, title, tags, body and ``problem`` of ``files(path, content)``. Front matter is strict, the body is verbatim."""
    head = F.regexp_extract("content", r"(?s)\A---\n(.*?\n)?---\n", 1)
    closed = F.col("content").rlike(r"(?s)\A---\n(.*?\n)?---\n")
    lines = F.filter(F.split(head, "\n"), lambda x: x.isNotNull())
    lines = F.slice(lines, F.lit(1), F.greatest(F.lit(0), F.size(lines) - 1))  # the text ends with a line break
    titles, tags = F.filter(lines, lambda x: x.startswith(TITLE_KEY)), F.filter(lines, lambda x: x.startswith(TAGS_KEY))
    title = F.substring(F.get(titles, F.lit(0)), len(TITLE_KEY) + 1, 1 << 30)
    problem = (
        F.when(~F.col("content").startswith(FENCE), "first line must be ---")
        .when(~closed, "front matter isn't closed")
        .when(F.size(titles) > 1, "title twice")
        .when(F.size(tags) > 1, "tags twice")
        .when(F.size(titles) + F.size(tags) < F.size(lines), "unknown line")
        .when((F.size(titles) == 0) | (trimmed(F.coalesce(title, F.lit(""))) == ""), "no title")
        .when(~valid_path("path"), "bad path")
    )
    body = F.substring(F.col("content"), F.length(F.regexp_extract("content", r"(?s)\A---\n(.*?\n)?---\n", 0)) + 1, F.length("content"))
    listed = F.when(F.size(tags) > 0, split_tags(F.substring(F.get(tags, F.lit(0)), len(TAGS_KEY) + 1, 1 << 30)))
    return files.select("path", title.alias("title"), listed.alias("tags"), body.alias("body"), problem.alias("problem"))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """All notes of a folder tree, or BadBatch with every problem: other files, bad front matter, a.md beside a/b.md."""
    base = folder.rstrip("/")
    files = spark.read.option("recursiveFileLookup", "true").text(base, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("file"))
    # Paths are relative to the folder as the file system names it.
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    inside = F.expr("reflect('java.net.URLDecoder', 'decode', replace(file, '+', '%2B'), 'UTF-8')")
    relative = F.regexp_replace(inside, "^(file:)?/*" + root.lstrip("/") + "/", "")
    named = files.select("content", relative.alias("name"))
    parsed = parse_markdown(named.select(F.regexp_replace("name", r"\.md$", "").alias("path"), "content"))
    others = [f"{r['name']}: not a .md file" for r in named.where(~F.col("name").endswith(".md")).select("name").collect()]
    parsed = parsed.where(~F.col("path").isin([o.split(": ")[0] for o in others])) if others else parsed
    bad = [f"{r['path']}: {r['problem']}" for r in parsed.where("problem is not null").collect()]
    clash = [f"{r['path']}: note and directory" for r in type_clashes(parsed).collect()]
    if others or bad or clash:
        raise BadBatch(sorted(others + bad + clash))
    return parsed.drop("problem")


def write_markdown(files: DataFrame, folder: str, force: bool = False) -> int:
    """Writes ``files(path, content)`` as path.md below a folder that driver and executors share (local path, HDFS or
    an object store that pyarrow knows); refuses to replace files unless forced."""
    spark = files.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(root).toUri()
    if not force:
        there = [p for (p,) in files.select("path").toLocalIterator() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base.toString()}/{p}.md"))]
        if there:
            raise BadBatch([f"{p}.md exists" for p in sorted(there)])
    where = base.getPath() if base.getScheme() == "file" else base.toString().replace("s3a://", "s3://", 1)

    def write(rows) -> None:
        from pyarrow import fs as arrow_fs

        store, top = (arrow_fs.LocalFileSystem(), where) if where.startswith("/") else arrow_fs.FileSystem.from_uri(where)
        for r in rows:
            name = f"{top}/{r['path']}.md"
            store.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(name) as f:
                f.write(r["content"].encode())

    files.foreachPartition(write)
    return files.count()


# backups


def object_lines(objects: DataFrame) -> DataFrame:
    return objects.select(F.to_json(F.struct(F.lit("object").alias("type"), "addr", "kind", F.octet_length("data").alias("size"), F.base64("data").alias("data"))).alias("value"))


def backup_lines(objects: DataFrame, projects: DataFrame, branches: DataFrame, created_at: int) -> DataFrame:
    """A library as JSON lines: header, objects, projects, branches. Meta is not part of it."""
    spark = objects.sparkSession
    empty = F.lit(None).cast("string").alias("data")
    header = spark.range(1).select(F.to_json(F.struct(F.lit("header").alias("type"), F.lit(LIBRARY_VERSION).alias("schema_version"), F.lit(created_at).alias("created_at"), empty), {"ignoreNullFields": "false"}).alias("value"))
    some = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    project = projects.select(F.to_json(F.struct(F.lit("project").alias("type"), "name", some("description"))).alias("value"))
    branch = branches.select(F.to_json(F.struct(F.lit("branch").alias("type"), "addr", "name", some("description"), "project")).alias("value"))
    return header.unionByName(object_lines(objects)).unionByName(project).unionByName(branch)


def parse_backup(lines: DataFrame) -> DataFrame:
    return lines.where(trimmed("value") != "").select(F.from_json("value", BACKUP).alias("o")).select("o.*")


def check_header(rows: DataFrame) -> int:
    """The backup's version, which must be one that can be read."""
    found = [r["schema_version"] for r in rows.where("type = 'header'").limit(2).collect()]
    if len(found) != 1 or found[0] is None or not OLDEST_BACKUP <= found[0] <= LIBRARY_VERSION:
        raise VersionMismatch(f"backup version {found}, readable are {OLDEST_BACKUP} to {LIBRARY_VERSION}")
    return found[0]


def parse_objects(lines: DataFrame) -> DataFrame:
    """Objects of backup lines; ``intact`` says whether the bytes hash to the address."""
    rows = parse_backup(lines).where("type = 'object'")
    data = F.unbase64(F.coalesce("data", F.lit("")))
    return rows.select("addr", "kind", F.octet_length(data).cast("long").alias("size"), data.alias("data"), (address(data) == F.col("addr")).alias("intact"))
