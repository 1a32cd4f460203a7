"""Canonical JSON of objects, and back.

Fields stand in declaration order, empty optional fields are left out, and
``<``, ``>``, ``&`` and the two Unicode line separators are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidObject
from ..schema import JSON_SCHEMAS, OBJECT_VERSION
from .scalars import address, col, is_address, is_entry_type, tags_or_empty, trimmed


def escaped(json: Column) -> Column:
    for plain, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        json = F.replace(json, F.lit(plain), F.lit(code))
    return json


def to_canonical(*fields: Column) -> Column:
    return escaped(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}))


def _some(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def _text(c: Column | str) -> Column:
    return F.when(col(c) != "", col(c))


def encode_note(title: Column | str, tags: Column | str, created_at: Column | str, body_addr: Column | str, links: Column | str | None = None) -> Column:
    meta = F.struct(col(title).alias("title"), _some(F.array_sort(tags_or_empty(tags))).alias("tags"), col(created_at).cast("long").alias("created_at"), F.lit(OBJECT_VERSION).alias("schema_version"))
    fields = [F.lit("note").alias("kind"), meta.alias("meta"), col(body_addr).alias("body")]
    if links is not None:
        # A stable sort by slug: the place is the second key.
        placed = F.transform(F.coalesce(col(links), F.array().cast("array<struct<slug:string,rel:string>>")), lambda x, i: F.struct(x["slug"].alias("slug"), i.alias("i"), x["rel"].alias("rel")))
        fields.append(_some(F.transform(F.array_sort(placed), lambda x: F.struct(x["slug"].alias("slug"), _text(x["rel"]).alias("rel")))).alias("links"))
    return to_canonical(*fields)


def encode_tree(entries: Column | str) -> Column:
    """``entries`` is an array of struct<slug, type, addr>."""
    return to_canonical(F.lit("tree").alias("kind"), F.array_sort(col(entries)).alias("entries"))


EMPTY_TREE = '{"kind":"tree","entries":[]}'


def encode_snapshot(root: Column | str, parents: Column | str, time: Column | str, message: Column | str, index: Column | str | None = None, vec: Column | str | None = None) -> Column:
    fields = [F.lit("snapshot").alias("kind"), col(root).alias("root"), _some(F.array_sort(F.coalesce(col(parents), F.array().cast("array<string>")))).alias("parents"), col(time).cast("long").alias("time"), col(message).alias("message")]
    fields += [_text(c).alias(n) for c, n in ((index, "index"), (vec, "vec")) if c is not None]
    return to_canonical(*fields)


def encode_index_root(version: Column, shards: Column, docs: Column) -> Column:
    """``docs`` is an array of struct<a, p, l>, ordered by address."""
    return to_canonical(F.lit("indexroot").alias("kind"), version.alias("version"), shards.alias("shards"), F.array_sort(docs).alias("docs"))


def encode_index_shard(bucket: Column, postings: Column) -> Column:
    """``postings`` is an array of struct<term, list: array<struct<a, t, g, b>>>; terms in byte order."""
    ordered = F.transform(F.array_sort(postings), lambda p: F.struct(p["term"].alias("key"), F.array_sort(p["list"]).alias("value")))
    return to_canonical(F.lit("indexshard").alias("kind"), bucket.alias("bucket"), F.map_from_entries(ordered).alias("postings"))


def encode_vec_root(model: Column, dim: Column, shards: Column) -> Column:
    return to_canonical(F.lit("vecroot").alias("kind"), model.alias("model"), dim.alias("dim"), shards.alias("shards"))


def encode_vec_shard(model: Column, dim: Column, items: Column) -> Column:
    """``items`` is an array of struct<path, vec>, ordered by path."""
    return to_canonical(F.lit("vecshard").alias("kind"), model.alias("model"), dim.alias("dim"), F.array_sort(items).alias("items"))


def addressed(json: Column) -> Column:
    """struct<addr, data> of canonical text."""
    return F.struct(address(json).alias("addr"), json.cast("binary").alias("data"))


def decode(objects: DataFrame, kind: str) -> DataFrame:
    """``objects`` of one kind with their parsed content ``o``; rows that don't parse as that kind have a null ``o``."""
    parsed = F.from_json(F.col("data").cast("string"), JSON_SCHEMAS[kind])
    right = parsed["kind"] == kind
    if kind == "note":
        right = right & (parsed["meta"]["schema_version"] == OBJECT_VERSION)
    if kind == "tree":
        right = right & F.forall(F.coalesce(parsed["entries"], F.array().cast("array<struct<slug:string,type:string,addr:string>>")), lambda e: F.coalesce(is_entry_type(e["type"]), F.lit(False)))
    return objects.where(F.col("kind") == kind).withColumn("o", F.when(right, parsed))


# validation: null where the object is right, else what is wrong


def note_problem(o: Column) -> Column:
    links = F.coalesce(o["links"], F.array().cast("array<struct<slug:string,rel:string>>"))
    return (
        F.when(F.coalesce(trimmed(o["meta"]["title"]), F.lit("")) == "", "no title")
        .when(F.coalesce(o["meta"]["created_at"], F.lit(0)) <= 0, "bad created_at")
        .when(~is_address(o["body"]), "bad body address")
        .when(F.exists(links, lambda x: F.coalesce(trimmed(x["slug"]), F.lit("")) == ""), "link without slug")
    )


def tree_problem(o: Column) -> Column:
    entries = F.coalesce(o["entries"], F.array().cast("array<struct<slug:string,type:string,addr:string>>"))
    slugs = F.transform(entries, lambda e: e["slug"])
    return (
        F.when(F.exists(entries, lambda e: F.coalesce(trimmed(e["slug"]), F.lit("")) == ""), "entry without slug")
        .when(F.size(F.array_distinct(slugs)) < F.size(slugs), "slug twice")
        .when(F.exists(entries, lambda e: ~is_entry_type(e["type"])), "bad entry type")
        .when(F.exists(entries, lambda e: ~is_address(e["addr"])), "bad entry address")
    )


def snapshot_problem(o: Column) -> Column:
    parents = F.coalesce(o["parents"], F.array().cast("array<string>"))
    return (
        F.when(~is_address(o["root"]), "bad root address")
        .when(F.exists(parents, lambda p: ~is_address(p)), "bad parent address")
        .when(F.size(F.array_distinct(parents)) < F.size(parents), "parent twice")
        .when(F.coalesce(o["time"], F.lit(0)) <= 0, "bad time")
    )


def checked(objects: DataFrame, kind: str) -> DataFrame:
    """Raises for the first object of ``kind`` that doesn't decode or validate; else ``objects``."""
    problems = {"note": note_problem, "tree": tree_problem, "snapshot": snapshot_problem}
    rows = decode(objects, kind)
    wrong = F.when(F.col("o").isNull(), "doesn't decode")
    if kind in problems:
        wrong = wrong.otherwise(problems[kind](F.col("o")))
    first = rows.select("addr", wrong.alias("wrong")).where("wrong is not null").head()
    if first:
        raise InvalidObject(f"{kind} {first['addr']}: {first['wrong']}")
    return objects
