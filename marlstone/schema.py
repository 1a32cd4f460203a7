"""Relations, kinds and versions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

LIBRARY_VERSION, OLDEST_BACKUP, OBJECT_VERSION = 6, 4, 1

KINDS = ("blob", "note", "tree", "snapshot", "indexroot", "indexshard", "vecroot", "vecshard")
ENTRY_TYPES = ("note", "dir")

LINKS = "array<struct<slug: string, rel: string>>"

OBJECTS = "addr string, kind string, size long, data binary"
NOTES = f"addr string, title string, tags array<string>, created_at long, links {LINKS}, body string"
ENTRIES = "path string, parent string, slug string, depth int, type string, addr string"
DELTAS = f"snapshot string, {ENTRIES}, deleted boolean"
SNAPSHOTS = "addr string, root string, parents array<string>, time long, message string, base string, chain int, indexed boolean, vectors string, line string, place long, ups array<struct<line: string, place: long>>"
EDGES = "src string, dst string, role string"
DOCS = "path string, addr string, len long"
POSTINGS = "bucket int, term string, path string, addr string, tf_title long, tf_tags long, tf_body long"
VECTORS = "generation string, model string, dim int, bucket int, path string, vec array<float>"
PROJECTS = "name string, created_at timestamp, description string"
BRANCHES = "project string, name string, addr string, updated_at timestamp, description string"
META = "key string, value string"

NOTE_INPUT = f"path string, title string, body string, tags array<string>, links {LINKS}, created_at long"

#: JSON of the canonical objects, for decoding.
NOTE_JSON = f"kind string, meta struct<title: string, tags: array<string>, created_at: long, schema_version: int>, body string, links {LINKS}"
TREE_JSON = "kind string, entries array<struct<slug: string, type: string, addr: string>>"
SNAPSHOT_JSON = "kind string, root string, parents array<string>, time long, message string, index string, vec string"
INDEX_ROOT_JSON = "kind string, version int, shards array<string>, docs array<struct<a: string, p: string, l: int>>"
INDEX_SHARD_JSON = "kind string, bucket int, postings map<string, array<struct<a: string, t: int, g: int, b: int>>>"
VEC_ROOT_JSON = "kind string, model string, dim int, shards array<string>"
VEC_SHARD_JSON = "kind string, model string, dim int, items array<struct<path: string, vec: string>>"
JSON_SCHEMAS = {"note": NOTE_JSON, "tree": TREE_JSON, "snapshot": SNAPSHOT_JSON, "indexroot": INDEX_ROOT_JSON, "indexshard": INDEX_SHARD_JSON, "vecroot": VEC_ROOT_JSON, "vecshard": VEC_SHARD_JSON}


def _clock() -> int:
    import time

    return int(time.time())


@dataclass(frozen=True)
class EngineConfig:
    """Everything a repository handle needs; nothing is read from the process."""

    warehouse: str
    project: str = "default"
    branch: str = "main"
    now: Callable[[], int] = field(default=_clock)
    indexed: bool = True
