"""Row contracts of everything shown to users: names and order of columns are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log_time, short_address, slug_of, summary, tags_or_empty


def project_rows(stats: DataFrame) -> DataFrame:
    return stats.select("name", "description", "branches").orderBy("name")


def note_ls_rows(notes: DataFrame) -> DataFrame:
    return notes.select("path", slug_of("path").alias("slug"), "title", tags_or_empty("tags").alias("tags"), "created_at", summary("body").alias("summary"))


def note_rows(notes: DataFrame) -> DataFrame:
    return notes.select("path", "title", tags_or_empty("tags").alias("tags"), "body", summary("body").alias("summary"))


def search_rows(hits: DataFrame, mode: str | None = None) -> DataFrame:
    """Rows of a search; ``snippet`` and ``mode`` only where they were asked for."""
    columns = ["path", slug_of("path").alias("slug"), "addr", "title", tags_or_empty("tags").alias("tags"), summary("body").alias("summary"), "score"]
    columns += ["snippet"] if "snippet" in hits.columns else []
    columns += [F.lit(mode).alias("mode")] if mode else []
    return hits.select(*columns)


def log_rows(log: DataFrame, limit: int | None = None) -> DataFrame:
    rows = log.orderBy("depth").select(short_address("addr").alias("id"), log_time("time").alias("time"), "message", F.transform("parents", short_address).alias("parents"))
    return rows if limit is None else rows.limit(limit)


def diff_rows(diff: DataFrame) -> DataFrame:
    return diff.select("path", "type", F.coalesce("from", F.lit("")).alias("from"), F.coalesce("to", F.lit("")).alias("to")).orderBy("path")


def branch_rows(branches: DataFrame) -> DataFrame:
    return branches.select("name", "addr", "description").orderBy("name")


def merge_state_row(project: str, branch: str, state: dict | None) -> dict:
    if state is None:
        return {"project": project, "branch": branch, "state": "idle", "can_continue": False, "can_abort": False, "base": "", "theirs": "", "ours": "", "conflicts": [], "conflict_count": 0, "merged_branch": ""}
    conflicts = [{**c, "resolved": c["path"] in state["resolved"]} for c in state["conflicts"]]
    return {"project": project, "branch": branch, "state": "merging", "can_continue": bool(state["resolved"]), "can_abort": True, "base": state["base"], "theirs": state["theirs"], "ours": state["ours"], "conflicts": conflicts, "conflict_count": len(conflicts), "merged_branch": f"{branch}-merge"}
