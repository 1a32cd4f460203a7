"""Set differences over versions: diff, staging overlay and three-way merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ancestors_of
from ..lineage import cut
from .tree import COLUMNS


def diff(base: DataFrame, tip: DataFrame, labels: tuple[str, str, str] = ("added", "removed", "updated")) -> DataFrame:
    """Changed notes of two leaf relations ``(path, addr)``: path, type, from, to. A move is a removal and an addition."""
    both = base.select("path", F.col("addr").alias("from")).join(tip.select("path", F.col("addr").alias("to")), "path", "full_outer")
    kind = F.when(F.col("from").isNull(), labels[0]).when(F.col("to").isNull(), labels[1]).otherwise(labels[2])
    return both.where(~F.col("from").eqNullSafe(F.col("to"))).select("path", kind.alias("type"), "from", "to")


def stage_changes(base: DataFrame, stage: DataFrame) -> DataFrame:
    """What a stage holds: op (A, M, D) and path."""
    return diff(base, stage, ("A", "D", "M")).select(F.col("type").alias("op"), "path", F.col("to").alias("addr"))


def overlay(head: DataFrame, changes: DataFrame) -> DataFrame:
    """``head`` leaves with staged changes on top; the stage wins per path, deleting what isn't there is no error."""
    return head.select("path", "addr").join(changes.select("path"), "path", "left_anti").unionByName(changes.where("op <> 'D'").select("path", "addr"))


def _value(prefix: str) -> Column:
    return F.when(F.col(f"{prefix}_addr").isNotNull() | F.col(f"{prefix}_type").isNotNull(), F.struct(F.col(f"{prefix}_type").alias("t"), F.col(f"{prefix}_addr").alias("a")))


def _three(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    def side(rows: DataFrame, name: str) -> DataFrame:
        kind = F.col("type") if "type" in rows.columns else F.lit("note")
        return rows.select("path", kind.alias(f"{name}_type"), F.col("addr").alias(f"{name}_addr"))

    return side(base, "base").join(side(ours, "ours"), "path", "full_outer").join(side(theirs, "theirs"), "path", "full_outer")


def _decided(rows: DataFrame) -> DataFrame:
    """Adds decision (same, ours, theirs, recurse, conflict), conflict kind and whether the entry counts as merged."""
    base, ours, theirs = _value("base"), _value("ours"), _value("theirs")
    both_dirs = F.coalesce((F.col("ours_type") == "dir") & (F.col("theirs_type") == "dir"), F.lit(False))
    decision = F.when(ours.eqNullSafe(theirs), "same").when(theirs.eqNullSafe(base), "ours").when(ours.eqNullSafe(base), "theirs").when(both_dirs, "recurse").otherwise("conflict")
    one_dir = F.col("ours_type").isNotNull() & F.col("theirs_type").isNotNull() & ((F.col("ours_type") == "dir") != (F.col("theirs_type") == "dir"))
    absent = F.col("ours_type").isNull() | F.col("theirs_type").isNull()
    kind = F.when(one_dir, "type").when(absent, "modify-delete").otherwise("content")
    merged = F.when(F.col("decision") == "same", ~ours.eqNullSafe(base)).otherwise(F.col("decision").isin("ours", "theirs"))
    return rows.withColumn("decision", decision).withColumn("conflict", F.when(F.col("decision") == "conflict", kind)).withColumn("merged", merged)


def merge_leaves(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Three-way merge of leaf relations: path, class and the merged address (conflicts keep ours).

    class: unchanged, same, ours, theirs, or the conflict's kind.
    """
    rows = _decided(_three(base, ours, theirs))
    unchanged = (F.col("decision") == "same") & ~F.col("merged")
    name = F.when(unchanged, "unchanged").when(F.col("decision") == "conflict", F.col("conflict")).otherwise(F.col("decision"))
    result = F.when(F.col("decision") == "theirs", F.col("theirs_addr")).otherwise(F.col("ours_addr"))
    return rows.select("path", name.alias("class"), "base_addr", "ours_addr", "theirs_addr", result.alias("addr"))


def merge_levels(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Three-way merge of entries, level by level from the root.

    Only directories that differ on both sides go down a level, so equal subtrees are never
    read. Gives the decided entries (path, decision), the conflicts and how many entries
    merged by themselves, each counted at the level where it was decided.
    """
    spark = ours.sparkSession
    open_dirs = spark.createDataFrame([("",)], "parent string")
    decided, conflicts, merged, depth = [], [], 0, 0
    while True:
        depth += 1
        sides = [e.where(F.col("depth") == depth).join(open_dirs, "parent", "left_semi") for e in (base, ours, theirs)]
        level = cut(_decided(_three(*sides)))
        counts = level.agg(F.count(F.when(F.col("merged"), 1)).alias("merged"), F.count(F.when(F.col("decision") == "recurse", 1)).alias("deeper")).collect()[0]
        merged += counts["merged"]
        decided.append(level.where("decision in ('theirs', 'same', 'ours')").select("path", "decision"))
        conflicts.append(level.where("decision = 'conflict'").select("path", F.col("conflict").alias("kind"), F.coalesce("base_addr", F.lit("")).alias("base"), F.coalesce("ours_addr", F.lit("")).alias("ours"), F.coalesce("theirs_addr", F.lit("")).alias("theirs")))
        if not counts["deeper"]:
            break
        open_dirs = level.where("decision = 'recurse'").select(F.col("path").alias("parent"))
    for parts in (decided, conflicts):
        while len(parts) > 1:
            parts[:2] = [parts[0].unionByName(parts[1])]
    return decided[0], conflicts[0].orderBy("path"), merged


def taken_from_theirs(entries: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``entries`` at or below a path where theirs was chosen."""
    roots = decided.where("decision = 'theirs'").select(F.col("path").alias("_root"))
    inside = entries.withColumn("_root", F.explode(F.concat(ancestors_of("path"), F.array("path")))).join(roots, "_root", "left_semi")
    return inside.drop("_root").dropDuplicates(["path"])


def merged_entries(ours: DataFrame, theirs: DataFrame, decided: DataFrame) -> DataFrame:
    """Entries after a merge: ours, with the subtrees where theirs was chosen exchanged. Directory addresses on the way must be computed anew."""
    out = ours.join(taken_from_theirs(ours, decided).select("path"), "path", "left_anti")
    return out.select(*COLUMNS).unionByName(taken_from_theirs(theirs, decided).select(*COLUMNS))
