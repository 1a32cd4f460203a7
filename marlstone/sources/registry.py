"""Projects and branches as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DESCRIPTION_CHARS


def project_stats(projects: DataFrame, branches: DataFrame) -> DataFrame:
    """name, description and number of branches of every project, by name."""
    named = branches.select(F.col("project").alias("_p"), F.col("name").alias("_b"))
    return projects.join(named, projects["name"] == named["_p"], "left").groupBy("name", "description").agg(F.count("_b").alias("branches")).orderBy("name")


def project_create(projects: DataFrame, new: DataFrame) -> DataFrame:
    """Adds projects that aren't there; a present one keeps its description."""
    return projects.unionByName(new.join(projects.select("name"), "name", "left_anti").select(*projects.columns))


def branch_upsert(branches: DataFrame, moves: DataFrame) -> DataFrame:
    """Sets addresses of (project, name); other columns, descriptions among them, stay."""
    new = moves.select("project", "name", F.col("addr").alias("_addr"))
    found = branches.join(new, ["project", "name"], "full_outer")
    return found.select("project", "name", F.coalesce("_addr", "addr").alias("addr"), F.coalesce("description", F.lit("")).alias("description"))


def branch_list(branches: DataFrame, project: str | None = None) -> DataFrame:
    if project is None:
        return branches.orderBy("project", "name")
    return branches.where(F.col("project") == project).orderBy("name")


def check_description(text: str) -> str:
    if len(text) > DESCRIPTION_CHARS:
        raise ValueError(f"a description has at most {DESCRIPTION_CHARS} characters")
    return text
