"""Cutting lineage in iterative operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bits of an estimated size that is carried on: an exabyte.
SIZED = 60


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master a temporary one, set once, where that is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="marlstone-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, read by any executor.

    A checkpoint keeps its plan's estimated size, and a join's is the product of both sides': where a loop joins what it
    has cut before, the number's digits double every round, until the driver holds little else. Beyond SIZED bits the
    rows go on without an estimate.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)
    if kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= SIZED:
        return kept
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), spark)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, and how many rows it has: no job of its own for that."""
    seen = Observation()
    return cut(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]


def tidied(spark: SparkSession) -> None:
    """Lets shuffle files and checkpoints go that nothing refers to any more: Spark deletes them when the driver collects its
    garbage, which a driver with little to do may not for as long as a commit of many texts takes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def at_once(*works: Callable[[], object]) -> None:
    """Runs writes that don't need one another side by side, so that small ones don't wait for each other's jobs."""
    with ThreadPoolExecutor(max(1, min(4, len(works)))) as pool:
        for done in [pool.submit(w) for w in works]:
            done.result()
