"""Continuous bulk import: files of JSON lines become snapshots, one per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.repository import Repository
from ..sources.formats import parse_jsonl


def ingest(repo: Repository, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads bulk lines of new files below ``folder``. A batch that was committed before is not committed again.

    Lines that can't be read are left out of the snapshot and kept in the warehouse under ``rejected``.
    """

    def commit(batch: DataFrame, number: int) -> None:
        key = f"ingest.{repo.project}.{repo.branch}.{folder}"
        if int(repo.store.meta_get(key, None) or -1) >= number:
            return
        rows = parse_jsonl(batch)
        bad = rows.where("problem is not null")
        if not bad.isEmpty():
            bad.select("path", "problem").write.mode("append").parquet(f"{repo.store.path}/rejected")
        good = rows.where("problem is null").drop("problem")
        if not good.isEmpty():
            links = F.lit(None).cast("array<struct<slug:string,rel:string>>")
            repo.bulk_import(good.withColumns({"links": links, "created_at": F.lit(None).cast("long")}), f"ingest {number}")
        repo.store.meta_set(key, str(number))

    stream = repo.spark.readStream.schema("value string").text(folder)
    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
