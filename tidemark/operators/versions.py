"""Changes of several tables that readers see as one.

New versions of the changed tables are written first, each to a folder of its own; then one
row that names the current folder of every table is written, in one file. A reader takes the
newest such row and reads what it names, so it sees all of a change or nothing of it, also
where a writer has failed in between. There is one writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "version long, tables map<string, string>"


@dataclass
class VersionedTables:
    """Tables under one folder, which driver and executors share."""

    spark: SparkSession
    folder: str

    def _pointers(self) -> DataFrame:
        self.spark.createDataFrame([], _POINTER).write.mode("append").parquet(f"{self.folder}/pointers")  # so that there is a table
        return self.spark.read.schema(_POINTER).parquet(f"{self.folder}/pointers")

    def current(self) -> tuple[int, dict[str, str]]:
        """The newest version and the folder of each of its tables."""
        row = self._pointers().agg(F.max("version").alias("v"), F.max_by("tables", "version").alias("t")).first()
        return (row["v"], dict(row["t"])) if row["v"] is not None else (0, {})

    def read(self, *names: str) -> list[DataFrame]:
        """Tables of one version."""
        _, folders = self.current()
        return [self.spark.read.parquet(folders[name]) for name in names]

    def commit(self, **changed: DataFrame) -> int:
        """Writes the new versions, then the pointer; other tables stay as they are."""
        version, folders = self.current()
        for name, rows in changed.items():
            path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            rows.write.parquet(path)
            folders[name] = path
        row = self.spark.createDataFrame([(version + 1, folders)], _POINTER)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/pointers")
        return version + 1


def deprecated(rows: DataFrame, keys: DataFrame, key: str, at: Column, only_active: bool) -> DataFrame:
    """Rows whose key is listed become deprecated at that time; ``only_active`` leaves those alone that already are."""
    marked = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone") & (F.col("status") == "active" if only_active else F.lit(True))
    changed = {"status": F.when(hit, "deprecated").otherwise(F.col("status")), "deprecated_at": F.when(hit, at).otherwise(F.col("deprecated_at"))}
    return rows.join(marked, key, "left").withColumns(changed).drop("_gone")


def deprecate_tags(tags: DataFrame, results: DataFrame, log: DataFrame, gone: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tags (tag_id, status, deprecated_at) that are listed in ``gone`` are deprecated, with their active results (item_id, tag_id,
    status, deprecated_at); items that have lost an active result and keep none leave the log (item_id), so that they are judged anew."""
    new_tags = deprecated(tags, gone, "tag_id", at, only_active=False)
    new_results = deprecated(results, gone, "tag_id", at, only_active=True)
    lost = results.where("status = 'active'").join(gone.select("tag_id"), "tag_id", "left_semi").select("item_id").distinct()
    still = new_results.where("status = 'active'").select("item_id").distinct()
    return new_tags, new_results, log.join(lost.join(still, "item_id", "left_anti"), "item_id", "left_anti")


def deprecate_in(tables: VersionedTables, gone: DataFrame, at: Column) -> int:
    """``deprecate_tags`` on the tables ``tags``, ``results`` and ``log``, as one change."""
    tags, results, log = tables.read("tags", "results", "log")
    new_tags, new_results, new_log = deprecate_tags(tags, results, log, gone, at)
    return tables.commit(tags=new_tags, results=new_results, log=new_log)
