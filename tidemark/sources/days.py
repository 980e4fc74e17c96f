"""Tables that are kept by day: a folder for each date, rewritten day by day, listed without reading rows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..session import shared_folder


@dataclass
class DayStore:
    """A Parquet table partitioned by its column ``day``."""

    spark: SparkSession
    name: str
    day: str = "date"

    @classmethod
    def create(cls, spark: SparkSession, schema: StructType, *, name: str | None = None, folder: str | None = None, day: str = "date") -> DayStore:
        """A new table of these columns, ``day`` (a date) among them, in ``folder`` or a new one in the shared folder."""
        name = name or f"days_{uuid.uuid4().hex}"
        folder = folder or f"{shared_folder(spark)}/tidemark/{name}"
        own = StructType([f for f in schema if f.name != day] + [StructField(day, DateType())])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (`{day}`) LOCATION '{folder}'")
        return cls(spark, name, day)

    def write(self, rows: DataFrame, files: int = 1) -> None:
        """Puts these rows in place of the days that they have; other days stay as they are. Each day gets up to ``files`` files."""
        columns = self.spark.table(self.name).columns
        spread = F.pmod(F.xxhash64(*(c for c in columns if c != self.day)), F.lit(files))
        key, mode = "spark.sql.sources.partitionOverwriteMode", self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set(key, "dynamic")
        try:
            rows.select(*columns).repartition(F.col(self.day), spread).write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(key, mode)

    def read(self, start: date | None = None, end: date | None = None, **among: list[str]) -> DataFrame:
        """Rows of some days, only their folders are read; ``among`` limits columns to listed values."""
        rows = self.spark.table(self.name)
        if start:
            rows = rows.where(F.col(self.day) >= F.lit(start))
        if end:
            rows = rows.where(F.col(self.day) <= F.lit(end))
        for column, values in among.items():
            rows = rows.where(F.col(column).isin(values))
        return rows

    def days(self) -> DataFrame:
        """(date) of every day that there is, from the table's partitions alone."""
        told = self.spark.sql(f"SHOW PARTITIONS {self.name}")
        return told.select(F.to_date(F.substring_index("partition", "=", -1)).alias("date")).where("date IS NOT NULL")

    def status(self) -> DataFrame:
        """One row: first and last day, how many there are, and how many between them are missing."""
        row = self.days().agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("days"))
        return row.withColumn("missing", F.coalesce(F.datediff("last_day", "first_day") + 1, F.lit(0)) - F.col("days"))

    def drop_days(self, before: date) -> None:
        """Retention: days before this one leave the table; their files stay for the storage's own rules."""
        old = [r["date"] for r in self.days().where(F.col("date") < F.lit(before)).collect()]  # one row for each day
        if old:
            parts = ", ".join(f"PARTITION (`{self.day}` = DATE '{d}')" for d in old)
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {parts}")

    def forget(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def coverage(one: DayStore, other: DayStore) -> DataFrame:
    """(date, kind) of each day in both stores, the first or the second alone; no rows are read."""
    here, there = one.days().withColumn("_a", F.lit(True)), other.days().withColumn("_b", F.lit(True))
    kind = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").otherwise("second")
    return here.join(there, "date", "full").select("date", kind.alias("kind"))
