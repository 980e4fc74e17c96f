"""Table maintenance as rewrites: a table comes in, the changed table comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(rows: DataFrame, key: list[str], time: str, values: list[str]) -> DataFrame:
    """State of a keyed upsert log: newest values, first and last time, number of sights."""
    newest = F.max_by(F.struct(*values), time).alias("v")
    return rows.groupBy(*key).agg(newest, F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("times")).select(
        *key, "v.*", "first_time", "last_time", "times"
    )


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is new are appended (one for each key), others ignored."""
    return table.unionByName(rows.join(table, key, "left_anti").dropDuplicates(key))


def insert_replace(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.join(rows, key, "left_anti").unionByName(rows)


def soft_delete(table: DataFrame, keys: DataFrame, key: list[str], status: str = "deprecated") -> DataFrame:
    """Sets the status of the rows whose key is listed."""
    marked = keys.select(*key).distinct().withColumn("_gone", F.lit(True))
    return table.join(marked, key, "left").withColumn("status", F.when(F.col("_gone"), status).otherwise(F.col("status"))).drop("_gone")


def keyed_update(table: DataFrame, changes: DataFrame, key: list[str], column: str) -> DataFrame:
    new = changes.select(*key, F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(~F.coalesce(condition, F.lit(False)))


def best_per_key(rows: DataFrame, key: str, score: str, *ties: str) -> DataFrame:
    """The row with the highest score for each key; the first of equals."""
    order = Window.partitionBy(key).orderBy(F.desc(score), *ties)
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def pending(all_rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return all_rows.join(done, key, "left_anti")


def retained(table: DataFrame, day: str, as_of: Column, days: int) -> DataFrame:
    """What a retention of ``days`` keeps; 0 keeps everything."""
    return table.where(F.col(day) >= F.date_sub(as_of, days)) if days > 0 else table
