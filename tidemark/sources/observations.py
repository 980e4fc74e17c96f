"""The base relations of the queries, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of ranked lists out of ``events``: four batches a day, an event type is a platform, a user an item."""
    events = table(spark, sf_dir, "events")
    best = events.groupBy(
        F.to_date("ts").alias("date"),
        F.floor(F.hour("ts") / 6).cast("int").alias("batch"),
        F.col("event_type").alias("platform_id"),
        F.col("user_id").alias("item"),
    ).agg(F.max("value").alias("value"))
    order = Window.partitionBy("date", "batch", "platform_id").orderBy(F.desc("value"), "item")
    return best.withColumn("rank", F.row_number().over(order)).drop("value")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with a title that changes now and then: it is made of the number that the item's best event carries."""
    events = table(spark, sf_dir, "events")
    best = F.max_by(F.get_json_object("props", "$.k"), F.struct("value", "event_id"))
    key = [F.to_date("ts").alias("date"), F.floor(F.hour("ts") / 6).cast("int").alias("batch"), F.col("event_type").alias("platform_id"), F.col("user_id").alias("item")]
    titles = events.groupBy(*key).agg(F.concat(F.lit("title "), (best.cast("long") % 3).cast("string")).alias("title"))
    return observations(spark, sf_dir).join(titles, ["date", "batch", "platform_id", "item"])


def polled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observations and how each platform's poll in each batch went (``polls``); by rule one poll in five fails and has no rows."""
    obs = observations(spark, sf_dir)
    failed = (F.col("batch") + F.dayofmonth("date") + F.length("platform_id")) % 5 == 0
    asked = obs.select("date", "batch").distinct().crossJoin(obs.agg(F.collect_set("platform_id").alias("all")))  # one row
    asked = asked.select("date", "batch", F.explode("all").alias("platform_id"))
    return obs.where(~failed), asked.withColumn("status", F.when(failed, "failed").otherwise("success"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles on platforms by day out of ``lineitem`` and ``part``."""
    lines = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_linenumber").alias("rank"), "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("platform_id"), F.col("p_name").alias("title"))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select("date", "platform_id", "title", "rank")


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries out of ``lineitem`` and ``part``: a brand is a feed, a part a page; some have no URL."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    url = F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("https://feeds/"), F.col("l_partkey").cast("string")))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.to_date("l_shipdate").alias("date"),
        F.col("p_brand").alias("feed_id"),
        F.col("p_name").alias("title"),
        url.alias("url"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 24).cast("int"))).alias("published_at"),
        F.col("p_type").alias("summary"),
        F.col("l_orderkey").alias("item"),
        F.col("l_linenumber").alias("line"),
    )
