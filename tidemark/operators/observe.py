"""State derived from append-only observations (date, batch, platform_id, item, rank).

An observation says that an item stood at a rank of a platform's list in one poll. Nothing
is updated in place: first and last sight, counts, new and dropped items, title changes and
on-list episodes are aggregates and windows over the observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import hotness_of_group

KEY = ["date", "platform_id", "item"]


def item_state(obs: DataFrame) -> DataFrame:
    """First and last batch, number of sights and last rank of each item and day."""
    return obs.groupBy(*KEY).agg(
        F.min("batch").alias("first_batch"),
        F.max("batch").alias("last_batch"),
        F.count("*").alias("crawl_count"),
        F.max_by("rank", "batch").alias("last_rank"),
    )


def item_hotness(obs: DataFrame, threshold: int = 5) -> DataFrame:
    return obs.groupBy(*KEY).agg(
        F.round(hotness_of_group("rank", threshold), 4).alias("weight"), F.min("rank").alias("best_rank"), F.count("*").alias("n")
    )


def top_of_platform(scored: DataFrame, k: int) -> DataFrame:
    """The k hottest items of each platform, ties by best rank, count and item."""
    order = Window.partitionBy("platform_id").orderBy(F.desc("weight"), "best_rank", F.desc("n"), "date", "item")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def rank_timeline(obs: DataFrame) -> DataFrame:
    """All ranks in time order, and the distinct ones in order of first sight."""
    full = F.transform(F.array_sort(F.collect_list(F.struct("batch", "rank"))), lambda x: x["rank"])
    rows = obs.groupBy(*KEY).agg(full.alias("ranks"))
    return rows.select(*KEY, F.array_join("ranks", ",").alias("ranks_full"), F.array_join(F.array_distinct("ranks"), ",").alias("ranks_distinct"))


def new_items(obs: DataFrame) -> DataFrame:
    """Items of a day's latest batch that no earlier batch of the day had."""
    last = obs.groupBy("date").agg(F.max("batch").alias("day_batch"))
    state = item_state(obs).join(last, "date")
    return state.where(F.col("first_batch") == F.col("day_batch")).select(*KEY, F.col("first_batch").alias("batch"))


def off_list(obs: DataFrame) -> DataFrame:
    """Items that a platform's next polled batch of the day no longer has: one row at the first miss."""
    polls = obs.select("date", "platform_id", "batch").distinct()
    following = Window.partitionBy("date", "platform_id").orderBy("batch")
    polls = polls.withColumn("next_batch", F.lead("batch").over(following))
    seen = Window.partitionBy(*KEY).orderBy("batch")
    rows = obs.select(*KEY, "batch").withColumn("next_seen", F.lead("batch").over(seen)).join(polls, ["date", "platform_id", "batch"])
    gone = F.col("next_batch").isNotNull() & (F.col("next_seen").isNull() | (F.col("next_seen") > F.col("next_batch")))
    return rows.where(gone).select(*KEY, F.col("next_batch").alias("missed_batch"))


def episodes(obs: DataFrame) -> DataFrame:
    """Stretches of consecutive batches on the list (gaps and islands)."""
    seen = Window.partitionBy(*KEY).orderBy("batch")
    rows = obs.select(*KEY, "batch", "rank").withColumn("island", F.col("batch") - F.row_number().over(seen))
    return (
        rows.groupBy(*KEY, "island")
        .agg(F.min("batch").alias("start_batch"), F.max("batch").alias("end_batch"), F.min("rank").alias("best_rank"))
        .drop("island")
    )


def rank_moves(obs: DataFrame) -> DataFrame:
    """up, down or same against the sight before."""
    seen = Window.partitionBy(*KEY).orderBy("batch")
    rows = obs.select(*KEY, "batch", "rank", F.lag("rank").over(seen).alias("before"))
    move = F.when(F.col("rank") < F.col("before"), "up").when(F.col("rank") > F.col("before"), "down").otherwise("same")
    return rows.where(F.col("before").isNotNull()).select(*KEY, "batch", "rank", "before", move.alias("move"))


def latest_batch(obs: DataFrame) -> DataFrame:
    """Rows of the newest batch over all platforms."""
    newest = obs.agg(F.max(F.struct("date", "batch")).alias("m")).select("m.date", "m.batch")
    return obs.join(F.broadcast(newest), ["date", "batch"], "left_semi")  # one row


def merge_batches(obs: DataFrame) -> DataFrame:
    """Batches of a day as one: sorted distinct ranks, times and count."""
    return obs.groupBy(*KEY).agg(
        F.array_join(F.array_sort(F.collect_set("rank")), ",").alias("ranks"),
        F.min("batch").alias("first_batch"),
        F.max("batch").alias("last_batch"),
        F.count("*").alias("n"),
    )


def previous_batch(obs: DataFrame) -> DataFrame:
    """The batch of a platform and day before each batch (backward as-of)."""
    order = Window.partitionBy("date", "platform_id").orderBy("batch")
    return obs.select("date", "platform_id", "batch").distinct().withColumn("previous", F.lag("batch").over(order))


def title_changes(obs: DataFrame, key: list[str], title: str, time: str) -> DataFrame:
    """Each change of a title under one key."""
    order = Window.partitionBy(*key).orderBy(time)
    rows = obs.select(*key, F.col(time), F.lag(title).over(order).alias("old_title"), F.col(title).alias("new_title"))
    return rows.where(F.col("old_title") != F.col("new_title"))
