"""Feed items (date, feed_id, title, url, published_at, summary, ...): search, rule statistics, status, modes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import fresh
from ..functions.rules import Rules
from .ranking import numbered
from .search import title_or_summary


def one_per_url(items: DataFrame, *order: Column) -> DataFrame:
    """The first row of each URL in the order given; rows without a URL all stay."""
    has = F.coalesce(F.col("url"), F.lit("")) != ""
    nth = F.row_number().over(Window.partitionBy("url").orderBy(*order))
    return items.where(has).withColumn("nth", nth).where("nth = 1").drop("nth").unionByName(items.where(~has))


def within_days(items: DataFrame, as_of: date, days: int) -> DataFrame:
    """Items of the last ``days`` days up to ``as_of``; between 1 and 30."""
    days = min(max(days, 1), 30)
    return items.where(F.col("date").between(F.date_sub(F.lit(as_of), days - 1), F.lit(as_of)))


def within_limits(items: DataFrame, limits: DataFrame, as_of: Column, default: int) -> DataFrame:
    """Items that their feed's own limit of days lets through: ``limits`` has one row (feed_id, most_days) for some feeds,
    others have the default. 0 or less, or no date of publication, lets everything through."""
    known = items.join(limits.select("feed_id", F.col("most_days").alias("_most")), "feed_id", "left")
    return known.where(fresh(F.col("published_at"), as_of, F.coalesce("_most", F.lit(default)))).drop("_most")


def latest(items: DataFrame, as_of: date, days: int, limit: int, *ties: str) -> DataFrame:
    """Newest items: of a URL the row of the newest day, by date of publication."""
    rows = one_per_url(within_days(items, as_of, days), F.desc("date"), *map(F.asc, ties))
    return rows.orderBy(F.desc("published_at"), *ties).limit(limit)


def search(items: DataFrame, query: str, as_of: date, days: int, limit: int, *ties: str) -> DataFrame:
    """As ``latest``, of items that have the words in title or summary.

    A URL's newest row is chosen before its words are looked at."""
    rows = one_per_url(within_days(items, as_of, days), F.desc("date"), *map(F.asc, ties))
    return title_or_summary(rows, query).orderBy(F.desc("published_at"), *ties).limit(limit)


def status(items: DataFrame, as_of: date) -> DataFrame:
    """Items, days and last day of each feed, and its items on ``as_of``."""
    return items.groupBy("feed_id").agg(
        F.count("*").alias("n"),
        F.countDistinct("date").alias("days"),
        F.max("date").alias("last_day"),
        F.count_if(F.col("date") == F.lit(as_of)).alias("today"),
    )


def new_items(items: DataFrame, day: date) -> DataFrame:
    """Items of ``day`` whose URL the feed has not had before; without a URL an item is never new."""
    old = items.where(F.col("date") < F.lit(day)).select("feed_id", "url").distinct()
    return items.where((F.col("date") == F.lit(day)) & (F.col("url") != "")).join(old, ["feed_id", "url"], "left_anti")


def head_of_feeds(items: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first ``most`` items of each feed; 0 keeps all."""
    if most <= 0:
        return items
    nth = F.row_number().over(Window.partitionBy("feed_id").orderBy(*order))
    return items.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def with_recency(items: DataFrame, *ties: str) -> DataFrame:
    """``recency`` counts from 1, newest first. A URL has the place of its last row; without a URL it is 99."""
    keys = items.select(*dict.fromkeys(["url", "published_at", *ties]))
    rows = numbered(keys, F.desc_nulls_last("published_at"), *map(F.asc, ties), name="place")
    last = rows.where("url <> ''").groupBy("url").agg(F.max("place").alias("recency"))
    has = F.coalesce(F.col("url"), F.lit("")) != ""  # rows without a URL are many and have no partner
    met = items.where(has).join(last, "url").select(*items.columns, F.col("recency").cast("long").alias("recency"))
    return met.unionByName(items.where(~has).withColumn("recency", F.lit(99).cast("long")))


def grouped(items: DataFrame, rules: Rules, fresh_urls: DataFrame, *ties: str) -> DataFrame:
    """Items once for each URL, with the position of their rule group, recency and whether they are new."""
    rows = one_per_url(with_recency(items, *ties), *map(F.asc, ties)).withColumn("position", rules.group_of(F.col("title")))
    new = fresh_urls.where("url <> ''").select("url", F.lit(True).alias("is_new")).distinct()
    return rows.where("position IS NOT NULL").join(new, "url", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def keyword_stats(items: DataFrame, rules: Rules, fresh_urls: DataFrame, *ties: str) -> DataFrame:
    """Items of each rule group that has any. Shares are of all rows, those of a repeated URL included."""
    names = [(i, g.name) for i, g in enumerate(rules.groups)] or [(-1, "all")]
    words = items.sparkSession.createDataFrame(names, "position int, word string")
    found = grouped(items, rules, fresh_urls, *ties).groupBy("position").agg(
        F.count("*").alias("count"), F.count_if("is_new").alias("new_count"), F.min("recency").alias("best_recency")
    )
    total = items.agg(F.count("*").alias("total"))  # one row
    share = F.round(F.col("count") * 100.0 / F.col("total"), 2)
    return words.join(found, "position").crossJoin(total).withColumn("percentage", share).drop("total")


def stats_titles(items: DataFrame, rules: Rules, fresh_urls: DataFrame, cap: int, *ties: str) -> DataFrame:
    """The newest titles of each rule group, up to the group's own limit or ``cap`` (0: all)."""
    rows = grouped(items, rules, fresh_urls, *ties)
    limits = F.lit(cap)
    for i, g in enumerate(rules.groups):
        limits = F.when(F.col("position") == i, g.limit).otherwise(limits) if g.limit else limits
    nth = F.row_number().over(Window.partitionBy("position").orderBy("recency", *ties))
    most = [g.limit or cap for g in rules.groups] or [cap]
    rows = rows.withColumn("nth", nth)
    if min(most) > 0:  # a literal limit, so that partitions are cut before the shuffle
        rows = rows.where(F.col("nth") <= max(most))
    return rows.where((limits <= 0) | (F.col("nth") <= limits))


def by_mode(items: DataFrame, day: date, mode: str) -> DataFrame:
    """Rows of a report: ``daily`` all of the day, ``current`` its latest batch (``published_at`` hour), ``incremental`` new ones."""
    today = items.where(F.col("date") == F.lit(day))
    if mode == "daily":
        return today
    if mode == "incremental":
        return new_items(items, day)
    if mode == "current":
        newest = today.agg(F.date_trunc("hour", F.max("published_at")).alias("hour"))  # one row
        return today.withColumn("hour", F.date_trunc("hour", "published_at")).join(F.broadcast(newest), "hour", "left_semi").drop("hour")
    raise ValueError(f"no such mode: {mode!r}")
