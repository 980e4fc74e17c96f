"""Topic analytics over listings (date, platform_id, title, rank): counts, trends, comparison."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_spine
from ..functions.rules import Rules
from ..functions.score import hotness_of_group
from ..functions.text import contains, tokens


def keyword_stats(listing: DataFrame, rules: Rules) -> DataFrame:
    """Titles of each rule group (first match wins), its share of all titles, best and hottest."""
    titles = listing.groupBy("platform_id", "title").agg(F.count("*").alias("n"), hotness_of_group("rank", 3).alias("weight"))
    titles = titles.withColumn("position", rules.group_of(F.col("title")))
    total = titles.agg(F.count("*").alias("total"))
    names = titles.sparkSession.createDataFrame([(i, g.name) for i, g in enumerate(rules.groups)], "position int, word string")
    found = titles.where(F.col("position") >= 0).groupBy("position").agg(F.count("*").alias("count"), F.max("weight").alias("top_weight"))
    return (
        names.join(found, "position", "left")
        .crossJoin(total)  # one row
        .select(
            "word",
            "position",
            F.coalesce("count", F.lit(0)).alias("count"),
            F.round(F.coalesce(F.try_divide(F.col("count") * 100.0, F.col("total")), F.lit(0.0)), 2).alias("percentage"),
            F.round(F.coalesce("top_weight", F.lit(0.0)), 4).alias("top_weight"),
        )
    )


def group_titles(listing: DataFrame, rules: Rules, cap: int) -> DataFrame:
    """The hottest titles of each rule group, up to the group's own cap or ``cap``."""
    titles = listing.groupBy("platform_id", "title").agg(
        F.count("*").alias("n"), F.round(hotness_of_group("rank", 3), 4).alias("weight"), F.min("rank").alias("best_rank")
    )
    titles = titles.withColumn("position", rules.group_of(F.col("title"))).where(F.col("position") >= 0)
    order = Window.partitionBy("position").orderBy(F.desc("weight"), "best_rank", F.desc("n"), "platform_id", "title")
    caps = F.coalesce(*[F.when(F.col("position") == i, F.lit(g.limit or cap)) for i, g in enumerate(rules.groups)], F.lit(cap))
    most = max([cap, *(g.limit or cap for g in rules.groups)])  # a literal limit, so that partitions cut before the shuffle
    return titles.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).where(F.col("place") <= caps).drop("n")


def keyword_counts(listing: DataFrame, *by: str) -> DataFrame:
    return listing.select(*by, F.explode(tokens(F.col("title"))).alias("keyword")).groupBy(*by, "keyword").agg(F.count("*").alias("n"))


def top_keywords(listing: DataFrame, k: int) -> DataFrame:
    return keyword_counts(listing).orderBy(F.desc("n"), "keyword").limit(k)


def topic_series(listing: DataFrame, topic: str, start: date, end: date) -> DataFrame:
    """Mentions on each day, with zeros."""
    rows = listing.where(F.col("date").between(F.lit(start), F.lit(end)) & contains(F.col("title"), topic))
    counts = rows.groupBy("date").agg(F.count("*").alias("n"))
    return day_spine(listing, start, end).join(counts, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n"))


def topic_trend(listing: DataFrame, topic: str, start: date, end: date) -> DataFrame:
    """One row: sums, peak, change from the first day with mentions to the last, direction."""
    s = topic_series(listing, topic, start, end)
    seen = F.when(F.col("n") > 0, F.col("n"))
    row = s.agg(
        F.sum("n").alias("total"),
        F.round(F.avg("n"), 2).alias("mean"),
        F.max("n").alias("peak"),
        F.max_by("date", F.struct(F.col("n"), -F.unix_date("date"))).alias("peak_date"),
        F.min_by(seen, F.when(F.col("n") > 0, F.col("date"))).alias("first_n"),
        F.max_by("n", "date").alias("last_n"),
    )
    change = F.coalesce(F.try_divide((F.col("last_n") - F.col("first_n")) * 100.0, F.col("first_n")), F.lit(0.0))
    way = F.when(F.col("change_rate") > 10, "rising").when(F.col("change_rate") < -10, "falling").otherwise("stable")
    return row.withColumn("change_rate", F.round(change, 2)).withColumn("direction", way)


def lifecycle(listing: DataFrame, topics: list[str], start: date, end: date) -> DataFrame:
    """Stage and kind of each topic's days; all topics in one pass."""
    days = (end - start).days + 1
    named = F.array(*(F.when(contains(F.col("title"), t), F.lit(t)) for t in topics))
    rows = listing.where(F.col("date").between(F.lit(start), F.lit(end))).select("date", F.explode(named).alias("topic")).where("topic IS NOT NULL")
    counts = rows.groupBy("topic", "date").agg(F.count("*").alias("n"))
    edge = lambda a, b: F.coalesce(F.sum(F.when(F.datediff("date", F.lit(start)).between(a, b), F.col("n"))), F.lit(0))
    out = counts.groupBy("topic").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("active_days"),
        F.max("n").alias("peak"),
        F.round(F.avg("n"), 4).alias("mean_active"),
        edge(0, 2).alias("first3"),
        edge(days - 3, days - 1).alias("last3"),
        F.coalesce(F.max(F.when(F.datediff("date", F.lit(start)) >= days - 3, F.col("n"))), F.lit(0)).alias("last_peak"),
    )
    stage = (
        F.when(F.col("last3") > F.col("first3"), "rising")
        .when(F.col("last3") * 2 < F.col("first3"), "declining")
        .when(F.col("last_peak") == F.col("peak"), "burst")
        .otherwise("stable")
    )
    kind = (
        F.when((F.col("active_days") <= 2) & (F.col("peak") > 2 * F.col("mean_active")), "flash")
        .when(F.col("active_days") >= 0.6 * days, "sustained")
        .otherwise("periodic")
    )
    return out.select("topic", "total", "active_days", "peak", stage.alias("stage"), kind.alias("kind"))


def viral(listing: DataFrame, day: date, threshold: float = 3.0, least_new: int = 5) -> DataFrame:
    """Keywords that grew by ``threshold`` against the day before, or are new with enough mentions."""
    yesterday = F.date_sub(F.lit(day), 1)
    rows = keyword_counts(listing.where(F.col("date").isin(day) | (F.col("date") == yesterday)), "date")
    both = rows.groupBy("keyword").agg(
        F.coalesce(F.sum(F.when(F.col("date") == F.lit(day), F.col("n"))), F.lit(0)).alias("now"),
        F.coalesce(F.sum(F.when(F.col("date") == yesterday, F.col("n"))), F.lit(0)).alias("before"),
    )
    growth = F.try_divide(F.col("now").cast("double"), F.col("before"))
    hit = F.when(F.col("before") == 0, F.col("now") >= least_new).otherwise(growth >= threshold)
    level = F.when((F.col("before") == 0) | (growth > 2 * threshold), "high").otherwise("medium")
    return both.where((F.col("now") > 0) & hit).select("keyword", "now", "before", F.round(growth, 4).alias("growth"), level.alias("level"))


def predict(listing: DataFrame, day: date, confidence: float = 0.7, top: int = 20) -> DataFrame:
    """Keywords whose last observed days rise, from the four days up to ``day``."""
    rows = keyword_counts(listing.where(F.col("date").between(F.date_sub(F.lit(day), 3), F.lit(day))), "date")
    series = rows.groupBy("keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "n"))), lambda x: x["n"]).alias("s"))
    last, before = F.element_at("s", -1), F.element_at("s", -2)
    growth = (last - before) / before
    rising = F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i) >= F.get("s", i - 1))
    sure = F.when(F.size("s") >= 3, F.when(rising, 0.9).otherwise(0.7)).otherwise(0.6)
    found = series.where(F.size("s") >= 2).select("keyword", last.alias("now"), F.round(growth, 4).alias("growth"), sure.alias("confidence"))
    found = found.where((F.col("growth") > 0.3) & (F.col("confidence") >= confidence))
    return found.orderBy(F.desc("confidence"), F.desc("growth"), "keyword").limit(top)


def platform_compare(listing: DataFrame, topic: str) -> DataFrame:
    hit = contains(F.col("title"), topic)
    return listing.groupBy("platform_id").agg(
        F.count("*").alias("total"),
        F.countDistinct("title").alias("titles"),
        F.count_if(hit).alias("mentions"),
        F.round(F.count_if(hit) * 100.0 / F.count("*"), 2).alias("coverage"),
    )


def top_keywords_of_platform(listing: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("platform_id").orderBy(F.desc("n"), "keyword")
    return keyword_counts(listing, "platform_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def unique_topics(listing: DataFrame, among: int = 10, most: int = 5) -> DataFrame:
    """Keywords that are among the top of one platform only."""
    top = top_keywords_of_platform(listing, among)
    alone = top.groupBy("keyword").agg(F.count("*").alias("platforms")).where("platforms = 1").select("keyword")
    order = Window.partitionBy("platform_id").orderBy("place")
    own = top.join(alone, "keyword", "left_semi").withColumn("nth", F.row_number().over(order))
    return own.where(F.col("nth") <= most).select("platform_id", "keyword", "n")


def cooccurrence(listing: DataFrame, least: int = 3, top: int = 20) -> DataFrame:
    """Unordered pairs of a title's keywords; pairs are counted by distinct title first."""
    titles = listing.groupBy("title").agg(F.count("*").alias("times")).withColumn("t", tokens(F.col("title")))
    second = lambda x, i: F.transform(F.slice("t", i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))
    pairs = titles.select("times", F.explode(F.flatten(F.transform("t", second))).alias("p")).where("p.a <> p.b")
    return (
        pairs.groupBy("p.a", "p.b").agg(F.sum("times").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(top)
    )


def compare_counts(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Full outer comparison of two (key, n) tables; 100 per cent when there was nothing before."""
    both = first.withColumnRenamed("n", "n1").join(second.withColumnRenamed("n", "n2"), key, "full_outer")
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    change = F.when(n1 == 0, F.lit(100.0)).otherwise(F.round((n2 - n1) * 100.0 / n1, 2))
    return both.select(key, n1.alias("n1"), n2.alias("n2"), (n2 - n1).alias("change"), change.alias("change_pct"))


def activity(listing: DataFrame, hour: Column) -> DataFrame:
    """Rows, active days and the mean for each day, and the busiest hour."""
    by_hour = listing.groupBy("platform_id", hour.alias("hour")).agg(F.count("*").alias("n"))
    busiest = by_hour.groupBy("platform_id").agg(F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("busiest_hour"))
    totals = listing.groupBy("platform_id").agg(F.count("*").alias("n"), F.countDistinct("date").alias("active_days"))
    return totals.join(busiest, "platform_id").withColumn("per_day", F.round(F.col("n") / F.col("active_days"), 2))


def newest_of_url(items: DataFrame, url: str, day: str, *ties: str) -> DataFrame:
    """One row for each URL: that of the newest day."""
    order = Window.partitionBy(url).orderBy(F.desc(day), *ties)
    return items.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def with_new_flag(growing: DataFrame) -> DataFrame:
    """Growth of what had nothing before is no number: it is NULL, and ``is_new`` says so."""
    return growing.withColumn("is_new", F.col("before") == 0)


def active_dates(listing: DataFrame, topics: list[str], start: date, end: date) -> DataFrame:
    """First and last day with mentions of each topic, and how many days have any; a topic without mentions has none."""
    named = F.array(*(F.when(contains(F.col("title"), t), F.lit(t)) for t in topics))
    rows = listing.where(F.col("date").between(F.lit(start), F.lit(end))).select("date", F.explode(named).alias("topic"))
    days = rows.groupBy("topic").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("days"))
    wanted = listing.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, topics))).alias("topic"))
    return wanted.join(days, "topic", "left").withColumn("days", F.coalesce("days", F.lit(0)))


def merged_days(daily: DataFrame, key: list[str]) -> DataFrame:
    """Rank lists of several days (``date``, ``ranks``) as one, in the order of the days."""
    lists = F.array_sort(F.collect_list(F.struct("date", "ranks")))
    return daily.groupBy(*key).agg(F.flatten(F.transform(lists, lambda x: x["ranks"])).alias("ranks"), F.count("*").alias("days"))
