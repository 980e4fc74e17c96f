"""Polls with their outcome, timelines with gaps, and report rows made of an item's history.

``polls`` has one row for each platform that was asked in a batch: (date, batch, platform_id,
status), status ``success`` or ``failed``. An empty list that was read well is a success, so an
item that is not on it has left the list; after a failed poll nothing is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .observe import KEY


def off_list_rows(obs: DataFrame, polls: DataFrame) -> DataFrame:
    """Rank 0 for items that stood in the day's batch before and are missing from a successful poll."""
    batches = polls.select("date", "batch").distinct()
    follows = batches.withColumn("next", F.lead("batch").over(Window.partitionBy("date").orderBy("batch"))).where("next IS NOT NULL")
    read = polls.where("status = 'success'").select("date", "platform_id", F.col("batch").alias("next"))
    due = obs.select(*KEY, "batch").join(follows, ["date", "batch"]).join(read, ["date", "platform_id", "next"], "left_semi")
    gone = due.select(*KEY, F.col("next").alias("batch")).join(obs.select(*KEY, "batch"), [*KEY, "batch"], "left_anti")
    return gone.withColumn("rank", F.lit(0))


def poll_log(obs: DataFrame, polls: DataFrame) -> DataFrame:
    """What each poll brought: rows, new and known items of the day, changed titles (``title``) and items that left the list."""
    order = Window.partitionBy(*KEY).orderBy("batch")
    rows = obs.select(*KEY, "batch", "title", F.lag("title").over(order).alias("old"), F.row_number().over(order).alias("nth"))
    key = ["date", "platform_id", "batch"]
    brought = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if(F.col("nth") == 1).alias("new"), F.count_if(F.col("nth") > 1).alias("updated"),
        F.count_if(F.col("old") != F.col("title")).alias("title_changed"),
    )
    left = off_list_rows(obs, polls).groupBy(*key).agg(F.count("*").alias("off_list"))
    counts = ["n", "new", "updated", "title_changed", "off_list"]
    return polls.join(brought, key, "left").join(left, key, "left").select(*key, "status", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def timeline(obs: DataFrame, polls: DataFrame) -> DataFrame:
    """Each item's steps in time order, NULL where it was off the list; misses after its last sight are left out."""
    rows = obs.select(*KEY, "batch", "rank").unionByName(off_list_rows(obs, polls))
    last = obs.groupBy(*KEY).agg(F.max("batch").alias("last_batch"))
    rows = rows.join(last, KEY).where(~((F.col("rank") == 0) & (F.col("batch") > F.col("last_batch"))))
    step = F.struct("batch", F.when(F.col("rank") > 0, F.col("rank")).alias("rank"))
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(step)).alias("timeline"))


def failed_sources(polls: DataFrame) -> DataFrame:
    """Platforms with failed polls: how many, and whether the newest batch is one of them."""
    newest = polls.agg(F.max(F.struct("date", "batch")).alias("newest"))
    failed = polls.where("status = 'failed'").crossJoin(F.broadcast(newest))  # one row
    now = F.struct("date", "batch") == F.col("newest")
    return failed.groupBy("platform_id").agg(F.count("*").alias("failures"), F.max(now).alias("failed_now"))


def with_names(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The rows with ``name``: that of the names' table, or the key where there is none or it is empty."""
    return rows.join(names, key, "left").withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.col(key)))


def presented(rows: DataFrame, *, include_url: bool = False, include_summary: bool = False) -> DataFrame:
    """Only the columns that were asked for."""
    left_out = [c for c, wanted in (("url", include_url), ("summary", include_summary)) if not wanted]
    return rows.drop(*left_out)


def first_rank(ranks: Column, without: int = 0) -> Column:
    """The first of the ranks, or a number that stands for none."""
    return F.coalesce(F.get(ranks, F.lit(0)), F.lit(without))


def history(listing: DataFrame) -> DataFrame:
    """First and last day and number of rows of each title on a platform."""
    return listing.groupBy("platform_id", "title").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("times"))


def report_rows(titles: DataFrame, past: DataFrame, day: Column, *, mode: str = "daily", most_age: int = 0, cap: int = 0) -> DataFrame:
    """Titles of groups (position, platform_id, title, weight) as rows of a report, in order within their group.

    ``mode`` "current" keeps what the day's list still has, "incremental" what is new on that day.
    ``most_age`` (0: none) leaves out what was last seen more days ago; ``cap`` (0: none) limits each group.
    """
    rows = titles.join(past, ["platform_id", "title"], "left").withColumn("is_new", F.col("first_date") == day)
    if mode == "current":
        rows = rows.where(F.col("last_date") == day)
    elif mode == "incremental":
        rows = rows.where("is_new")
    if most_age:
        rows = rows.where(F.datediff(day, "last_date") <= most_age)
    span = F.when(F.col("first_date") == F.col("last_date"), F.concat(F.lit("["), F.col("first_date"), F.lit("]")))
    span = span.otherwise(F.concat(F.lit("["), F.col("first_date"), F.lit(" ~ "), F.col("last_date"), F.lit("]")))
    order = Window.partitionBy("position").orderBy(F.desc("weight"), "platform_id", "title")
    rows = rows.withColumn("time_display", span).withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= cap) if cap else rows


def merged(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Two tables of one value for each key as one; the right one wins."""
    both = left.select(key, F.col(value).alias("_left")).join(right.select(key, F.col(value).alias("_right"), F.lit(True).alias("_has")), key, "full_outer")
    return both.select(key, F.when(F.col("_has"), F.col("_right")).otherwise(F.col("_left")).alias(value))


def sections(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Regions of a report as one table, in their order; columns that a region lacks are NULL."""
    numbered = [frame.withColumns({"region": F.lit(name), "region_order": F.lit(i)}) for i, (name, frame) in enumerate(parts)]
    out = numbered[0]
    for frame in numbered[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def once(requests: DataFrame, ledger: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first request of each key that the ledger does not have."""
    first = requests.groupBy(*key).agg(F.min(order).alias(order))
    return first.join(ledger.select(*key), key, "left_anti")


def prioritised(rows: DataFrame, priority: str, *order: str) -> DataFrame:
    """Rows without a priority get one by their order, after the highest that is given. For lists of a person's making (tags)."""
    most = rows.agg(F.coalesce(F.max(priority), F.lit(0)).alias("most"))
    nth = F.row_number().over(Window.partitionBy(F.col(priority).isNull()).orderBy(*order))
    given = rows.crossJoin(F.broadcast(most))  # one row
    return given.withColumn(priority, F.coalesce(F.col(priority), F.col("most") + nth)).drop("most")


def placed(rows: DataFrame, most: int | None, *order: Column | str) -> DataFrame:
    """The first ``most`` rows in an order, with their place; None is for tables of a person's making (groups, tags), which are placed whole."""
    head = rows if most is None else rows.orderBy(*order).limit(most)
    return head.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def movers(changes: DataFrame, key: str, most: int) -> DataFrame:
    """Rising, falling and new keys of (key, n1, n2, change), each list with the places of its own."""
    lists = (
        ("rising", changes.where("change > 0"), [F.desc("change"), F.asc(key)]),
        ("falling", changes.where("change < 0"), [F.asc("change"), F.asc(key)]),
        ("new", changes.where("n1 = 0 AND n2 > 0"), [F.asc(key)]),
    )
    first, second, third = (placed(rows, most, *order).withColumn("list", F.lit(name)) for name, rows, order in lists)
    return first.unionByName(second).unionByName(third)


def sample_titles(titles: DataFrame, keywords: DataFrame, most: int = 5) -> DataFrame:
    """Titles with the highest sum of the counts of the keywords they hold; ``keywords`` is a short top list (keyword, n)."""
    known = keywords.agg(F.collect_list(F.struct("keyword", "n")).alias("k"))
    low = F.lower("title")
    score = F.aggregate("k", F.lit(0).cast("long"), lambda s, x: s + F.when(low.contains(F.lower(x["keyword"])), x["n"]).otherwise(0))
    scored = titles.crossJoin(F.broadcast(known)).withColumn("score", score)  # one row
    return scored.drop("k").orderBy(F.desc("score"), "title").limit(most)


def payload(stats: DataFrame, new_titles: DataFrame, accepted: Column) -> DataFrame:
    """A report's numbers: groups (word, count) that have any, new titles (source, title) that the rules accept by source, and
    how many those are together; (part, name, count)."""
    groups = stats.where("count > 0").select(F.lit("group").alias("part"), F.col("word").alias("name"), F.col("count").cast("long").alias("count"))
    new = new_titles.where(accepted)
    by_source = new.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("count")).select(F.lit("new").alias("part"), "name", "count")
    total = new.agg(F.lit("total_new").alias("part"), F.lit("all").alias("name"), F.count("*").alias("count"))
    return groups.unionByName(by_source).unionByName(total)


def snapshot(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Lines of a text snapshot: of each source (source, title, rank) its titles by rank under a heading, at last the sources that
    failed; (source, nth, line), nth 0 is the heading."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("rank", "title"))
    lines = rows.withColumn("nth", nth).select("source", "nth", F.concat(F.col("nth").cast("string"), F.lit(". "), "title").alias("line"))
    heads = rows.select("source").distinct().select("source", F.lit(0).alias("nth"), F.concat(F.lit("# "), "source").alias("line"))
    # One row for each source that failed, as many as a person configures.
    bad = failed.select("source").distinct()
    bad = bad.select(F.lit(None).cast("string").alias("source"), F.row_number().over(Window.orderBy("source")).alias("nth"), F.col("source").alias("line"))
    title = bad.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(None).cast("string").alias("source"), F.lit(0).alias("nth"), F.lit("# failed").alias("line"))
    return heads.unionByName(lines).unionByName(title).unionByName(bad)


def named_sources(*tables: tuple[str, DataFrame]) -> DataFrame:
    """Every name that any of the tables (kind, table of one column) has, once, with the kinds it is found in."""
    rows = [t.select(F.col(t.columns[0]).alias("name"), F.lit(kind).alias("kind")) for kind, t in tables]
    both = rows[0]
    for t in rows[1:]:
        both = both.unionByName(t)
    return both.where("name IS NOT NULL").distinct().groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"))


def overlapping(periods: DataFrame, key: list[str]) -> DataFrame:
    """(a, b) of periods (name, start, end) of one key that overlap, a before b by name."""
    a = periods.select(*key, F.col("name").alias("a"), F.col("start").alias("_sa"), F.col("end").alias("_ea"))
    b = periods.select(*key, F.col("name").alias("b"), F.col("start").alias("_sb"), F.col("end").alias("_eb"))
    return a.join(b, key).where((F.col("_sa") < F.col("_eb")) & (F.col("_sb") < F.col("_ea")) & (F.col("a") < F.col("b"))).select(*key, "a", "b")
