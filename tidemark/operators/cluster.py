"""Near-duplicate grouping of titles across platforms: greedy leaders in order of weight.

In that order a title joins the first leader it is similar enough to, or becomes a leader.
The result is the first maximal independent set of the similarity graph, found in rounds:
a title with no undecided or leading neighbour before it leads; a title beside an earlier
leader is a member.

Similar titles share characters, each as often as both have it, and by the threshold and a
title's length at least so many. So of the characters in order of rarity two titles share two
among their first ones; each such pair of characters is a key under which titles meet by
number. A key that many titles have is dealt over parts by its count. What meets is judged
by lengths and characters before the exact similarity is computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import hotness_of_group
from ..functions.text import bag_bound, jaccard, sequence_ratio
from ..session import checkpointed
from .ranking import numbered


#: Titles of one key that one task compares with all titles of that key.
DEALT = 1024


def _keys(rows: DataFrame, threshold: float) -> DataFrame:
    """(pos, n, key) of titles with ``tokens``: pairs of their rarest characters, and single ones where one shared character may do."""
    freq = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("f"))
    each = rows.select("pos", F.explode("tokens").alias("token")).join(freq, "token")
    ordered = each.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "token"))), lambda x: x["token"]).alias("t"))
    n = F.size("t")
    least = F.ceil(n * threshold / (2 - threshold) - 1e-9)  # characters that any similar title shares
    ordered = ordered.select("pos", n.alias("n"), least.alias("least"), F.slice("t", F.lit(1), n - F.greatest(least, F.lit(2)).cast("int") + 2).alias("t"))
    later = lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.xxhash64(x, y))
    pairs = F.flatten(F.transform("t", later))
    single = F.when(F.col("least") < 2, F.transform("t", lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))
    return ordered.select("pos", "n", F.explode(F.array_distinct(F.concat(pairs, single))).alias("key"))


def candidates(titles: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a before b, that share a key and are not too unlike in length; no pair of that similarity is missing."""
    # A character and which of its kind it is, so that shared ones are counted as often as both have them.
    letters = F.split("title", "")
    nth = lambda c, i: F.size(F.filter(F.slice(letters, F.lit(1), i), lambda x: x == c))
    rows = checkpointed(titles.select("pos", F.when(F.col("title") != "", F.transform(letters, lambda c, i: F.concat(c, nth(c, i).cast("string")))).alias("tokens")).where("tokens IS NOT NULL"))
    keyed = checkpointed(_keys(rows, threshold))
    shared = keyed.groupBy("key").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"), F.count("*").alias("times")).where("times > 1").drop("times")
    met = keyed.join(shared, "key")
    left = met.select("key", F.pmod("pos", "parts").cast("int").alias("part"), F.col("pos").alias("a"), F.col("n").alias("n_a"))
    right = met.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pos").alias("b"), F.col("n").alias("n_b"))
    near = (F.col("a") < F.col("b")) & (2 * F.least("n_a", "n_b") >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9)
    return left.join(right, ["key", "part"]).where(near).select("a", "b").distinct()


def similar_pairs(titles: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a before b: sets of characters overlap by half the threshold, and the sequence similarity reaches the threshold."""
    least = 0.5 * threshold
    told = titles.select("pos", "title", F.array_distinct(F.split("title", "")).alias("chars"))
    of = lambda side: told.select(F.col("pos").alias(side), F.col("title").alias(f"title_{side}"), F.col("chars").alias(f"chars_{side}"))
    rows = candidates(titles, threshold).join(of("a"), "a").join(of("b"), "b")
    near = rows.where(
        (F.size("chars_a") >= least * F.size("chars_b"))
        & (F.size("chars_b") >= least * F.size("chars_a"))
        & (jaccard(F.col("chars_a"), F.col("chars_b")) >= least)
        & (bag_bound(F.col("title_a"), F.col("title_b")) >= threshold - 1e-9)
    )
    return near.where(sequence_ratio("title_a", "title_b") >= threshold).select("a", "b")


def leaders(titles: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(pos, title, leader): ``titles`` has distinct titles in ``pos`` order of weight."""
    pairs = checkpointed(similar_pairs(titles, threshold))
    state = checkpointed(titles.select("pos", F.lit(0).alias("role")))  # 0 open, 1 leader, 2 member
    while not state.where("role = 0").isEmpty():
        earlier = pairs.join(state.select(F.col("pos").alias("a"), F.col("role").alias("role_a")), "a")
        around = earlier.groupBy(F.col("b").alias("pos")).agg(
            F.max((F.col("role_a") == 1).cast("int")).alias("beside"), F.max((F.col("role_a") == 0).cast("int")).alias("waiting")
        )
        role = (
            F.when(F.col("role") != 0, F.col("role"))
            .when(F.coalesce("beside", F.lit(0)) == 1, 2)
            .when(F.coalesce("waiting", F.lit(0)) == 0, 1)
            .otherwise(0)
        )
        state = checkpointed(state.join(around, "pos", "left").select("pos", role.alias("role")))
    lead = state.where("role = 1").select(F.col("pos").alias("a"))
    member = pairs.join(lead, "a", "left_semi").groupBy(F.col("b").alias("pos")).agg(F.min("a").alias("first"))
    found = titles.join(state, "pos").join(member, "pos", "left")
    return found.select("pos", "title", F.when(F.col("role") == 1, F.col("pos")).otherwise(F.col("first")).alias("leader"))


def aggregate_titles(listing: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row for each group: its leading title, members, platforms, days, rows, best rank, and the leader's
    hotness with half of each member's."""
    titles = listing.groupBy("title").agg(
        F.count("*").alias("n"), F.min("rank").alias("best_rank"), F.collect_set("platform_id").alias("platforms"), F.collect_set("date").alias("dates"),
        hotness_of_group("rank").alias("weight"),
    )
    ordered = checkpointed(numbered(titles, F.desc("n"), F.asc("title"), name="pos"))
    groups = leaders(ordered.select("pos", "title"), threshold).select("pos", "leader")
    rows = ordered.join(groups, "pos")
    return rows.groupBy("leader").agg(
        F.min_by("title", "pos").alias("title"),
        F.count("*").alias("members"),
        F.sum("n").alias("n"),
        F.min("best_rank").alias("best_rank"),
        F.size(F.array_distinct(F.flatten(F.collect_list("platforms")))).alias("n_platforms"),
        F.size(F.array_distinct(F.flatten(F.collect_list("dates")))).alias("n_dates"),
        F.round(F.min_by("weight", "pos") * 0.5 + F.sum("weight") * 0.5, 4).alias("weight"),
    )


def dedup_summary(groups: DataFrame) -> DataFrame:
    """One row: titles before and after grouping, the share that went, groups on several platforms and on one."""
    row = groups.agg(
        F.sum("members").alias("original"), F.count("*").alias("aggregated"),
        F.count_if(F.col("n_platforms") > 1).alias("multi_platform"), F.count_if(F.col("n_platforms") == 1).alias("single_platform"),
    )
    rate = F.coalesce(1 - F.try_divide(F.col("aggregated"), F.col("original")), F.lit(0.0))
    return row.withColumn("dedup_rate", F.round(rate, 4))
