"""Search over titles: keyword, entity, fuzzy and related."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.score import hotness_of_group
from ..functions.text import bag_bound, contains, jaccard, sequence_ratio, word_tokens


def by_keyword(titles: DataFrame, query: str) -> DataFrame:
    return titles.where(contains(F.col("title"), query))


def by_entity(titles: DataFrame, entity: str) -> DataFrame:
    """Substring with letters as given."""
    return titles.where(F.col("title").contains(entity))


def title_or_summary(items: DataFrame, query: str) -> DataFrame:
    """Matches in the title or else the summary, and which of them it was."""
    in_title, in_summary = contains(F.col("title"), query), contains(F.coalesce("summary", F.lit("")), query)
    return items.where(in_title | in_summary).withColumn("match_in", F.when(in_title, "title").otherwise("summary"))


def fuzzy(titles: DataFrame, query: str, threshold: float = 0.6) -> DataFrame:
    """score 1 for a substring, else the similarity if it reaches the threshold, else the share of
    the query's words if that reaches a half. Only rows that need it reach the Python function."""
    q, low = F.lit(query.lower()), F.lower("title")
    contained = titles.where(contains(F.col("title"), query)).withColumn("score", F.lit(1.0))
    rest = titles.where(~contains(F.col("title"), query))
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(word_tokens(q), word_tokens(low))), F.size(word_tokens(q))), F.lit(0.0))
    rest = rest.withColumn("overlap", overlap).withColumn("bound", bag_bound(q, low) + 1e-9)
    near = rest.where(F.col("bound") >= threshold).withColumn("ratio", sequence_ratio(q, low))
    far = rest.where(F.col("bound") < threshold).withColumn("ratio", F.lit(0.0))
    judged = near.unionByName(far).withColumn("score", F.when(F.col("ratio") >= threshold, F.col("ratio")).when(F.col("overlap") >= 0.5, F.col("overlap")))
    return contained.unionByName(judged.where("score IS NOT NULL").drop("overlap", "bound", "ratio"))


def related(titles: DataFrame, reference: str, threshold: float = 0.4, text_weight: float = 0.3) -> DataFrame:
    """Blend of text similarity and keyword overlap with one reference title.

    With text similarity t <= its bound from shared characters, rows that can't reach the
    threshold never leave the JVM."""
    ref, low = F.lit(reference.lower()), F.lower("title")
    words = F.round(jaccard(word_tokens(ref), word_tokens(low)), 6)
    rows = titles.where(F.col("title") != reference).withColumn("words", words)
    rows = rows.where((1 - text_weight) * F.col("words") + text_weight * bag_bound(ref, low) >= threshold - 1e-9)
    score = (1 - text_weight) * F.col("words") + text_weight * sequence_ratio(ref, low)
    return rows.withColumn("score", score).where(F.col("score") >= threshold).drop("words")


def similarity_summary(found: DataFrame) -> DataFrame:
    """One row: how many related rows there are and their mean similarity, 0 if none."""
    return found.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("mean_similarity"))


#: What a search is ordered by before day, platform and title.
ORDERS = {"relevance": ("score",), "weight": ("weight",), "date": ()}


def unified(
    listing: DataFrame, query: str, *, mode: str = "keyword", sort_by: str = "relevance", start: date | None = None, end: date | None = None,
    platforms: list[str] | None = None, threshold: float = 0.6, limit: int = 50,
) -> DataFrame:
    """Titles of each day and platform that match, with score, rows, best rank and weight, best first.

    ``mode`` is keyword, fuzzy or entity. Without a ``start`` the newest day is searched. Titles repeat over days and
    platforms, so each different one is matched once."""
    if mode not in ("keyword", "fuzzy", "entity"):
        raise ValueError(f"no such mode: {mode!r}")
    if sort_by not in ORDERS:
        raise ValueError(f"no such order: {sort_by!r}")
    if start is None:
        newest = listing.agg(F.max("date").alias("date"))  # one row
        rows = listing.join(F.broadcast(newest), "date", "left_semi")
    else:
        rows = listing.where(F.col("date").between(F.lit(start), F.lit(end or start)))
    if platforms:
        rows = rows.where(F.col("platform_id").isin(platforms))
    titles = rows.select("title").distinct()
    if mode == "fuzzy":
        matched = fuzzy(titles, query, threshold)
    else:
        matched = (by_keyword if mode == "keyword" else by_entity)(titles, query).withColumn("score", F.lit(1.0))
    items = rows.groupBy("date", "platform_id", "title").agg(
        F.count("*").alias("n"), F.min("rank").alias("rank"), F.round(hotness_of_group("rank", 5), 4).alias("weight")
    )
    found = items.join(matched, "title").withColumn("score", F.round("score", 4))
    order = [F.desc(c) for c in ORDERS[sort_by]]
    return found.orderBy(*order, F.desc("date"), "platform_id", "title").limit(limit)
