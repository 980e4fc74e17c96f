"""Replies of a classifier as rows: fenced JSON in two shapes, checked against items and tags, best tag for each item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered
from .store import best_per_key

REPLY = "ARRAY<STRUCT<id BIGINT, tag_id BIGINT, score STRING, tags ARRAY<STRUCT<tag_id BIGINT, score STRING>>>>"


def fenced(text: Column) -> Column:
    """The body of the first fenced block, else the text; trimmed."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)```", 1)
    return F.trim(F.regexp_replace(F.when(inner != "", inner).otherwise(text), r"^\s+|\s+$", ""))


def mended(text: Column) -> Column:
    """A list of objects that is not quite JSON: text around it goes, commas before a closing bracket go,
    single quotes around names and values become double ones, and a list that is cut off ends after its last whole object."""
    start = F.locate("[", text)
    body = F.when(start > 0, F.substring(text, start, F.length(text))).otherwise(text)
    body = F.regexp_replace(body, r"(?<=[\[{,:])(\s*)'([^'\"]*)'(?=\s*[,:}\]])", '$1"$2"')
    body = F.regexp_replace(body, r"(?s)^(.*[}\]])[^}\]]*$", "$1")
    body = F.when(body.endswith("]"), body).otherwise(F.concat(body, F.lit("]")))
    return F.regexp_replace(body, r",(\s*[}\]])", "$1")


def score(text: Column) -> Column:
    """In [0, 1]; 0.5 where there is none or it is no number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(text.try_cast("double"), F.lit(0.5))))


def reply_rows(replies: DataFrame, body: str = "body") -> DataFrame:
    """(item_id, at, tag_id, score): flat entries and those with a list of tags. What is no array, mended or not, gives no rows."""
    text = fenced(F.col(body))
    items = replies.select(F.posexplode(F.coalesce(F.from_json(text, REPLY), F.from_json(mended(text), REPLY))).alias("at", "e"))
    flat = F.array(F.struct(F.col("e.tag_id").alias("tag_id"), F.col("e.score").alias("score")))
    tags = F.when(F.col("e.tag_id").isNotNull(), flat).otherwise(F.col("e.tags"))
    rows = items.select(F.col("e.id").alias("item_id"), "at", F.posexplode(tags).alias("nth", "t"))
    return rows.select("item_id", "at", "nth", F.col("t.tag_id").alias("tag_id"), score(F.col("t.score")).alias("score"))


def best_tags(replies: DataFrame, items: DataFrame, tags: DataFrame, body: str = "body") -> DataFrame:
    """(item_id, tag_id, score): the best known tag of each known item; of equals, the one told first."""
    rows = reply_rows(replies, body).join(items.select("item_id"), "item_id", "left_semi").join(tags.select("tag_id"), "tag_id", "left_semi")
    return best_per_key(rows, "item_id", "score", "at", "nth").select("item_id", "tag_id", "score")


def batches(items: DataFrame, by: str, order: str, size: int = 200) -> DataFrame:
    """Number of the batch of ``size`` rows within each source; a large source is numbered by many tasks."""
    rows = numbered(items, F.asc(by), F.asc(order), name="_place")
    first = rows.groupBy(F.col(by).alias("_by")).agg(F.min("_place").alias("_first"))
    joined = rows.join(first, F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn("batch", F.floor((F.col("_place") - F.col("_first")) / size)).drop("_place", "_by", "_first")


def run(items: DataFrame, done: DataFrame, tags: DataFrame, classifier: Callable[[DataFrame, DataFrame], DataFrame], least: float = 0.0) -> DataFrame:
    """Classifies what is not done yet. ``classifier`` takes (pending items, tags) and returns replies with a ``body``."""
    waiting = items.join(done.select("item_id"), "item_id", "left_anti")
    found = best_tags(classifier(waiting, tags), waiting, tags)
    return found.where(F.col("score") >= least)


def needs_all_again(change_ratio: float, threshold: float = 0.6) -> bool:
    """Whether a change of the tags is so large that all items are classified anew."""
    return change_ratio >= threshold
