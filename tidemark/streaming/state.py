"""Polls as a stream with keyed state: what every poll changed, told once, whatever order its rows arrive in.

Rows wait in the state until the watermark has passed their poll, then polls are applied in
order of time: items are new or seen again, a title that differs from the last one is told
with it, and an item of the poll before that a successful poll no longer has is told as off
the list, once. After a failed poll nothing is known. What is told is an append-only log;
``item_state`` and ``poll_log`` are aggregates of it and equal those of ``operators.observe``
and ``operators.history`` over the same rows.

State is kept by day, platform and part of the items, and is let go when the watermark has
passed the day by ``KEEP_DAYS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta, timezone
from datetime import datetime as moment

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.observe import KEY

KEEP_DAYS = 2
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG = (
    "kind string, date date, platform_id string, batch int, item long, rank int, title string, old_title string, "
    "first_batch int, crawl_count long, status string"
)
_LOG_NAMES = [part.split()[0] for part in LOG.split(", ")]


def poll_rows(obs: DataFrame, polls: DataFrame, hours: int = 6) -> DataFrame:
    """Observations (with title) and polls as rows of one stream: a poll's own row has a status and no item."""
    at = F.col("date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("batch") * hours)
    seen = obs.select(at.alias("ts"), "date", "platform_id", "batch", F.col("item").cast("long").alias("item"), F.col("rank").cast("int").alias("rank"), "title")
    asked = polls.select(at.alias("ts"), "date", "platform_id", "batch", "status")
    return seen.withColumn("status", F.lit(None).cast("string")).unionByName(asked, allowMissingColumns=True)


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Items over the parts; a poll's own row goes to each of them."""
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    return rows.withColumn("part", F.explode(F.when(F.col("status").isNull(), F.array(F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))).otherwise(every)))


class PollState(StatefulProcessor):
    """State of one day, platform and part."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, batch int, item long, rank int, title string, status string")
        self.items = handle.getMapState("items", "item long", "first_batch int, last_batch int, crawl_count long, title string")
        self.last_poll = handle.getValueState("last_poll", "batch int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            ms = (frame["ts"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[frame["ts"].dt.unit]).tolist()
            for at in sorted(set(ms)):
                self.handle.registerTimer(at)
            self.handle.registerTimer(_end_of_state(key[0]))
            none = lambda c: [None if pd.isna(x) else x for x in frame[c].tolist()]
            whole = lambda c: [None if x is None else int(x) for x in none(c)]
            self.waiting.appendList(list(zip(ms, whole("batch"), whole("item"), whole("rank"), none("title"), none("status"), strict=True)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        told: list[tuple] = []
        if self.waiting.exists():
            rows = list(self.waiting.get())
            later = [tuple(r) for r in rows if r[0] > due]
            self.waiting.put(later) if later else self.waiting.clear()
            ready = sorted((tuple(r) for r in rows if r[0] <= due), key=lambda r: r[0])
            at = 0
            while at < len(ready):
                to = at
                while to < len(ready) and ready[to][0] == ready[at][0]:
                    to += 1
                told += self._applied(ready[at:to])
                at = to
        if due >= _end_of_state(key[0]):
            self.waiting.clear()
            self.items.clear()
            self.last_poll.clear()
        if told:
            day, platform = key[0], key[1]
            frame = pd.DataFrame([(t[0], day, platform, *t[1:]) for t in told], columns=_LOG_NAMES)
            yield frame.astype({c: "Int64" for c in ("batch", "item", "rank", "first_batch", "crawl_count")})

    def _applied(self, rows: list[tuple]) -> list[tuple]:
        """What one poll changes: (kind, batch, item, rank, title, old_title, first_batch, crawl_count, status)."""
        batch = rows[0][1]
        status = next((r[5] for r in rows if r[5] is not None), "success")
        before = self.last_poll.get()[0] if self.last_poll.exists() else None
        self.last_poll.update((batch,))
        told: list[tuple] = [("poll", batch, None, None, None, None, None, None, status)]
        if status != "success":
            return told
        here = {r[2]: r for r in rows if r[5] is None}
        if before is not None:
            gone = [key[0] for key, value in self.items.iterator() if value[1] == before and key[0] not in here]
            told += [("off_list", batch, item, 0, None, None, None, None, None) for item in sorted(gone)]
        for item, (_, _, _, rank, title, _) in sorted(here.items()):
            if not self.items.containsKey((item,)):
                self.items.updateValue((item,), (batch, batch, 1, title))
                told.append(("new", batch, item, rank, title, None, batch, 1, None))
                continue
            first, _, count, old = self.items.getValue((item,))
            self.items.updateValue((item,), (first, batch, count + 1, title))
            told.append(("seen", batch, item, rank, title, None, first, count + 1, None))
            if old is not None and title is not None and old != title:
                told.append(("title", batch, item, rank, title, old, first, count + 1, None))
        return told

    def close(self) -> None:
        pass


def _end_of_state(day: date) -> int:
    return int(moment(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() + timedelta(days=KEEP_DAYS).total_seconds()) * 1000


def poll_events(stream: DataFrame, parts: int = 8, delay: str = "12 hours") -> DataFrame:
    """The log of a stream of ``poll_rows``. It sets the session's state store to RocksDB, which keyed state with timers needs."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = dealt(stream.withWatermark("ts", delay), parts)
    return rows.groupBy("date", "platform_id", "part").transformWithStateInPandas(PollState(), LOG, "Append", "EventTime")


# ---- the log as tables


def item_state(log: DataFrame) -> DataFrame:
    """First and last batch, number of sights, last rank and title of each item and day."""
    seen = log.where("kind IN ('new', 'seen')")
    return seen.groupBy(*KEY).agg(
        F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"), F.max("crawl_count").alias("crawl_count"),
        F.max_by("rank", "batch").alias("last_rank"), F.max_by("title", "batch").alias("last_title"),
    )


def title_log(log: DataFrame) -> DataFrame:
    return log.where("kind = 'title'").select(*KEY, "batch", "old_title", F.col("title").alias("new_title"))


def off_list(log: DataFrame) -> DataFrame:
    return log.where("kind = 'off_list'").select(*KEY, "batch", "rank")


def poll_log(log: DataFrame) -> DataFrame:
    """What each poll brought; every part has told its own share of it."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return log.groupBy("date", "platform_id", "batch").agg(
        F.max("status").alias("status"), (count("new") + count("seen")).alias("n"), count("new").alias("new"), count("seen").alias("updated"),
        count("title").alias("title_changed"), count("off_list").alias("off_list"),
    )


# ---- polls that brought nothing


def polls_with_rows(polls: DataFrame, rows: DataFrame, delay: str = "12 hours", within: str = "1 hour") -> DataFrame:
    """Stream-stream join: each poll (``asked_at``, platform_id) with the rows (``ts``, platform_id, ...) that came ``within`` it.

    A poll without rows is told, with NULLs, once the watermark says that none can come any more; rows that are later than that are dropped."""
    asked = polls.select(F.col("asked_at"), F.col("platform_id").alias("asked")).withWatermark("asked_at", delay)
    came = rows.withWatermark("ts", delay)
    met = (F.col("asked") == F.col("platform_id")) & (F.col("ts") >= F.col("asked_at")) & (F.col("ts") < F.col("asked_at") + F.expr(f"INTERVAL {within}"))
    return asked.join(came, met, "leftOuter").drop("platform_id").withColumnRenamed("asked", "platform_id")
