"""Keyed state of a stream of polls against the batch operators, with late rows and restarts."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, observe
from tidemark.plans.store import _titled_polls
from tidemark.streaming import state
from tidemark.streaming.polls import run_available


def rows_of(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=str)


def _write(rows, folder, name):
    rows.coalesce(1).write.parquet(f"{folder}/{name}")


def _stream(spark, rows, folder):
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture(scope="module")
def polls(spark, sf):
    obs, asked = _titled_polls(spark, sf)
    few = F.col("date") <= "2024-01-04"
    return obs.where(few).cache(), asked.where(few).cache()


def test_replay_with_a_restart_equals_batch(spark, polls, tmp_path):
    obs, asked = polls
    rows = state.poll_rows(obs, asked).cache()
    src, out, checkpoint = tmp_path / "src", str(tmp_path / "log"), str(tmp_path / "c")
    # Each day's rows come in two files that cut across its batches, so a poll's rows arrive apart and out of order.
    days = [d for (d,) in rows.select("date").distinct().orderBy("date").collect()]
    for k, day in enumerate(days[:2]):
        for half in (1, 0):
            _write(rows.where((F.col("date") == F.lit(day)) & (F.pmod(F.xxhash64("item", "platform_id"), F.lit(2)) == half)), src, f"{k}-{1 - half}")
    stream = _stream(spark, rows, src)
    run_available(state.poll_events(stream, parts=3, delay="1 day"), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() > 0
    for k, day in enumerate(days[2:], 2):
        _write(rows.where(F.col("date") == F.lit(day)), src, f"{k}")
    end = spark.createDataFrame([(datetime(2024, 2, 1), datetime(2024, 2, 1).date(), "end", 0, None, None, None, "success")], rows.schema)
    _write(end, src, "end")
    run_available(state.poll_events(_stream(spark, rows, src), parts=3, delay="1 day"), out, checkpoint).awaitTermination()
    log = spark.read.parquet(out).where("platform_id <> 'end'").cache()
    assert rows_of(state.item_state(log).drop("last_title")) == rows_of(observe.item_state(obs))
    assert rows_of(state.title_log(log)) == rows_of(observe.title_changes(obs, observe.KEY, "title", "batch"))
    assert rows_of(state.off_list(log)) == rows_of(history.off_list_rows(obs, asked))
    assert rows_of(state.poll_log(log)) == rows_of(history.poll_log(obs, asked))


def test_polls_without_rows_and_late_rows(spark, tmp_path):
    at = lambda day, hour, minute=0: datetime(2024, 1, day, hour, minute)
    asked_schema, row_schema = "asked_at timestamp, platform_id string", "ts timestamp, platform_id string, item long"
    files = [
        ([(at(1, 6), "a"), (at(1, 6), "b")], [(at(1, 6, 5), "a", 1)]),
        ([(at(1, 12), "a")], [(at(1, 12, 1), "a", 2), (at(1, 6, 30), "b", 3)]),  # late, but within the delay
        ([(at(3, 0), "a")], [(at(3, 0), "a", 4)]),
        ([(at(3, 1), "a")], [(at(3, 1), "a", 9)]),  # rows are late by the watermark of the batch before
        ([(at(3, 6), "a")], [(at(1, 12, 30), "a", 5), (at(3, 6), "b", 6)]),  # two days late
        ([(at(9, 0), "z")], [(at(9, 0), "z", 7)]),
        ([(at(9, 1), "z")], [(at(9, 1), "z", 8)]),
    ]
    for k, (polls, rows) in enumerate(files):
        _write(spark.createDataFrame(polls, asked_schema), tmp_path / "polls", str(k))
        _write(spark.createDataFrame(rows, row_schema), tmp_path / "rows", str(k))
    polls = _stream(spark, spark.createDataFrame([], asked_schema), tmp_path / "polls")
    rows = _stream(spark, spark.createDataFrame([], row_schema), tmp_path / "rows")
    out = str(tmp_path / "out")
    run_available(state.polls_with_rows(polls, rows), out, str(tmp_path / "c")).awaitTermination()
    got = {(r["asked_at"], r["platform_id"], r["item"]) for r in spark.read.parquet(out).where("platform_id <> 'z'").collect()}
    assert got == {(at(1, 6), "a", 1), (at(1, 6), "b", 3), (at(1, 12), "a", 2), (at(3, 0), "a", 4), (at(3, 1), "a", 9), (at(3, 6), "a", None)}
