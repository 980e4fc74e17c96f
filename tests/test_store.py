"""Tables by day and changes of several tables."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.sources.days import DayStore, coverage


def rows_of(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=str)


def _rows(spark, days, note):
    return spark.createDataFrame([(date(2024, 1, d), p, i, note) for d in days for p in "ab" for i in range(3)], "date date, platform_id string, item int, note string")


def test_days_are_pruned_listed_and_rewritten(spark):
    first = _rows(spark, (1, 2, 4), "old")
    store = DayStore.create(spark, first.schema)
    store.write(first, files=2)
    some = store.read(date(2024, 1, 2), date(2024, 1, 3), platform_id=["a"])
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(platform_id), EqualTo(platform_id,a)]" in plan
    assert {(r["date"], r["platform_id"]) for r in some.collect()} == {(date(2024, 1, 2), "a")} and some.count() == 3
    files = {d: {f for f in store.read().inputFiles() if f"date=2024-01-0{d}" in f} for d in (1, 2, 4)}
    assert all(1 <= len(f) <= 2 for f in files.values())
    store.write(_rows(spark, (2, 5), "new").where("item < 2"))
    now = store.read().inputFiles()
    assert all(files[d] <= set(now) for d in (1, 4)) and not files[2] & set(now)
    assert {(r["date"].day, r["note"]): r["n"] for r in store.read().groupBy("date", "note").agg(F.count("*").alias("n")).collect()} == {
        (1, "old"): 6, (2, "new"): 4, (4, "old"): 6, (5, "new"): 4}
    assert [r["date"].day for r in store.days().orderBy("date").collect()] == [1, 2, 4, 5]
    assert "Scan parquet" not in store.days()._jdf.queryExecution().toString()
    assert tuple(store.status().first()) == (date(2024, 1, 1), date(2024, 1, 5), 4, 1)
    other = DayStore.create(spark, first.schema)
    assert tuple(other.status().first()) == (None, None, 0, 0)
    other.write(_rows(spark, (2, 7), "x"))
    assert {(r["date"].day, r["kind"]) for r in coverage(store, other).collect()} == {(1, "first"), (2, "both"), (4, "first"), (5, "first"), (7, "second")}
    store.drop_days(date(2024, 1, 4))
    assert [r["date"].day for r in store.days().orderBy("date").collect()] == [4, 5]
    store.forget()
    other.forget()


@pytest.fixture
def tables(spark, tmp_path):
    made = versions.VersionedTables(spark, f"file://{tmp_path}/tables")
    status = "status string, deprecated_at timestamp"
    made.commit(
        tags=spark.createDataFrame([(1, "active", None), (2, "active", None), (3, "deprecated", datetime(2023, 1, 1))], f"tag_id long, {status}"),
        results=spark.createDataFrame([(10, 1, "active", None), (10, 2, "active", None), (11, 2, "active", None), (12, 2, "deprecated", datetime(2023, 1, 1)), (13, 1, "active", None)], f"item_id long, tag_id long, {status}"),
        log=spark.createDataFrame([(i,) for i in (10, 11, 12, 13, 14)], "item_id long"),
    )
    return made


def _seen(tables):
    tags, results, log = tables.read("tags", "results", "log")
    return ({r["tag_id"]: r["status"] for r in tags.collect()}, sorted((r["item_id"], r["tag_id"], r["status"]) for r in results.collect()), sorted(r["item_id"] for r in log.collect()))


def test_a_cascade_is_seen_as_one(spark, tables, monkeypatch):
    before = _seen(tables)
    gone = spark.createDataFrame([(2,), (2,), (9,)], "tag_id long")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    # A writer that fails before its last table, and one that fails before the pointer: nothing is seen.
    tags, results, log = versions.deprecate_tags(*tables.read("tags", "results", "log"), gone, at)
    with pytest.raises(Exception, match="no such"):
        tables.commit(tags=tags, results=results, log=log.select(F.raise_error(F.lit("no such")).alias("item_id")))
    assert _seen(tables) == before
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            versions.VersionedTables(spark, tables.folder).commit(tags=tags)
    assert _seen(tables) == before
    held = tables.read("tags", "results", "log")  # a reader that began before the change
    assert versions.deprecate_in(tables, gone, at) == 2
    assert _seen(tables) == (
        {1: "active", 2: "deprecated", 3: "deprecated"},
        [(10, 1, "active"), (10, 2, "deprecated"), (11, 2, "deprecated"), (12, 2, "deprecated"), (13, 1, "active")],
        [10, 12, 13, 14],
    )
    assert held[2].count() == 5 and held[0].where("status = 'active'").count() == 2
    dates = {r["item_id"]: r["deprecated_at"] for r in tables.read("results")[0].where("tag_id = 2").collect()}
    assert dates == {10: datetime(2024, 1, 1), 11: datetime(2024, 1, 1), 12: datetime(2023, 1, 1)}


def test_other_tables_stay(spark, tables):
    tables.commit(log=spark.createDataFrame([(1,)], "item_id long"))
    tags, _, log = _seen(tables)
    assert len(tags) == 3 and log == [1] and tables.current()[0] == 2
