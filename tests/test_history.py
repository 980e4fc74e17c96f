"""Timelines with gaps, report rows, periods, broken replies, cluster weights: golden cases and plain loops."""

from __future__ import annotations

from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import classify, cluster, history

DAY = date(2025, 11, 26)


def test_timeline_of_four_items(spark):
    """Batches 1 to 3: A in all, B in 1 only, C in 3 only, D in 1 and 3."""
    seen = {"A": (1, 2, 3), "B": (1,), "C": (3,), "D": (1, 3)}
    obs = spark.createDataFrame([(DAY, b, "p", i, k + 1) for k, (i, bs) in enumerate(seen.items()) for b in bs], "date date, batch int, platform_id string, item string, rank int")
    polls = lambda *failed: spark.createDataFrame([(DAY, b, "p", "failed" if b in failed else "success") for b in (1, 2, 3)], "date date, batch int, platform_id string, status string")
    gone = {(r["item"], r["batch"]) for r in history.off_list_rows(obs, polls()).collect()}
    assert gone == {("B", 2), ("D", 2)}
    lines = {r["item"]: [(x["batch"], x["rank"]) for x in r["timeline"]] for r in history.timeline(obs, polls()).collect()}
    assert lines == {"A": [(1, 1), (2, 1), (3, 1)], "B": [(1, 2)], "C": [(3, 3)], "D": [(1, 4), (2, None), (3, 4)]}
    only_a = obs.where("batch <> 2 OR item = 'none'")
    assert history.off_list_rows(only_a, polls(2)).count() == 0
    assert {(r["item"], r["batch"]) for r in history.off_list_rows(only_a, polls()).collect()} == {("A", 2), ("B", 2), ("D", 2)}
    assert [tuple(r) for r in history.failed_sources(polls(1, 3)).collect()] == [("p", 2, True)]
    assert history.timeline(obs.limit(0), polls()).count() == 0


def test_periods_and_guards(spark):
    assert dates.compare_period("last_week", DAY) == (date(2025, 11, 19), date(2025, 11, 25))
    assert dates.compare_period("this_week", DAY) == (date(2025, 11, 24), DAY)
    assert dates.compare_period("last_month", DAY) == (date(2025, 10, 27), date(2025, 11, 25))
    assert dates.compare_period({"start": "2025-01-02", "end": "2025-02-03"}, DAY) == (date(2025, 1, 2), date(2025, 2, 3))
    assert dates.compare_period("some day", DAY) is None
    assert dates.compare_period({"start": "x"}, DAY) is None
    assert dates.date_range("上周", DAY) == (date(2025, 11, 17), date(2025, 11, 23))
    assert dates.date_range("最近7天", DAY) == (date(2025, 11, 20), DAY)
    assert dates.date_range("3天前", DAY) == (date(2025, 11, 23),) * 2
    assert dates.checked_day(DAY, DAY) == DAY
    for bad in (date(2025, 11, 27), date(2024, 11, 25)):
        with pytest.raises(ValueError, match="2025-11-26"):
            dates.checked_day(bad, DAY)
    times = spark.createDataFrame([("2025-11-26 09:30:00",), ("09-30",), ("09:30",)], "t string")
    assert [r[0] for r in times.select(dates.clock(F.col("t"))).collect()] == ["09:30"] * 3


def test_broken_replies(spark):
    bodies = ["[{'id': 1, 'tag_id': 2, 'score': 0.5},]", 'Sure:\n[{"id": 1, "tag_id": 2, "score": 0.5}, {"id": 3, "ta', '```json\n[{"id": 1, "tag_id": 2, "score": 0.5}]\n```', "no list", "", None,
              '[{"id": 1, "tags": [{"tag_id": 2, "score": 0.5},],}, {"id": 4, "tags": [{"tag_id"']
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string")
    found = [tuple(r) for r in classify.reply_rows(rows).select("item_id", "tag_id", "score").collect()]
    assert found.count((1, 2, 0.5)) == 4
    assert set(found) - {(4, None, 0.5)} == {(1, 2, 0.5)}


def test_report_rows(spark):
    past = spark.createDataFrame([("p", "a", date(2025, 11, 1), DAY, 3), ("p", "b", DAY, DAY, 1), ("p", "c", date(2025, 9, 1), date(2025, 9, 2), 2)], "platform_id string, title string, first_date date, last_date date, times long")
    titles = spark.createDataFrame([(0, "p", "a", 5.0), (0, "p", "b", 9.0), (0, "p", "c", 7.0)], "position int, platform_id string, title string, weight double")
    rows = lambda **o: [(r["title"], r["place"], r["time_display"]) for r in history.report_rows(titles, past, F.lit(DAY), **o).orderBy("place").collect()]
    assert [t for t, _, _ in rows()] == ["b", "c", "a"]
    assert rows(mode="incremental") == [("b", 1, "[2025-11-26]")]
    assert rows(mode="current", cap=1) == [("b", 1, "[2025-11-26]")]
    assert rows(most_age=7)[1] == ("a", 2, "[2025-11-01 ~ 2025-11-26]")


def test_cluster_weights_equal_a_plain_loop(spark):
    titles = ["storm hits the coast", "storm hits the coasts", "storm hit the coast", "new bridge opens", "new bridge opened", "quiet day"]
    rows = [(date(2025, 11, 1 + k % 3), f"p{k % 2}", t, 1 + k) for k, t in enumerate(titles) for _ in range(6 - k)]
    listing = spark.createDataFrame(rows, "date date, platform_id string, title string, rank int")
    own: dict[str, list] = {}
    for d, p, t, r in rows:
        own.setdefault(t, []).append((d, p, r))
    weigh = lambda x: 0.6 * sum(11 - min(r, 10) for *_, r in x) / len(x) * 10 + 0.3 * min(len(x), 10) * 10 + 0.1 * sum(r <= 5 for *_, r in x) / len(x) * 100
    order, groups = sorted(own, key=lambda t: (-len(own[t]), t)), []
    for t in order:
        for g in groups:
            if SequenceMatcher(None, g[0], t).ratio() >= 0.7:
                g.append(t)
                break
        else:
            groups.append([t])
    want = {g[0]: (len(g), round(weigh(own[g[0]]) + 0.5 * sum(weigh(own[t]) for t in g[1:]), 4), len({d for t in g for d, *_ in own[t]})) for g in groups}
    found = {r["title"]: (r["members"], r["weight"], r["n_dates"]) for r in cluster.aggregate_titles(listing).collect()}
    assert found == want
    summary = cluster.dedup_summary(cluster.aggregate_titles(listing)).collect()[0]
    assert (summary["original"], summary["aggregated"]) == (6, len(groups))


def test_merged_sections_and_places(spark):
    left, right = (spark.createDataFrame(rows, "k string, v int") for rows in ([("a", 1), ("b", 2)], [("b", None), ("c", 3)]))
    assert {tuple(r) for r in history.merged(left, right, "k", "v").collect()} == {("a", 1), ("b", None), ("c", 3)}
    whole = history.sections(("x", left), ("y", right.withColumnRenamed("v", "w"))).orderBy("region_order", "k").collect()
    assert [(r["region"], r["k"], r["v"], r["w"]) for r in whole] == [("x", "a", 1, None), ("x", "b", 2, None), ("y", "b", None, None), ("y", "c", None, 3)]
    assert history.presented(left.withColumns({"url": F.lit("u"), "summary": F.lit("s")}), include_url=True).columns == ["k", "v", "url"]
