"""Grouping and search of titles against plain loops over all of them."""

from __future__ import annotations

import difflib
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import cluster, search


def _titles(dice: random.Random, n: int, alphabet: str) -> list[str]:
    out = {""}
    while len(out) < n:
        t = "".join(dice.choice(alphabet) for _ in range(dice.randint(1, 22)))
        out.add(t)
        for _ in range(dice.randint(0, 3)):
            t = "".join(c for c in t if dice.random() > 0.15) + dice.choice(("", "x", alphabet[:3]))
            out.add(t)
    return sorted(out, key=lambda _: dice.random())[:n]


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _similar(a: str, b: str, threshold: float) -> bool:
    x, y = set(a), set(b)
    if not x or not y or min(len(x), len(y)) / max(len(x), len(y)) < 0.5 * threshold or len(x & y) / len(x | y) < 0.5 * threshold:
        return False
    return _ratio(a, b) >= threshold


@pytest.mark.parametrize(("threshold", "alphabet"), [(0.7, "abcde 日本"), (0.7, "ab"), (0.4, "abcdefghijk"), (0.9, "日本語のテキスト東京大阪")])
def test_leaders_equal_the_greedy_loop(spark, threshold, alphabet, monkeypatch):
    monkeypatch.setattr(cluster, "DEALT", 7)
    titles = _titles(random.Random(len(alphabet)), 90, alphabet)
    want: dict[int, int] = {}
    for i, t in enumerate(titles):
        if i not in want:
            want[i] = i
            want |= {j: i for j in range(i + 1, len(titles)) if j not in want and _similar(t, titles[j], threshold)}
    frame = spark.createDataFrame(list(enumerate(titles)), "pos long, title string")
    assert {r["pos"]: r["leader"] for r in cluster.leaders(frame, threshold).collect()} == want


def test_few_pairs_of_unlike_titles_meet(spark, sf):
    def pairs(n):
        docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.substring_index("text", "\n", 1).alias("t")).where("length(t) > 30").distinct().orderBy("t").limit(n)
        rows = [(i, r["t"][:60]) for i, r in enumerate(docs.collect())]
        return len(rows), cluster.candidates(spark.createDataFrame(rows, "pos long, title string"), 0.7).count()

    n, met = pairs(100)
    assert met < 0.8 * n * (n - 1) / 2


def test_bounds_are_bounds(spark):
    dice = random.Random(8)
    rows = [(a, b) for a, b in zip(_titles(dice, 200, "abc é.*"), _titles(dice, 200, "abc é.$"), strict=True)]
    frame = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.bag_bound(F.col("a"), F.col("b")).alias("near"), T.ratio_bound(F.col("a"), F.col("b")).alias("far"))
    for a, b, near, far in frame.collect():
        assert _ratio(a, b) <= near + 1e-9 <= far + 2e-9


def _fuzzy(query: str, title: str, threshold: float) -> float | None:
    if query.lower() in title.lower():
        return 1.0
    ratio = difflib.SequenceMatcher(None, query.lower(), title.lower()).ratio()
    if ratio >= threshold:
        return ratio
    words = lambda t: {w for w in re.findall(r"\w+", t.lower()) if len(w) >= 2}
    share = len(words(query) & words(title)) / len(words(query)) if words(query) else 0.0
    return share if share >= 0.5 else None


@pytest.mark.parametrize("mode", ["keyword", "fuzzy", "entity"])
@pytest.mark.parametrize("sort_by", ["relevance", "weight", "date"])
def test_unified_search_equals_a_loop(spark, mode, sort_by):
    dice = random.Random(5)
    titles = _titles(dice, 40, "hot bl") + ["Hot bolt", "hot bolts and nuts", "a bolt", "bolt hot", "cold bolt hot", "HOT BOLT now"]
    rows = [(date(2024, 1, dice.randint(1, 4)), dice.choice("xyz"), dice.choice(titles), dice.randint(1, 12)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "date date, platform_id string, title string, rank int")
    found = search.unified(frame, "hot bolt", mode=mode, sort_by=sort_by, start=date(2024, 1, 1), end=date(2024, 1, 3), platforms=["x", "y"], threshold=0.55, limit=500).collect()
    groups: dict[tuple, list[int]] = {}
    for d, p, t, r in rows:
        if d <= date(2024, 1, 3) and p in "xy":
            groups.setdefault((d, p, t), []).append(r)
    want = {}
    for (d, p, t), ranks in groups.items():
        score = {"keyword": 1.0 if "hot bolt" in t.lower() else None, "entity": 1.0 if "hot bolt" in t else None, "fuzzy": _fuzzy("hot bolt", t, 0.55)}[mode]
        if score is not None:
            weight = 0.6 * sum(11 - min(r, 10) for r in ranks) / len(ranks) * 10 + 0.3 * min(len(ranks), 10) * 10 + 0.1 * sum(r <= 5 for r in ranks) / len(ranks) * 100
            want[d, p, t] = (round(score, 4), len(ranks), min(ranks), pytest.approx(weight, abs=1e-3))
    assert len(want) > 3
    assert {(r["date"], r["platform_id"], r["title"]): (r["score"], r["n"], r["rank"], r["weight"]) for r in found} == want
    key = {"relevance": lambda r: -r["score"], "weight": lambda r: -r["weight"], "date": lambda r: 0}[sort_by]
    order = [(key(r), -r["date"].toordinal(), r["platform_id"], r["title"]) for r in found]
    assert order == sorted(order)
    newest = search.unified(frame, "o", limit=500)
    assert {r["date"] for r in newest.collect()} == {date(2024, 1, 4)}
    with pytest.raises(ValueError):
        search.unified(frame, "o", mode="guess")
