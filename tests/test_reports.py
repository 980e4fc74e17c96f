"""Display expressions, reply parsing, packing and numbering against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import display as D
from tidemark.functions import text as T
from tidemark.operators import classify, feeds, ranking, search

TEXTS = ["", "plain", "日本語のテキスト", "line one\nline two\nline three", "é" * 40 + "\n" + "🔺" * 10, "🔺🔻➖", "��x�"]


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize("most", [0, 1, 2, 3, 7, 10, 17, 24, 500])
def test_cut_bytes(spark, most):
    want = [t.encode()[:most].decode(errors="ignore") for t in TEXTS]
    assert column(spark, TEXTS, lambda c: D.cut_bytes(c, most)) == want
    whole = [t if len(t.encode()) <= most else (w[: w.rfind("\n")] if w.rfind("\n") > 0 else w) for t, w in zip(TEXTS, want, strict=True)]
    assert column(spark, TEXTS, lambda c: D.cut_lines(c, most)) == whole


def _whole_lines(text, most):
    if len(text.encode()) <= most:
        return text
    rough = text.encode()[: max(most, 0)].decode(errors="ignore")
    return rough[: rough.rfind("\n")] if rough.rfind("\n") > 0 else rough


def _body_and_footer(text):
    for mark in ("\n\n\n> ", "\n\n> ", "\n\n<font", "\n\n_", "\n\n更新时间"):
        if (at := text.rfind(mark)) > 0:
            return text[:at], text[at:]
    return text, ""


def _footer_kept(text, most):
    body, footer = _body_and_footer(text)
    room = most - len(footer.encode())
    if len(text.encode()) <= most or not footer or room <= 0:
        return _whole_lines(text, most)
    return _whole_lines(body, room) + footer


def _pack(lines, most):
    done, now = [], ""
    for line in lines:
        if len((now + line + "\n").encode()) > most and now.strip():
            done.append(now)
            now = ""
        now += line + "\n"
    return done + [now] * bool(now.strip())


def _numbered(messages, mark, most):
    room, parts = most - len(f"{mark}[第 99/99 批次]{mark}\n\n".encode()), []
    for m in messages:
        body, footer = _body_and_footer(m)
        left = room - len(footer.encode())
        if len(m.encode()) <= room:
            parts.append(m)
        elif left <= 0:
            parts.append(_whole_lines(m, room))
        else:
            parts += [p + footer for p in _pack(body.split("\n"), left)] or [m]
    if len(messages) <= 1:
        return messages
    heads = [f"{mark}[第 {k}/{len(parts)} 批次]{mark}\n\n" for k in range(1, len(parts) + 1)]
    return parts if len(parts) <= 1 else [h + _footer_kept(p, most - len(h.encode())) for h, p in zip(heads, parts, strict=True)]


def _messages(dice):
    ends = ["", "\n\n> now", "\n\n\n> now", "\n\n_x_\n\n> y", "\n\n更新时间: 1", "\n\n> a\n\n> b"]
    lines = ["ab é🔺 "[: dice.randint(0, 6)] * dice.randint(0, 8) for _ in range(dice.randint(0, 9))]
    return "\n".join(lines) + dice.choice(ends)


@pytest.mark.parametrize("most", [0, 5, 12, 40, 90])
def test_cut_before_footer(spark, most):
    dice = random.Random(most)
    texts = [_messages(dice) for _ in range(80)] + TEXTS + ["\n\n> only"]
    assert column(spark, texts, lambda c: D.cut_before_footer(c, most)) == [_footer_kept(t, most) for t in texts]


@pytest.mark.parametrize(("channel", "mark"), [("slack", "*"), ("bark", ""), ("feishu", "**")])
def test_numbered_messages(spark, channel, mark):
    dice = random.Random(5)
    reports = [[_messages(dice) for _ in range(dice.randint(0, 4))] for _ in range(80)]
    got = column(spark, reports, lambda c: D.numbered_messages(c, channel, 60), "array<string>")
    assert got == [_numbered(r, mark, 60) for r in reports]


def test_packed_lines(spark):
    dice = random.Random(3)
    reports = [["ab é🔺"[: dice.randint(0, 5)] * dice.randint(0, 9) for _ in range(dice.randint(0, 12))] for _ in range(60)]

    def brute(lines, most):
        done, now = [], ""
        for line in lines:
            if len((now + line + "\n").encode()) > most and now.strip():
                done.append(now)
                now = line + "\n"
            else:
                now += line + "\n"
        return done + [now] * bool(now.strip())

    got = column(spark, reports, lambda c: D.packed_lines(c, 30), "array<string>")
    assert got == [brute(r, 30) for r in reports]


def test_numbered_reply(spark):
    replies = ["[1] one\n[2] two\nmore\n [3] three", "[2] b\n[1] a", "first\nsecond", "[1] only", "", "[x] no\n[1] yes [2] still"]
    assert column(spark, replies, lambda c: D.numbered_reply(c, F.lit(3))) == [
        ["one", "two\nmore", "three"], ["b", "a", ""], ["first", "second", ""], ["only", "", ""], ["", "", ""], ["no", "yes [2] still", ""]]
    assert column(spark, replies[1:2], lambda c: D.numbered_reply(c, F.lit(2))) == [["a", "b"]]


def test_ranks_times_and_versions(spark):
    ranks = [[], [3], [7], [2, 9], [9, 2], [8, 8], None]
    assert column(spark, ranks, lambda c: D.rank_display(c, 5), "array<int>") == ["", "**[3]**", "[7]", "**[2 - 9]** 🔻", "**[2 - 9]** 🔺", "[8] ➖", ""]
    assert column(spark, [[3]], lambda c: D.rank_display(c, 5, "telegram"), "array<int>") == ["<b>[3]</b>"]
    assert column(spark, ["09-30", "10:00", "2024-01-02 07:08:09", "soon"], D.clock) == ["09:30", "10:00", "07:08", "soon"]
    times = [("09-30", "09-30"), ("09-30", "10-00"), ("", "10-00"), ("09-30", "")]
    rows = spark.createDataFrame(times, "a string, b string").select(D.time_display(F.col("a"), F.col("b")).alias("t"))
    assert [r["t"] for r in rows.collect()] == ["09:30", "[09:30 ~ 10:00]", "", "09:30"]
    iso = ["2025-12-29T00:20:00", "2025-12-29T00:20:00Z", "2025-12-29T00:20:00+08:00", "2025-99-29T00:20:00", "never"]
    assert column(spark, iso, lambda c: D.friendly(c, "Asia/Shanghai")) == ["12-29 08:20", "12-29 08:20", "12-29 00:20", "99-29 00:20", "never"]
    assert column(spark, ["1.2.3", "1.10.0", "2.0", "x.1.2", "1.2.4"], lambda c: D.version_state(c, F.lit("1.2.4"))) == ["behind", "ahead", "behind", "behind", "same"]
    assert column(spark, [0.5, -12.25], lambda c: D.percent(c, True), "double") == ["+0.5%", "-12.3%"]
    steps = [[("09-30", 3), ("10-00", None)], []]
    assert column(spark, steps, D.timeline, "array<struct<time: string, rank: int>>") == ["3(09:30)→0(10:00)", "-"]


def test_replies(spark):
    bodies = ['```json\n[{"id": 1, "tag_id": 1, "score": 0.9}, {"id": 1, "tag_id": 2, "score": 7}, {"id": 8, "tag_id": 1}]\n```',
              'text ```[{"id": 2, "tags": [{"tag_id": 2}, {"tag_id": 1, "score": "high"}, {"tag_id": 5, "score": 1}]}, {"id": 3, "tags": []}]```',
              "no json", '{"id": 1}', None]
    replies = spark.createDataFrame([(b,) for b in bodies], "body string")
    items, tags = spark.createDataFrame([(1,), (2,), (3,)], "item_id bigint"), spark.createDataFrame([(1,), (2,)], "tag_id bigint")
    assert {tuple(r) for r in classify.best_tags(replies, items, tags).collect()} == {(1, 2, 1.0), (2, 2, 0.5)}
    assert classify.needs_all_again(0.6) and not classify.needs_all_again(0.59)


def test_numbering_equals_a_sort(spark):
    values = [(random.Random(i).randint(0, 5), i) for i in range(500)]
    rows = ranking.numbered(spark.createDataFrame(values, "a int, b int").repartition(7), F.desc("a"), F.asc("b"), name="n").collect()
    assert [(r["a"], r["b"]) for r in sorted(rows, key=lambda r: r["n"])] == sorted(values, key=lambda v: (-v[0], v[1]))
    assert sorted(r["n"] for r in rows) == list(range(1, 501))
    assert ranking.numbered(spark.createDataFrame([], "a int"), F.asc("a"), name="n").count() == 0


def test_feed_search_takes_the_newest_row_before_it_looks(spark):
    from datetime import date, datetime

    rows = [("f", "old oil", "u", date(2024, 1, 1)), ("f", "other", "u", date(2024, 1, 2)), ("f", "oil", "", date(2024, 1, 1)), ("g", "oil", "", date(2024, 1, 1))]
    items = spark.createDataFrame([(*r, datetime(2024, 1, r[3].day), None) for r in rows], "feed_id string, title string, url string, date date, published_at timestamp, summary string")
    found = feeds.search(items, "OIL", date(2024, 1, 2), 7, 10, "feed_id").collect()
    assert [(r["feed_id"], r["title"], r["match_in"]) for r in found] == [("f", "oil", "title"), ("g", "oil", "title")]
    assert {r["recency"] for r in feeds.with_recency(items, "feed_id", "title").where("url = ''").collect()} == {99}


def test_urls_and_tokens_as_documented(spark):
    urls = ["https://example.com/page?id=1&utm_source=x", "https://example.com/p#top", "https://example.com/p?b=2&a=1#top", "https://example.com/p?ref=x", "https://e.com/p?share_id=3&_=1&q="]
    assert column(spark, urls, T.normal_url) == ["https://example.com/page?id=1", "https://example.com/p#top", "https://example.com/p?a=1&b=2", "https://example.com/p", "https://e.com/p?q="]
    assert column(spark, ["https://s.weibo.com/weibo?q=test&band_rank=6&Refer=top"], lambda c: T.normal_url(c, "weibo")) == ["https://s.weibo.com/weibo?q=test"]
    assert column(spark, ["自己 The Cat, 没有 x 新闻 https://a.b/c"], T.tokens) == [["The", "Cat", "新闻"]]
    assert column(spark, ["[热] 《流浪》 AI2 官方 x 网友"], T.topic_tokens) == [["流浪", "AI2"]]


def test_similar_variants(spark):
    titles = spark.createDataFrame([("hot bolt",), ("hot bolts",), ("cold nut",)], "title string")
    assert [r["title"] for r in search.related(titles, "hot bolt", threshold=0.6, text_weight=1.0).collect()] == ["hot bolts"]
