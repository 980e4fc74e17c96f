"""Scalar functions, rules, dates, sources, search, clusters and streams on small cases."""

import datetime as dt
import difflib
import html
import re
from datetime import date
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, text
from tidemark.functions.dates import date_range, in_period, spoken_day
from tidemark.functions.score import hotness
from tidemark.operators import cluster, observe, search, store
from tidemark.sources import feeds
from tidemark.streaming import polls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "source", "expected"),
    [
        ("https://s.weibo.com/weibo?q=test&band_rank=6&Refer=top", "weibo", "https://s.weibo.com/weibo?q=test"),
        ("https://example.com/page?id=1&utm_source=twitter", None, "https://example.com/page?id=1"),
        ("https://example.com/p#top", None, "https://example.com/p#top"),
        ("https://example.com/p?b=2&a=1#top", None, "https://example.com/p?a=1&b=2"),
        ("https://example.com/p?ref=x", None, "https://example.com/p"),
    ],
)
def test_normal_url(spark, url, source, expected):
    assert one(spark, text.normal_url(F.lit(url), source)) == expected


@pytest.mark.parametrize(("ranks", "expected"), [([], 0.0), ([1, 2, 3], 73.0), ([12], 9.0), ([0, 1], 79.0)])
def test_hotness(spark, ranks, expected):
    assert one(spark, hotness(F.array(*map(F.lit, ranks)).cast("array<int>"))) == pytest.approx(expected)


def test_rules(spark):
    r = rules.parse("apple\n/\\bpear\\b/\n\n+market\noil\n!advert\n\n[GLOBAL_FILTER]\nhoax")
    cases = [("Apple opens store", 0), ("PEAR harvest", 0), ("spearfishing", None), ("Oil prices", None), ("oil market apple", 0),
             ("apple advert", None), ("apple hoax", None), ("   ", None), (None, None)]
    found = spark.createDataFrame([(t,) for t, _ in cases], "title string").select("title", r.group_of(F.col("title")).alias("g")).collect()
    assert [(x.title, x.g) for x in found] == cases
    assert one(spark, rules.parse("").group_of(F.lit("anything"))) == -1


def test_dates():
    at = date(2025, 11, 26)
    assert date_range("this week", at) == (date(2025, 11, 24), at)
    assert date_range("last week", at) == (date(2025, 11, 17), date(2025, 11, 23))
    assert date_range("this month", at) == (date(2025, 11, 1), at)
    assert date_range("last month", at) == (date(2025, 10, 1), date(2025, 10, 31))
    assert date_range("last 7 days", at) == (date(2025, 11, 20), at)
    with pytest.raises(ValueError, match="not a date"):
        date_range("some day", at)


def test_period_wraps(spark):
    got = [one(spark, in_period(F.lit(t), "22:00", "07:00")) for t in ("22:00", "23:59", "06:59", "07:00", "12:00")]
    assert got == [True, True, True, False, False]


def test_new_and_off_list(spark):
    d = date(2025, 1, 1)
    rows = [(d, b, "p", i, 1) for b, items in ((1, "ABD"), (2, "A"), (3, "ACD")) for i in items]
    obs = spark.createDataFrame(rows, "date date, batch int, platform_id string, item string, rank int")
    assert [r["item"] for r in observe.new_items(obs).collect()] == ["C"]
    assert sorted((r["item"], r["missed_batch"]) for r in observe.off_list(obs).collect()) == [("B", 2), ("D", 2)]
    assert sorted((r["item"], r["start_batch"], r["end_batch"]) for r in observe.episodes(obs).collect()) == [
        ("A", 1, 3), ("B", 1, 1), ("C", 3, 3), ("D", 1, 1), ("D", 3, 3)]


def test_fuzzy_search(spark):
    titles = ["red widget", "Red Widgets here", "blue bolt", "rod wodget", ""]
    found = {r["title"]: r["score"] for r in search.fuzzy(spark.createDataFrame([(t,) for t in titles], "title string"), "red widget").collect()}
    assert found["red widget"] == found["Red Widgets here"] == 1.0
    assert found["rod wodget"] == pytest.approx(difflib.SequenceMatcher(None, "red widget", "rod wodget").ratio())
    assert "blue bolt" not in found


def test_leaders_equal_the_greedy_loop(spark):
    titles = [a + b for a in ("red ", "rod ", "blue ", "old ") for b in ("widget", "widgets", "wodget", "bolt", "bolts now", "ring")]
    leaders: list[int] = []
    want = {}
    for i, t in enumerate(titles):
        def near(j, t=t):
            a, b = set(titles[j]), set(t)
            return min(len(a), len(b)) >= 0.35 * max(len(a), len(b)) and len(a & b) / len(a | b) >= 0.35 and difflib.SequenceMatcher(None, titles[j], t).ratio() >= 0.7
        want[i] = next((j for j in leaders if near(j)), i)
        if want[i] == i:
            leaders.append(i)
    frame = spark.createDataFrame(list(enumerate(titles)), "pos int, title string")
    assert {r["pos"]: r["leader"] for r in cluster.leaders(frame, 0.7).collect()} == want


def test_feeds(spark):
    body = '{"status": "success", "items": [{"title": "A", "url": "u"}, {"title": " "}, {"title": "A", "url": "v"}, {"title": null}]}'
    rows = feeds.list_items(spark.createDataFrame([("s", body), ("t", '{"status": "error"}'), ("u", None)], "source_id string, body string")).collect()
    assert [(r["title"], r["ranks"], r["url"]) for r in rows] == [("A", [1, 3], "u")]
    body = '{"version": "https://jsonfeed.org/version/1.1", "items": [{"id": "i", "content_text": "c", "date_published": "2024-01-02T03:04:05Z"}]}'
    row = feeds.json_feed_items(spark.createDataFrame([("s", body)], "source_id string, body string")).first()
    assert (row["title"], row["url"], row["published_at"].year) == ("c", "i", 2024)
    rss = "<rss><channel><item><title>T</title><link>l</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>"
    row = feeds.rss_items(spark.createDataFrame([("s", rss)], "source_id string, body string")).first()
    assert (row["title"], row["url"], row["published_at"].day) == ("T", "l", 2)


def test_store(spark):
    t = spark.createDataFrame([(1, "a", "active"), (2, "b", "active")], "id int, v string, status string")
    new = spark.createDataFrame([(2, "x", "active"), (3, "c", "active")], "id int, v string, status string")
    as_set = lambda f: {tuple(r) for r in f.collect()}
    assert as_set(store.insert_ignore(t, new, ["id"])) == {(1, "a", "active"), (2, "b", "active"), (3, "c", "active")}
    assert as_set(store.insert_replace(t, new, ["id"])) == {(1, "a", "active"), (2, "x", "active"), (3, "c", "active")}
    assert as_set(store.soft_delete(t, new, ["id"])) == {(1, "a", "active"), (2, "b", "deprecated")}
    assert as_set(store.keyed_update(t, new, ["id"], "v")) == {(1, "a", "active"), (2, "x", "active")}
    assert as_set(store.delete_where(t, F.col("id") == 1)) == {(2, "b", "active")}


def test_stream_replay_equals_batch(spark, sf, tmp_path):
    src = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(4, "ts").write.parquet(str(src))
    stream = polls.event_stream(spark, str(src))
    polls.upsert_batches(stream, str(tmp_path / "parts"), str(tmp_path / "c1"), ["event_type", "user_id"]).awaitTermination()
    got = polls.merged(spark.read.parquet(str(tmp_path / "parts")), ["event_type", "user_id"]).select("event_type", "user_id", "times", "last_ts")
    want = spark.read.parquet(str(src)).groupBy("event_type", "user_id").agg(F.count("*").alias("times"), F.max("ts").alias("last_ts"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    polls.run_available(polls.tumbling(stream), str(tmp_path / "days"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "days")).count() > 0


def test_xml_feeds(spark):
    rss = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="x"><channel><title>C</title><item><title><![CDATA[A </item> & <b>b</b>]]></title><link>l1</link>
      <guid isPermaLink="false">g1</guid><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><dc:creator>Me</dc:creator><description>d &amp;amp; e</description></item>
      <item><title> </title><link>l0</link></item><item><title>T2</title><link>l2</link><dc:date>2024-01-02T03:04:05Z</dc:date></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title type="html">A1</title><link rel="self" href="u0"/><link rel="alternate" href="u1"/><id>i1</id>
      <updated>2024-01-02T03:04:05Z</updated><summary>s</summary><author><name>N</name></author><author><name>M</name></author></entry>
      <entry><title>A2</title><link href="u2"/><content type="html">&lt;p&gt;c&lt;/p&gt;</content></entry></feed>"""
    rows = [(1, rss), (2, atom), (3, "not xml"), (4, None), (5, "<rss><channel>"), (6, "")]
    got = feeds.rss_items(spark.createDataFrame(rows, "source_id int, body string")).orderBy("source_id", "title").collect()
    time = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert [(r["source_id"], r["title"], r["url"], r["summary"], r["author"], r["guid"]) for r in got] == [
        (1, "A & b", "l1", "d & e", "Me", "g1"), (1, "T2", "l2", None, None, "l2"), (2, "A1", "u1", "s", "N, M", "i1"), (2, "A2", "u2", "c", None, "u2"),
    ]
    assert [r["published_at"] for r in got] == [time, time, time, None]
    assert feeds.rss_items(spark.createDataFrame(rows, "source_id int, body string"), most=1).count() == 2


def test_numeric_references(spark):
    some = ["a &#65;&#x1F600; &#8212;", "&#0; &#xD800; &#99999999; &#x110000;", "&#233;&#233;", "none", "", None, "&#39;x&#X41;"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(some)], "i int, x string").select("i", text.references_decoded(F.col("x")).alias("x")).orderBy("i").select("x").collect()]
    assert got == ["a A😀 —", "\ufffd \ufffd \ufffd \ufffd", "éé", "none", "", None, "'xA"]


def test_character_references(spark):
    names = [f"&{n}" for n in html5] + [f"a&{n}b" for n in html5 if not n.endswith(";")]
    numbers = [f"&#{n};" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDCF, 0xFDD0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**7, 10**30]]
    numbers += ["&#x41;", "&#X1f600", "&#00065;", "&#x0000000000041;", "&#65x", "&#x;", "&#;", "&#xZ;", "&#65&#66;"]
    nested = ["a &#38;lt;b&gt; c", "&amp;amp;amp;", "&#38;#38;", "&amp;#65;", "&notit;", "&notin;", "&ampamp;", "&nope; &", "&&lt", "& lt;", "&lt&gt;", "x &AMP y", "&frac12x;", "", "&" * 5, "&verylongnamethatgoesonandonandonandon;"]
    texts = names + numbers + nested
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["d"] for r in rows.select("i", text.references_decoded(F.col("t")).alias("d")).orderBy("i").collect()]
    assert [(t, g) for t, g, w in zip(texts, got, map(html.unescape, texts), strict=True) if g != w] == []
    assert one(spark, text.plain_html(F.lit("a &#38;lt;b&gt; c<br>&eacute;&mdash;<i>x</i>"))) == "a &lt;b> cé—x"
    assert one(spark, text.references_decoded(F.lit(None).cast("string"))) is None


def test_plain_html_of_cut_references(spark):
    pages = ["<title>the&amp;&amp</title><p>x &quot y</p>", "<h1>a&am</h1>&copy;&middot", "&ampquot; <b>&amp;lt</b>&lt;i&gt;", "<p>a &amp</p>\n<p>&quo</p>"]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, t string")
    got = [r["d"] for r in rows.select("i", text.plain_html(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", html.unescape(p))).strip() for p in pages]


def _item(n, dc, content, rss=""):
    return f"""<{rss}item><{rss}title>T{n}</{rss}title><{rss}link>l{n}</{rss}link><{rss}description>d{n} &lt;b&gt;x&lt;/b&gt;</{rss}description>
      <{dc}:date>2024-01-0{n}T03:04:05Z</{dc}:date><{dc}:creator>N{n}</{dc}:creator><{content}:encoded>c</{content}:encoded></{rss}item>"""


def test_three_dialects_and_any_prefix_give_the_same_rows(spark):
    dc, content, rdf = "http://purl.org/dc/elements/1.1/", "http://purl.org/rss/1.0/modules/content/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    two = f"""<rss version="2.0" xmlns:dc="{dc}" xmlns:content="{content}" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>C</title><atom:link href="self" rel="self"/>
      {_item(1, "dc", "content")}{_item(2, "dc", "content")}</channel></rss>"""
    other = f"""<rss version="2.0" xmlns:a.b='{dc}' xmlns:c='{content}'><channel><title>C</title>{_item(1, "a.b", "c")}{_item(2, "a.b", "c")}</channel></rss>"""
    one_zero = f"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="{rdf}" xmlns="http://purl.org/rss/1.0/" xmlns:dc="{dc}" xmlns:content="{content}"><channel rdf:about="x"><title>C</title>
      <items><rdf:Seq><rdf:li resource="l1"/></rdf:Seq></items></channel>{_item(1, "dc", "content")}{_item(2, "dc", "content")}</rdf:RDF>"""
    prefixed = f"""<r:RDF xmlns:r="{rdf}" xmlns:rss="http://purl.org/rss/1.0/" xmlns:d="{dc}" xmlns:content="{content}"><rss:channel r:about="x"><rss:title>C</rss:title></rss:channel>
      {_item(1, "d", "content", "rss:")}{_item(2, "d", "content", "rss:")}</r:RDF>"""
    entry = lambda n: f"""<x:entry><x:title>T{n}</x:title><x:link href="l{n}"/><x:updated>2024-01-0{n}T03:04:05Z</x:updated><x:summary type="html">d{n} &lt;b&gt;x&lt;/b&gt;</x:summary>
      <x:author><x:name>N{n}</x:name></x:author></x:entry>"""  # noqa: E731
    atom = f"""<x:feed xmlns:x="http://www.w3.org/2005/Atom"><x:title>C</x:title>{entry(1)}{entry(2)}</x:feed>"""
    bodies = [two, other, one_zero, prefixed, atom]
    got = feeds.rss_items(spark.createDataFrame(list(enumerate(bodies)), "source_id int, body string")).orderBy("source_id", "title").collect()
    want = [(f"T{n}", f"l{n}", dt.datetime(2024, 1, n, 3, 4, 5), f"d{n} x", f"N{n}", f"l{n}") for n in (1, 2)]
    for k in range(len(bodies)):
        assert [(r["title"], r["url"], r["published_at"], r["summary"], r["author"], r["guid"]) for r in got if r["source_id"] == k] == want
    about = f"""<q:RDF xmlns:q="{rdf}" xmlns="http://purl.org/rss/1.0/"><item q:about="id9"><title>T</title><link>l</link></item></q:RDF>"""
    assert feeds.rss_items(spark.createDataFrame([(1, about)], "source_id int, body string")).first()["guid"] == "id9"


def test_feeds_that_cannot_be_read_are_told(spark):
    bodies = ["<rss><channel><item><title>x", "not xml", None, " ", "<html><body>moved</body></html>", "<rss><channel><title>none yet</title></channel></rss>", '<feed xmlns="http://www.w3.org/2005/Atom"/>', "<rss><channel><item><title>x</title></item></channel></rss>"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "source_id int, body string")
    assert {r["source_id"]: r["reason"] for r in feeds.failed_feeds(rows).collect()} == {0: "broken", 1: "broken", 2: "empty", 3: "empty", 4: "unknown"}


def test_spoken_days(spark):
    day = dt.date(2025, 10, 11)  # a Saturday
    ago = lambda n: day - dt.timedelta(n)
    golden = {
        "今天": ago(0), "昨天": ago(1), "前天": ago(2), "大前天": ago(3), "today": ago(0), " Yesterday ": ago(1), "3天前": ago(3), "3 天前": ago(3), "1 day ago": ago(1), "10 days ago": ago(10), "365天前": ago(365),
        "366天前": None, "999999999999999 days ago": None, "上周一": dt.date(2025, 9, 29), "上周天": dt.date(2025, 10, 5), "上周六": dt.date(2025, 10, 4), "本周三": dt.date(2025, 10, 8), "本周日": dt.date(2025, 10, 5),
        "last monday": dt.date(2025, 9, 29), "Last  Sunday": dt.date(2025, 10, 5), "this friday": dt.date(2025, 10, 10), "this sunday": dt.date(2025, 10, 5), "this saturday": day, "2025-10-10": ago(1), "2025-1-5": dt.date(2025, 1, 5),
        "2025-13-01": None, "2025-02-30": None, "10月10日": ago(1), "11月2日": dt.date(2024, 11, 2), "2023年2月3日": dt.date(2023, 2, 3), "2023年2月30日": None, "10/10": ago(1), "12/31": dt.date(2024, 12, 31), "2024/2/29": dt.date(2024, 2, 29),
        "13/1": None, "some day": None, "": None, None: None,
    }
    rows = spark.createDataFrame(list(enumerate(golden)), "i int, t string").select("i", spoken_day(F.col("t"), F.lit(day)).alias("d"))
    got = [r["d"] for r in rows.orderBy("i").collect()]
    assert [(t, g, w) for (t, w), g in zip(golden.items(), got, strict=True) if g != w] == []
