"""Queries over feeds, classifier replies and report texts, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import display as D
from ..operators import analytics as A
from ..operators import classify, cluster, feeds, ranking, search
from ..sources.observations import feed_items, listing, observations, table
from .queries import DAY, GROUP_SQL, IN_DAYS, LISTING, OBS, RULES, query

FEED = """WITH feed AS (SELECT l_shipdate::DATE AS date, p_brand AS feed_id, p_name AS title, CASE WHEN l_linenumber = 7 THEN '' ELSE 'https://feeds/' || l_partkey END AS url,
  l_shipdate + to_hours(l_orderkey % 24) AS published_at, p_type AS summary, l_orderkey AS item, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey)"""
LAST_WEEK = f"date BETWEEN DATE '{DAY}' - 6 AND DATE '{DAY}'"
EARLY = date(1995, 1, 10)  # a day with much that is new
KEY = ("item", "line")
TIES = (*KEY, "url", "title")  # order numbers and lines repeat


def _one_per_url(rows: str, order: str) -> str:
    return f"(SELECT * EXCLUDE nth FROM (SELECT *, CASE WHEN url = '' THEN 1 ELSE row_number() OVER (PARTITION BY url ORDER BY {order}) END AS nth FROM {rows}) WHERE nth = 1)"


_NEWEST = _one_per_url(f"(SELECT * FROM feed WHERE {LAST_WEEK})", "date DESC, item, line, url, title")


@query(FEED + f" SELECT date, feed_id, title, url, published_at, summary, item, line FROM {_NEWEST} ORDER BY published_at DESC, item, line, url, title LIMIT 50")
def anl09_latest_feed_items(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.latest(feed_items(spark, sf), DAY, 7, 50, *TIES)


@query(FEED + f""" SELECT date, feed_id, title, url, published_at, item, line, CASE WHEN contains(lower(title), 'large') THEN 'title' ELSE 'summary' END AS match_in
  FROM {_NEWEST} WHERE contains(lower(title), 'large') OR contains(lower(summary), 'large') ORDER BY published_at DESC, item, line, url, title LIMIT 50""")
def anl09_feed_search(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.search(feed_items(spark, sf), "Large", DAY, 7, 50, *TIES).drop("summary")


@query(FEED + f" SELECT feed_id, count(*) AS n, count(DISTINCT date) AS days, max(date) AS last_day, count(*) FILTER (date = DATE '{DAY}') AS today FROM feed GROUP BY 1")
def anl09_feed_status(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.status(feed_items(spark, sf), DAY)


_NEW = f"(SELECT * FROM feed f WHERE date = DATE '{EARLY}' AND url <> '' AND NOT EXISTS (SELECT 1 FROM feed o WHERE o.date < DATE '{EARLY}' AND o.feed_id = f.feed_id AND o.url = f.url))"


@query(FEED + f" SELECT feed_id, url, item, line FROM {_NEW}")
def join10_new_feed_items(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.new_items(feed_items(spark, sf), EARLY).select("feed_id", "url", *KEY)


@query(FEED + " SELECT feed_id, title, item, line FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC, item, line, url, title) AS nth FROM feed) WHERE nth <= 5")
def src06_head_of_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.head_of_feeds(feed_items(spark, sf), 5, F.desc("published_at"), *map(F.asc, TIES)).select("feed_id", "title", *KEY)


_RECENCY = """placed AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, item, line, url, title) AS place FROM feed),
  recent AS (SELECT * EXCLUDE place, CASE WHEN url = '' THEN 99 ELSE max(place) OVER (PARTITION BY url) END AS recency FROM placed)"""


@query(FEED + f", {_RECENCY} SELECT item, line, recency FROM recent")
def win01_recency(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.with_recency(feed_items(spark, sf), *TIES).select(*KEY, "recency")


_GROUPED = f"""{_RECENCY}, g AS (SELECT *, {GROUP_SQL} AS position, coalesce(url IN (SELECT url FROM {_NEW}), false) AS is_new
  FROM {_one_per_url("recent", "item, line, url, title")})"""
_NAMES = "(VALUES " + ", ".join(f"({i}, '{g.name}', {g.limit or 10})" for i, g in enumerate(RULES.groups)) + ") AS w(position, word, most)"


@query(FEED + f""", {_GROUPED} SELECT w.word, w.position, count(*) AS "count", count(*) FILTER (is_new) AS new_count, min(recency) AS best_recency,
  round(count(*) * 100.0 / (SELECT count(*) FROM feed), 2) AS percentage FROM g JOIN {_NAMES} ON g.position = w.position GROUP BY ALL""")
def anl03_feed_keyword_stats(spark: SparkSession, sf: str) -> DataFrame:
    items = feed_items(spark, sf)
    return feeds.keyword_stats(items, RULES, feeds.new_items(items, EARLY), *TIES)


@query(FEED + f""", {_GROUPED}, n AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY recency, item, line, url, title) AS nth FROM g WHERE position IS NOT NULL)
  SELECT n.position, n.nth, n.title, n.url, n.recency, n.is_new FROM n JOIN {_NAMES} ON n.position = w.position WHERE nth <= most""")
def anl03_feed_titles(spark: SparkSession, sf: str) -> DataFrame:
    items = feed_items(spark, sf)
    rows = feeds.stats_titles(items, RULES, feeds.new_items(items, EARLY), 10, *TIES)
    return rows.select("position", "nth", "title", "url", "recency", "is_new")


@query(FEED + f""" SELECT 'daily' AS mode, feed_id, count(*) AS n FROM feed WHERE date = DATE '{EARLY}' GROUP BY ALL UNION ALL SELECT 'incremental', feed_id, count(*) FROM {_NEW} GROUP BY ALL
  UNION ALL SELECT 'current', feed_id, count(*) FROM feed WHERE date = DATE '{EARLY}' AND date_trunc('hour', published_at) = (SELECT date_trunc('hour', max(published_at)) FROM feed WHERE date = DATE '{EARLY}') GROUP BY ALL""")
def anl28_feed_modes(spark: SparkSession, sf: str) -> DataFrame:
    items = feed_items(spark, sf)
    one, two, three = (
        feeds.by_mode(items, EARLY, m).groupBy("feed_id").agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "feed_id", "n")
        for m in ("daily", "current", "incremental")
    )
    return one.unionByName(two).unionByName(three)


# ---- search over both, shared limits


_WEIGHT = "round(0.6 * avg(11 - least(rank, 10)) * 10 + 0.3 * least(count(*), 10) * 10 + 0.1 * avg((rank <= 5)::INT) * 100, 4)"


@query(FEED + f""", listing AS (SELECT l_shipdate::DATE AS date, p_brand AS platform_id, p_name AS title, l_linenumber AS rank FROM lineitem JOIN part ON l_partkey = p_partkey),
  a AS (SELECT 'list' AS kind, platform_id AS source, title, {_WEIGHT} AS weight FROM listing WHERE {IN_DAYS} AND contains(lower(title), 'red') GROUP BY ALL ORDER BY weight DESC, source, title LIMIT 50),
  b AS (SELECT 'feed' AS kind, feed_id AS source, title, NULL::DOUBLE AS weight FROM {_NEWEST} WHERE contains(lower(title), 'red') OR contains(lower(summary), 'red')
    ORDER BY published_at DESC, item, line, url, title LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b""")
def anl10_unified_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.by_keyword(listing(spark, sf).where(F.expr(IN_DAYS)), "red").groupBy(F.lit("list").alias("kind"), F.col("platform_id").alias("source"), "title")
    hot = rows.agg(F.round(A.hotness_of_group("rank", 5), 4).alias("weight")).orderBy(F.desc("weight"), "source", "title").limit(50)
    found = feeds.search(feed_items(spark, sf), "red", DAY, 7, 20, *TIES)
    return hot.unionByName(found.select(F.lit("feed").alias("kind"), F.col("feed_id").alias("source"), "title", F.lit(None).cast("double").alias("weight")))


@query(FEED + f""", lists AS (SELECT 0 AS turn, p_name AS title, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate::DATE = DATE '{DAY}' GROUP BY ALL
  UNION ALL SELECT 1, title, count(*) FROM feed WHERE {LAST_WEEK} GROUP BY ALL) SELECT * FROM lists ORDER BY turn, n DESC, title LIMIT 150""")
def srt11_shared_budget(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*").alias("n")
    first = listing(spark, sf).where(F.col("date") == F.lit(DAY)).groupBy("title").agg(n)
    second = feeds.within_days(feed_items(spark, sf), DAY, 7).groupBy("title").agg(n)
    return ranking.shared_budget(first, second, [F.desc("n"), F.asc("title")], 150)


@query()
def anl12_similar(spark: SparkSession, sf: str) -> DataFrame:
    return search.related(listing(spark, sf).select("title").distinct(), "hot bolt", threshold=0.6, text_weight=1.0)


@query()
def anl12_related_everywhere(spark: SparkSession, sf: str) -> DataFrame:
    titles = listing(spark, sf).select("title").union(feed_items(spark, sf).select("title")).distinct()
    return search.related(titles, "hot bolt", threshold=0.5, text_weight=0.7)


@query()
def agg17_dedup_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.dedup_summary(cluster.aggregate_titles(listing(spark, sf)))


# ---- classifier replies


_TAGS = [(1, "plain"), (2, "good"), (3, "toxic")]
_SCORED = """WITH s AS (SELECT doc_id, quality + 1 AS tag_id, (doc_id % 13) / 10.0 AS score, 0 AS nth FROM labels
  UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 3 ELSE 9 END, CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE (doc_id % 11) / 10.0 END, 1 FROM labels)"""


def _replies(labels: DataFrame) -> DataFrame:
    """What a model might answer for each 50 documents: fenced, flat or nested, with scores out of range or left out."""
    entry = lambda tag, score: F.struct(tag.alias("tag_id"), score.alias("score"))
    first = entry(F.col("quality") + 1, (F.col("doc_id") % 13) / 10)
    second = entry(F.when(F.col("toxic") == 1, 3).otherwise(9), F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 11) / 10))
    rows = labels.select("doc_id", first.alias("x"), second.alias("y"), F.floor(F.col("doc_id") / 50).alias("batch"))
    flat = F.explode(F.array("x", "y")).alias("e")
    even = rows.where("batch % 2 = 0").select("batch", "doc_id", flat).select("batch", F.struct(F.col("doc_id").alias("id"), "e.tag_id", "e.score").alias("e"))
    odd = rows.where("batch % 2 <> 0").select("batch", F.struct(F.col("doc_id").alias("id"), F.array("x", "y").alias("tags")).alias("e"))
    body = lambda f: f.groupBy("batch").agg(F.to_json(F.collect_list("e")).alias("body"))
    return body(even).unionByName(body(odd)).select(F.concat(F.lit("Here it is:\n```json\n"), "body", F.lit("\n```\n")).alias("body"))


@query(_SCORED + """, k AS (SELECT doc_id, tag_id, least(1.0, score)::DOUBLE AS score, nth FROM s WHERE tag_id <= 3),
  p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, nth) AS place FROM k) SELECT doc_id AS item_id, tag_id::BIGINT AS tag_id, score FROM p WHERE place = 1""")
def jsn03_best_tags(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    tags = spark.createDataFrame(_TAGS, "tag_id bigint, tag string")  # a fixed table
    return classify.best_tags(_replies(labels), labels.select(F.col("doc_id").alias("item_id")), tags)


@query(_SCORED + """, k AS (SELECT doc_id, tag_id, least(1.0, score)::DOUBLE AS score, nth FROM s WHERE tag_id <= 3 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')),
  p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, nth) AS place FROM k)
  SELECT tag_id::BIGINT AS tag_id, count(*) AS n, round(avg(score), 4) AS mean FROM p WHERE place = 1 AND score >= 0.7 GROUP BY 1""")
def anl29_classified(spark: SparkSession, sf: str) -> DataFrame:
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    items = labels.withColumn("item_id", F.col("doc_id"))
    done = docs.where("lang = 'en'").select(F.col("doc_id").alias("item_id"))
    tags = spark.createDataFrame(_TAGS, "tag_id bigint, tag string")  # a fixed table
    found = classify.run(items, done, tags, lambda waiting, _: _replies(waiting), least=0.7)
    return found.groupBy("tag_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


@query("SELECT source, (nth - 1) // 200 AS batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents) GROUP BY ALL")
def arr09_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = classify.batches(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")
    return rows.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


# ---- report texts


@query(OBS + """, r AS (SELECT date, platform_id, item, list(rank ORDER BY batch) AS ranks, min(batch) AS f, max(batch) AS l, string_agg(rank || '(0' || batch || ':00)', '→' ORDER BY batch) AS trajectory FROM obs GROUP BY ALL),
  d AS (SELECT *, CASE WHEN list_min(ranks) = list_max(ranks) THEN '[' || list_min(ranks) || ']' ELSE '[' || list_min(ranks) || ' - ' || list_max(ranks) || ']' END AS body FROM r)
  SELECT date, platform_id, item, CASE WHEN list_min(ranks) <= 5 THEN '**' || body || '**' ELSE body END
    || CASE WHEN len(ranks) < 2 THEN '' WHEN ranks[-1] < ranks[-2] THEN ' 🔺' WHEN ranks[-1] > ranks[-2] THEN ' 🔻' ELSE ' ➖' END AS ranks_shown,
  CASE WHEN f = l THEN '0' || f || ':00' ELSE '[0' || f || ':00 ~ 0' || l || ':00]' END AS times_shown, trajectory FROM d""")
def str20_item_lines(spark: SparkSession, sf: str) -> DataFrame:
    step = F.struct("batch", F.format_string("%02d-00", "batch").alias("time"), "rank")
    rows = observations(spark, sf).groupBy("date", "platform_id", "item").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    at = lambda i: F.element_at("steps", i)["time"]
    return rows.select(
        "date", "platform_id", "item",
        D.rank_display(F.transform("steps", lambda s: s["rank"]), 5).alias("ranks_shown"),
        D.time_display(at(1), at(-1)).alias("times_shown"),
        D.timeline(F.col("steps")).alias("trajectory"),
    )


@query("SELECT event_type, printf('%.1f%%', count(*) * 100.0 / (SELECT count(*) FROM events)) AS share, strftime(min(ts) + INTERVAL 8 HOUR, '%m-%d %H:%M') AS first FROM events GROUP BY 1")
def mth05_shares_and_times(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("t")).crossJoin(e.agg(F.count("*").alias("total")))  # one row
    iso = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select("event_type", D.percent(F.col("n") * 100.0 / F.col("total")).alias("share"), D.friendly(iso, "Asia/Shanghai").alias("first"))


@query(LISTING + f""", t AS (SELECT platform_id, title, min(rank) AS rank FROM listing WHERE date = DATE '{DAY}' GROUP BY ALL)
  SELECT platform_id, row_number() OVER (PARTITION BY platform_id ORDER BY rank, title) AS nth, row_number() OVER (PARTITION BY platform_id ORDER BY rank, title) || '. ' || title AS line FROM t""")
def snk09_snapshot_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf).where(F.col("date") == F.lit(DAY)).groupBy("platform_id", "title").agg(F.min("rank").alias("rank"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("platform_id").orderBy("rank", "title")))
    return rows.select("platform_id", F.col("nth").cast("long").alias("nth"), F.concat(F.col("nth").cast("string"), F.lit(". "), "title").alias("line"))


@query(LISTING + f""", n AS (SELECT DISTINCT platform_id, title FROM listing l WHERE date = DATE '{EARLY}' AND NOT EXISTS (SELECT 1 FROM listing o WHERE o.date < DATE '{EARLY}' AND o.platform_id = l.platform_id AND o.title = l.title)),
  g AS (SELECT platform_id, {GROUP_SQL} AS p FROM n) SELECT platform_id, count(*) AS new_titles FROM g WHERE p IS NOT NULL GROUP BY 1""")
def prj06_new_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows, day = listing(spark, sf).select("date", "platform_id", "title"), F.lit(EARLY)
    new = rows.where(F.col("date") == day).drop("date").distinct()
    new = new.join(rows.where(F.col("date") < day), ["platform_id", "title"], "left_anti").where(RULES.accepts(F.col("title")))
    return new.groupBy("platform_id").agg(F.count("*").alias("new_titles"))


@query("""WITH RECURSIVE l AS (SELECT conv_id, concat_ws(': ', role, coalesce(text, '')) AS line, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS last
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
  f AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS open, NULL::VARCHAR AS message, 0 AS nth FROM l
    UNION ALL SELECT f.conv_id, l.i, CASE WHEN out THEN '' ELSE open END || line || chr(10), CASE WHEN out THEN open END, nth + out::INT
    FROM f JOIN l ON l.conv_id = f.conv_id AND l.i = f.i + 1, LATERAL (SELECT strlen(open) + strlen(line) + 1 > 400 AND regexp_matches(open, '\\S') AS out))
  SELECT conv_id, (nth - 1)::INT AS nth, message FROM f WHERE message IS NOT NULL
  UNION ALL SELECT f.conv_id, nth, open FROM f JOIN l ON l.conv_id = f.conv_id AND l.i = f.i AND l.i = l.last WHERE regexp_matches(open, '\\S')""")
def str18_packed_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each conversation as messages of up to 400 bytes."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))), lambda t: F.concat_ws(": ", t["role"], t["text"]))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("lines"))
    return rows.select("conv_id", F.posexplode(D.packed_lines(F.col("lines"), 400)).alias("nth", "message"))


@query()
def str09_numbered_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as a numbered series of messages of up to 300 bytes, taken apart between lines, each with the footer."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda t: F.concat(t["text"], F.lit("\n\n> end")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    return rows.select("conv_id", F.posexplode(D.numbered_messages(F.col("messages"), "slack", 300)).alias("nth", "message"))


_HEAD, _FOOT, _MOST = "Report\n\n", "\n\n> end", 300


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, role, 'Turns ' || (turn // 2 * 2) || '\n' AS heading, '- ' || trim(regexp_replace(left(coalesce(text, ''), 60), '\\s+', ' ', 'g')) || '\n' AS item,
    dense_rank() OVER (PARTITION BY conv_id ORDER BY role) AS s, dense_rank() OVER (PARTITION BY conv_id, role ORDER BY turn // 2) AS g, row_number() OVER (PARTITION BY conv_id, role, turn // 2 ORDER BY turn) AS j FROM conversations),
  u AS (SELECT DISTINCT conv_id, s, 0 AS g, 0 AS j, CASE WHEN s > 1 THEN '\n---\n' ELSE '' END || '# ' || role || '\n' AS say, '# ' || role || '\n' AS fresh FROM t
    UNION ALL SELECT DISTINCT conv_id, s, g, 0, '\n', NULL FROM t WHERE g > 1
    UNION ALL SELECT conv_id, s, g, j, CASE WHEN j = 1 THEN heading ELSE '' END || item, '# ' || role || '\n' || heading || item FROM t),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, g, j) AS i, count(*) OVER (PARTITION BY conv_id) AS last FROM u),
  f AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '{_HEAD}' AS open, false AS said, NULL::VARCHAR AS message, 0 AS nth FROM t
    UNION ALL SELECT f.conv_id, n.i, CASE WHEN fits THEN open || say WHEN fresh IS NULL THEN open ELSE '{_HEAD}' || fresh END, fits OR said OR fresh IS NOT NULL,
      CASE WHEN NOT fits AND fresh IS NOT NULL AND said THEN open || '{_FOOT}' END, CASE WHEN NOT fits AND fresh IS NOT NULL AND said THEN nth + 1 ELSE nth END
    FROM f JOIN n ON n.conv_id = f.conv_id AND n.i = f.i + 1, LATERAL (SELECT strlen(open) + strlen(say) + {len(_FOOT)} < {_MOST} AS fits))
  SELECT conv_id, (nth - 1)::INT AS nth, message FROM f WHERE message IS NOT NULL
  UNION ALL SELECT f.conv_id, nth, open || '{_FOOT}' FROM f JOIN n ON n.conv_id = f.conv_id AND n.i = f.i AND n.i = n.last""")
def str18_report_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as reports of a section for each role and a group for each two turns, in messages of fewer than 300 bytes."""
    item = F.trim(F.regexp_replace(F.left(F.coalesce("text", F.lit("")), F.lit(60)), r"\s+", " "))
    turns = table(spark, sf, "conversations").select("conv_id", "role", (F.floor(F.col("turn") / 2) * 2).alias("block"), F.struct("turn", F.concat(F.lit("- "), item, F.lit("\n")).alias("item")).alias("x"))
    groups = turns.groupBy("conv_id", "role", "block").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))
    group = F.struct("block", F.concat(F.lit("Turns "), F.col("block").cast("string"), F.lit("\n")).alias("heading"), "items")
    sections = groups.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(group)).alias("groups"))
    section = F.struct("role", F.concat(F.lit("# "), "role", F.lit("\n")).alias("header"), F.lit("\n---\n").alias("gap"), F.lit("\n").alias("between"), "groups")
    reports = sections.groupBy("conv_id").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    messages = D.report_messages(D.report_units(F.col("sections")), F.lit(_HEAD), F.lit(_FOOT), _MOST)
    return reports.select("conv_id", F.posexplode(messages).alias("nth", "message"))
