"""Queries of the unified search, ranks over days, limits of feeds, payloads and snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import analytics as A
from ..operators import feeds, history, observe, search
from ..sources.observations import feed_items, listing, observations, polled, table
from .queries import DAY, END, GROUP_SQL, HOT, IN_DAYS, LISTING, OBS, RULES, START, _tokens, query
from .reports import EARLY, FEED
from .trends import POLLS

_ITEMS = LISTING + f", i AS (SELECT date, platform_id, title, count(*) AS n, min(rank) AS rank, round({HOT.format(5)}, 4) AS weight, 1.0::DOUBLE AS score FROM listing GROUP BY ALL)"


@query(_ITEMS + f" SELECT * FROM i WHERE {IN_DAYS} AND contains(title, 'bolt') ORDER BY weight DESC, date DESC, platform_id, title LIMIT 40")
def anl10_entity_by_weight(spark: SparkSession, sf: str) -> DataFrame:
    return search.unified(listing(spark, sf), "bolt", mode="entity", sort_by="weight", start=START, end=END, limit=40)


@query(_ITEMS + " SELECT * FROM i WHERE date = (SELECT max(date) FROM i) AND contains(lower(title), 'e') ORDER BY score DESC, date DESC, platform_id, title LIMIT 50")
def anl10_keyword_of_newest_day(spark: SparkSession, sf: str) -> DataFrame:
    return search.unified(listing(spark, sf), "E")


@query(_ITEMS + f" SELECT * FROM i WHERE {IN_DAYS} AND platform_id IN ('Brand#11', 'Brand#4', 'Brand#7') AND contains(lower(title), 'red') ORDER BY date DESC, platform_id, title LIMIT 30")
def anl10_keyword_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return search.unified(listing(spark, sf), "red", sort_by="date", start=START, end=END, platforms=["Brand#11", "Brand#4", "Brand#7"], limit=30)


@query()
def anl10_fuzzy_by_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return search.unified(listing(spark, sf), "hot bolts", mode="fuzzy", start=START, end=END, threshold=0.5)


@query(LISTING + """, w AS (SELECT DISTINCT title, list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 2) AS t FROM listing WHERE title <> 'hot bolt'),
  s AS (SELECT round(len(list_intersect(t, ['hot', 'bolt'])) / len(list_distinct(list_concat(t, ['hot', 'bolt']))), 6) AS score FROM w)
  SELECT count(*) AS n, round(coalesce(avg(score), 0), 4) AS mean_similarity FROM s WHERE score >= 0.3""")
def agg12_mean_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return search.similarity_summary(search.related(listing(spark, sf).select("title").distinct(), "hot bolt", threshold=0.3, text_weight=0.0))


@query(OBS + " SELECT platform_id, item, string_agg(rank, ',' ORDER BY date, batch) AS ranks, count(DISTINCT date) AS days FROM obs GROUP BY ALL")
def agg22_ranks_of_days(spark: SparkSession, sf: str) -> DataFrame:
    step = F.array_sort(F.collect_list(F.struct("batch", "rank")))
    daily = observations(spark, sf).groupBy(*observe.KEY).agg(F.transform(step, lambda x: x["rank"]).alias("ranks"))
    return A.merged_days(daily, ["platform_id", "item"]).withColumn("ranks", F.array_join("ranks", ","))


@query(LISTING + f""", t(topic) AS (VALUES ('red'), ('hot bolt'), ('large rod'), ('submarine'))
  SELECT topic, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS days FROM t LEFT JOIN listing ON contains(lower(title), topic) AND {IN_DAYS} GROUP BY 1""")
def win09_active_dates(spark: SparkSession, sf: str) -> DataFrame:
    return A.active_dates(listing(spark, sf), ["red", "hot bolt", "large rod", "submarine"], START, END)


@query(LISTING + f""", k AS (SELECT date, lang || ' ' || title AS keyword FROM (SELECT date, platform_id AS lang, title FROM listing)),
  b AS (SELECT keyword, count(*) FILTER (date = DATE '{DAY}') AS now, count(*) FILTER (date = DATE '{DAY}' - 1) AS before FROM k GROUP BY 1)
  SELECT keyword, now, before, CASE WHEN before > 0 THEN round(now / before, 4) END AS growth, before = 0 AS is_new FROM b WHERE now > 0""")
def mth06_growth_of_new(spark: SparkSession, sf: str) -> DataFrame:
    """Growth of each platform's titles against the day before, with a flag where there is nothing to grow from."""
    rows = listing(spark, sf).withColumn("keyword", F.concat_ws(" ", "platform_id", "title")).groupBy("keyword").agg(
        F.count_if(F.col("date") == F.lit(DAY)).alias("now"), F.count_if(F.col("date") == F.date_sub(F.lit(DAY), 1)).alias("before")
    )
    growth = F.round(F.try_divide(F.col("now").cast("double"), F.col("before")), 4).alias("growth")
    return A.with_new_flag(rows.where("now > 0").select("keyword", "now", "before", growth))


@query(FEED + """, own AS (SELECT p_brand AS feed_id, min(p_size) * 40 - 40 AS most_days FROM part WHERE p_brand NOT LIKE '%3' GROUP BY 1)
  SELECT feed_id, count(*) AS n FROM feed LEFT JOIN own USING (feed_id) WHERE coalesce(most_days, 90) <= 0 OR epoch_us(TIMESTAMP '1998-12-01') - epoch_us(published_at) <= coalesce(most_days, 90) * 86400000000 GROUP BY 1""")
def join18_limits_of_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Items that each feed's limit of days lets through; the limits are a table of their own."""
    own = table(spark, sf, "part").where("p_brand NOT LIKE '%3'").groupBy(F.col("p_brand").alias("feed_id")).agg((F.min("p_size") * 40 - 40).alias("most_days"))
    as_of = F.lit("1998-12-01 00:00:00").cast("timestamp")
    items = feed_items(spark, sf).withColumn("published_at", F.col("published_at").cast("timestamp"))
    return feeds.within_limits(items, own, as_of, 90).groupBy("feed_id").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT p_brand AS name, 'list' AS kind FROM part UNION SELECT event_type, 'poll' FROM events UNION SELECT source, 'text' FROM documents UNION SELECT p_brand, 'feed' FROM part WHERE p_size > 25)
  SELECT name, string_agg(kind, ',' ORDER BY kind) AS kinds FROM n GROUP BY 1""")
def set02_names_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return history.named_sources(
        ("list", part.select("p_brand")), ("poll", table(spark, sf, "events").select("event_type")), ("text", table(spark, sf, "documents").select("source")),
        ("feed", part.where("p_size > 25").select("p_brand")),
    )


_NEWEST = "(SELECT (date, batch) FROM b ORDER BY date DESC, batch DESC LIMIT 1)"


@query(POLLS + f""", r AS (SELECT platform_id AS source, 'item ' || item AS title, rank FROM seen WHERE (date, batch) = {_NEWEST}), f AS (SELECT platform_id FROM polls WHERE status = 'failed' AND (date, batch) = {_NEWEST})
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY rank, title)::INT AS nth, row_number() OVER (PARTITION BY source ORDER BY rank, title) || '. ' || title AS line FROM r
  UNION ALL SELECT DISTINCT source, 0, '# ' || source FROM r UNION ALL SELECT NULL, 0, '# failed' FROM (SELECT count(*) AS n FROM f) WHERE n > 0
  UNION ALL SELECT NULL, row_number() OVER (ORDER BY platform_id)::INT, platform_id FROM f""")
def snk09_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The newest batch as a text snapshot, with the sources that failed in it."""
    obs, polls = polled(spark, sf)
    newest = F.broadcast(polls.agg(F.max(F.struct("date", "batch")).alias("m")).select("m.date", "m.batch"))  # one row
    rows = obs.join(newest, ["date", "batch"], "left_semi").select(F.col("platform_id").alias("source"), F.concat(F.lit("item "), F.col("item").cast("string")).alias("title"), "rank")
    failed = polls.where("status = 'failed'").join(newest, ["date", "batch"], "left_semi").select(F.col("platform_id").alias("source"))
    return history.snapshot(rows, failed)


@query(LISTING + f""", t AS (SELECT platform_id, title, {GROUP_SQL} AS position FROM listing GROUP BY ALL), names(position, word) AS (VALUES (0, 'widget / red / blue'), (1, 'gears?'), (2, 'Fasteners / nut / rivet')),
  n AS (SELECT DISTINCT platform_id AS source, title FROM listing l WHERE date = DATE '{EARLY}' AND NOT EXISTS (SELECT 1 FROM listing o WHERE o.date < DATE '{EARLY}' AND o.platform_id = l.platform_id AND o.title = l.title)),
  a AS (SELECT source, {GROUP_SQL} AS p FROM n)
  SELECT 'group' AS part, word AS name, count(*) AS "count" FROM t JOIN names USING (position) GROUP BY ALL UNION ALL SELECT 'new', source, count(*) FROM a WHERE p IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'total_new', 'all', count(*) FROM a WHERE p IS NOT NULL""")
def prj06_report_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows, day = listing(spark, sf).select("date", F.col("platform_id").alias("source"), "title"), F.lit(EARLY)
    new = rows.where(F.col("date") == day).drop("date").distinct().join(rows.where(F.col("date") < day), ["source", "title"], "left_anti")
    return history.payload(A.keyword_stats(listing(spark, sf), RULES), new, RULES.accepts(F.col("title")))


@query(f"""WITH words AS (SELECT lang AS platform_id, unnest({_tokens("string_split(text, chr(10))[1]")}) AS keyword FROM documents), c AS (SELECT platform_id, keyword, count(*) AS n FROM words GROUP BY ALL),
  p AS (SELECT *, row_number() OVER (PARTITION BY platform_id ORDER BY n DESC, keyword) AS place FROM c), t AS (SELECT *, count(*) OVER (PARTITION BY keyword) AS k FROM p WHERE place <= 10),
  u AS (SELECT *, row_number() OVER (PARTITION BY platform_id ORDER BY place) AS nth FROM t WHERE k = 1) SELECT platform_id, keyword, n FROM u WHERE nth <= 5""")
def anl19_unique_topics_of_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Words of first lines that are among the top ten of one language only, five of each."""
    docs = table(spark, sf, "documents")
    return A.unique_topics(docs.select(F.col("lang").alias("platform_id"), F.substring_index("text", "\n", 1).alias("title")))


@query(f"""WITH n AS (SELECT o_orderkey % 20 AS n, o_orderkey % 7 AS w, o_orderkey % 6 AS kind FROM orders),
  d AS (SELECT CASE kind WHEN 0 THEN DATE '{DAY}' - n::INT WHEN 1 THEN DATE '{DAY}' - n::INT WHEN 2 THEN DATE '{DAY}' - (isodow(DATE '{DAY}') - 1 - w + 7)::INT
    WHEN 3 THEN DATE '{DAY}' - ((isodow(DATE '{DAY}') - 1 - w + 7) % 7)::INT WHEN 4 THEN make_date(CASE WHEN w + 1 > month(DATE '{DAY}') THEN 1997 ELSE 1998 END, w + 1, n + 1) END AS day FROM n)
  SELECT day, count(*) AS n FROM d GROUP BY 1""")
def dt06_spoken_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days said in words, made of the orders' numbers, as dates."""
    n, w = (F.col("o_orderkey") % 20).cast("string"), F.col("o_orderkey") % 7
    english = F.get(F.array(*map(F.lit, D.WEEKDAYS["en"])), w.cast("int"))
    kinds = [
        F.concat(n, F.lit(" days ago")), F.concat(n, F.lit("天前")), F.concat(F.lit(" Last "), english), F.concat(F.lit("本周"), F.substring(F.lit(D.WEEKDAYS["zh"]), w.cast("int") + 1, F.lit(1))),
        F.concat((w + 1).cast("string"), F.lit("月"), (F.col("o_orderkey") % 20 + 1).cast("string"), F.lit("日")), F.lit("some day"),
    ]
    said = F.get(F.array(*kinds), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, sf, "orders").select(D.spoken_day(said, F.lit(DAY)).alias("day")).groupBy("day").agg(F.count("*").alias("n"))
