"""Queries over the outcome of polls, names, report rows, orders of lists and periods, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import analytics as A
from ..operators import classify, history
from ..sources.observations import listing, observations, polled, table
from .queries import DAY, GROUP_SQL, HOT, IN_DAYS, LISTING, OBS, RULES, TOKENS, query

_FAILED = "(batch + day(date) + length(platform_id)) % 5 = 0"
POLLS = OBS + f""", b AS (SELECT DISTINCT date, batch FROM obs), pf AS (SELECT DISTINCT platform_id FROM obs),
  polls AS (SELECT *, CASE WHEN {_FAILED} THEN 'failed' ELSE 'success' END AS status FROM b CROSS JOIN pf), seen AS (SELECT * FROM obs WHERE NOT {_FAILED})"""
_CHANGES = f""", k1 AS (SELECT keyword, count(*) AS n FROM words WHERE date BETWEEN DATE '1998-06-08' AND DATE '1998-06-14' GROUP BY 1),
  k2 AS (SELECT keyword, count(*) AS n FROM words WHERE date BETWEEN DATE '1998-06-15' AND DATE '{DAY}' GROUP BY 1),
  ch AS (SELECT keyword, coalesce(k1.n, 0) AS n1, coalesce(k2.n, 0) AS n2, coalesce(k2.n, 0) - coalesce(k1.n, 0) AS change FROM k1 FULL JOIN k2 USING (keyword))"""


# ---- polls and their outcome


@query(POLLS + """, nx AS (SELECT *, lead(batch) OVER (PARTITION BY date ORDER BY batch) AS nb FROM b),
  gone AS (SELECT o.date, o.platform_id, o.item, nx.nb AS batch, 0 AS rank FROM seen o JOIN nx ON nx.date = o.date AND nx.batch = o.batch
    JOIN polls p ON p.date = o.date AND p.platform_id = o.platform_id AND p.batch = nx.nb AND p.status = 'success'
    WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.date = o.date AND x.platform_id = o.platform_id AND x.item = o.item AND x.batch = nx.nb)),
  steps AS (SELECT date, platform_id, item, batch, rank FROM seen UNION ALL SELECT * FROM gone),
  lb AS (SELECT date, platform_id, item, max(batch) AS lb FROM seen GROUP BY ALL)
  SELECT date, platform_id, item, string_agg(batch || ':' || CASE WHEN rank > 0 THEN rank::VARCHAR ELSE '-' END, ',' ORDER BY batch) AS timeline
  FROM steps JOIN lb USING (date, platform_id, item) WHERE NOT (rank = 0 AND batch > lb) GROUP BY ALL""")
def win12_timeline_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    obs, polls = polled(spark, sf)
    step = lambda x: F.concat(x["batch"].cast("string"), F.lit(":"), F.coalesce(x["rank"].cast("string"), F.lit("-")))
    return history.timeline(obs, polls).select("date", "platform_id", "item", F.array_join(F.transform("timeline", step), ",").alias("timeline"))


@query(POLLS + """ SELECT platform_id, count(*) AS failures, bool_or((date, batch) = (SELECT (date, batch) FROM b ORDER BY date DESC, batch DESC LIMIT 1)) AS failed_now
  FROM polls WHERE status = 'failed' GROUP BY 1""")
def stm11_failed_sources(spark: SparkSession, sf: str) -> DataFrame:
    return history.failed_sources(polled(spark, sf)[1])


@query(OBS + " SELECT platform_id, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT date, batch FROM obs)) * (SELECT count(DISTINCT platform_id) FROM obs) AS updates, round(avg(rank), 4) AS mean_rank, round((SELECT avg(rank) FROM obs), 4) AS mean_of_all FROM obs GROUP BY 1")
def agg10_mean_ranks_and_updates(spark: SparkSession, sf: str) -> DataFrame:
    obs = observations(spark, sf)
    whole = obs.agg(F.round(F.avg("rank"), 4).alias("mean_of_all"), (F.countDistinct("date", "batch") * F.countDistinct("platform_id")).alias("updates"))
    own = obs.groupBy("platform_id").agg(F.count("*").alias("n"), F.round(F.avg("rank"), 4).alias("mean_rank"))
    return own.crossJoin(whole)  # one row


@query("""WITH r AS (SELECT event_type, (ts::DATE)::VARCHAR AS day, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS period, event_id FROM events)
  SELECT event_type, day, period, min(event_id) AS event_id FROM r WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = 1 AND d.event_type = r.event_type
    AND (d.ts::DATE)::VARCHAR = r.day AND CASE WHEN hour(d.ts) < 12 THEN 'am' ELSE 'pm' END = r.period) GROUP BY ALL""")
def stm08_once_per_period(spark: SparkSession, sf: str) -> DataFrame:
    key = ["event_type", "day", "period"]
    e = table(spark, sf, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), F.when(F.hour("ts") < 12, "am").otherwise("pm").alias("period"), "event_id", "user_id")
    return history.once(e, e.where("user_id = 1").select(*key).distinct(), key, "event_id")


# ---- names and rows of a report


@query(LISTING + """, names AS (SELECT DISTINCT p_brand AS platform_id, CASE WHEN p_brand LIKE '%1' THEN '' ELSE 'Shop ' || right(p_brand, 2) END AS name FROM part WHERE p_brand NOT LIKE '%5')
  SELECT l.platform_id, coalesce(nullif(n.name, ''), l.platform_id) AS name, count(*) AS n, coalesce(min(rank), 0) AS best_rank FROM listing l LEFT JOIN names n USING (platform_id) GROUP BY ALL""")
def join02_names_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.col("p_brand")
    name = F.when(brand.endswith("1"), "").otherwise(F.concat(F.lit("Shop "), F.right(brand, F.lit(2))))
    names = table(spark, sf, "part").where(~brand.endswith("5")).select(brand.alias("platform_id"), name.alias("name")).distinct()
    rows = listing(spark, sf).groupBy("platform_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("rank")).alias("ranks"))
    return history.with_names(rows, names, "platform_id").select("platform_id", "name", "n", history.first_rank(F.col("ranks")).alias("best_rank"))


@query("""SELECT l.doc_id, t.tag, d.lang FROM labels l JOIN (VALUES (0, 'low'), (1, 'high')) t(quality, tag) USING (quality) JOIN documents d USING (doc_id) WHERE d.lang <> 'en'""")
def join07_results_of_items(spark: SparkSession, sf: str) -> DataFrame:
    tags = spark.createDataFrame([(0, "low"), (1, "high")], "quality int, tag string")
    items = table(spark, sf, "documents").where("lang <> 'en'").select("doc_id", "lang")
    return table(spark, sf, "labels").join(F.broadcast(tags), "quality").join(items, "doc_id").select("doc_id", "tag", "lang")  # two tags


_REPORT = LISTING + f""", t AS (SELECT platform_id, title, round({HOT.format(3)}, 4) AS weight, min(date) AS first_date, max(date) AS last_date, count(*) AS times, {GROUP_SQL} AS position FROM listing GROUP BY ALL),
  r AS (SELECT *, first_date = DATE '{DAY}' AS is_new, CASE WHEN first_date = last_date THEN '[' || first_date || ']' ELSE '[' || first_date || ' ~ ' || last_date || ']' END AS time_display FROM t WHERE position IS NOT NULL)"""


@query(_REPORT + f", p AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY weight DESC, platform_id, title)::INT AS place FROM r WHERE DATE '{DAY}' - last_date <= 60) SELECT * FROM p WHERE place <= 4")
def prj05_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf)
    titles = rows.groupBy("platform_id", "title").agg(F.round(A.hotness_of_group("rank", 3), 4).alias("weight"))
    titles = titles.withColumn("position", RULES.group_of(F.col("title"))).where("position >= 0")
    return history.report_rows(titles, history.history(rows), F.lit(DAY), most_age=60, cap=4)


@query(LISTING + f""", h AS (SELECT platform_id, title, min(date) AS first_date, max(date) AS last_date, count(*) AS times FROM listing GROUP BY ALL)
  SELECT platform_id, title, rank, first_date, last_date, times FROM listing JOIN h USING (platform_id, title) WHERE date = DATE '{DAY}'""")
def join13_history_of_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf)
    today = rows.where(F.col("date") == F.lit(DAY)).drop("date")
    return today.join(history.history(rows), ["platform_id", "title"], "left").select("platform_id", "title", "rank", "first_date", "last_date", "times")


@query("SELECT event_type, max(event_id) AS version, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1")
def agg14_versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.max("event_id").alias("version"), F.count("*").alias("n"), F.max("ts").alias("newest"))


@query("""WITH t AS (SELECT n_name AS tag, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 1 END AS priority FROM nation)
  SELECT tag, coalesce(priority, (SELECT max(priority) FROM t) + row_number() OVER (PARTITION BY priority IS NULL ORDER BY tag))::INT AS priority FROM t""")
def win14_priorities(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "nation").select(F.col("n_name").alias("tag"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") + 1).alias("priority"))
    return history.prioritised(tags, "priority", "tag").select("tag", F.col("priority").cast("int").alias("priority"))


@query("""WITH l AS (SELECT p_brand AS k, count(*) AS v FROM part WHERE p_size < 25 GROUP BY 1), r AS (SELECT p_brand AS k, -count(*) AS v FROM part WHERE p_retailprice > 1500 AND p_brand NOT LIKE '%2' GROUP BY 1)
  SELECT k, CASE WHEN r.k IS NOT NULL THEN r.v ELSE l.v END AS v FROM l FULL JOIN r USING (k)""")
def set05_merged_maps(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumnRenamed("p_brand", "k")
    left = part.where("p_size < 25").groupBy("k").agg(F.count("*").alias("v"))
    right = part.where("p_retailprice > 1500 AND k NOT LIKE '%2'").groupBy("k").agg((-F.count("*")).alias("v"))
    return history.merged(left, right, "k", "v")


@query(f"""SELECT 'lists' AS region, 0 AS region_order, p_brand AS source, count(*) AS n, NULL::BIGINT AS chars FROM part GROUP BY ALL UNION ALL
  SELECT 'feeds', 1, event_type, count(*), NULL FROM events GROUP BY ALL UNION ALL SELECT 'texts', 2, lang, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY ALL""")
def set06_report_sections(spark: SparkSession, sf: str) -> DataFrame:
    count = F.count("*").alias("n")
    lists = table(spark, sf, "part").groupBy(F.col("p_brand").alias("source")).agg(count)
    found = table(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(count)
    texts = table(spark, sf, "documents").groupBy(F.col("lang").alias("source")).agg(count, F.sum("n_chars").alias("chars"))
    return history.sections(("lists", lists), ("feeds", found), ("texts", texts))


# ---- orders of lists


@query(LISTING + f""", t AS (SELECT platform_id, title, {GROUP_SQL} AS position FROM listing GROUP BY ALL), g AS (SELECT position, count(*) AS count FROM t WHERE position IS NOT NULL GROUP BY 1),
  n AS (SELECT position, coalesce(count, 0) AS count FROM (VALUES (0), (1), (2)) v(position) LEFT JOIN g USING (position))
  SELECT position, count, row_number() OVER (ORDER BY count DESC, position)::INT AS place_by_count, row_number() OVER (ORDER BY position, count DESC)::INT AS place_by_position FROM n""")
def srt02_group_orders(spark: SparkSession, sf: str) -> DataFrame:
    groups = A.keyword_stats(listing(spark, sf), RULES).select("position", "count")
    by_count = history.placed(groups, None, F.desc("count"), "position").withColumnRenamed("place", "place_by_count")
    by_position = history.placed(groups, None, "position", F.desc("count")).select("position", F.col("place").alias("place_by_position"))
    return by_count.join(by_position, "position")


@query("""WITH t AS (SELECT lang AS tag, (ascii(lang) % 2)::INT AS position, count(*) AS n FROM documents GROUP BY 1)
  SELECT tag, n, row_number() OVER (ORDER BY position, n DESC, tag)::INT AS place_by_position, row_number() OVER (ORDER BY n DESC, position, tag)::INT AS place_by_count FROM t""")
def srt03_tag_orders(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "documents").groupBy(F.col("lang").alias("tag")).agg(F.count("*").alias("n")).withColumn("position", F.ascii("tag") % 2)
    first = history.placed(tags, None, "position", F.desc("n"), "tag").select("tag", "n", F.col("place").alias("place_by_position"))
    second = history.placed(tags, None, F.desc("n"), "position", "tag").select("tag", F.col("place").alias("place_by_count"))
    return first.join(second, "tag")


@query(TOKENS + f""", d AS (SELECT keyword, count(*) FILTER (date = DATE '{DAY}') AS now, count(*) FILTER (date = DATE '{DAY}' - 1) AS before FROM words GROUP BY 1),
  v AS (SELECT keyword, now, before, CASE WHEN before = 0 THEN now ELSE now / before END::DOUBLE AS key FROM d WHERE now > 0 AND CASE WHEN before = 0 THEN now >= 2 ELSE now / before >= 1.0 END)
  SELECT keyword, now, before, row_number() OVER (ORDER BY key DESC, keyword)::INT AS place FROM v ORDER BY key DESC, keyword LIMIT 15""")
def srt06_viral_order(spark: SparkSession, sf: str) -> DataFrame:
    found = A.viral(listing(spark, sf), DAY, 1.0, 2)
    key = F.coalesce(F.try_divide(F.col("now").cast("double"), F.col("before")), F.col("now").cast("double"))
    return history.placed(found, 15, key.desc(), "keyword").select("keyword", "now", "before", "place")


@query(TOKENS + _CHANGES + """, l AS (SELECT *, 'rising' AS list, row_number() OVER (ORDER BY change DESC, keyword) AS place FROM ch WHERE change > 0
  UNION ALL SELECT *, 'falling', row_number() OVER (ORDER BY change, keyword) FROM ch WHERE change < 0
  UNION ALL SELECT *, 'new', row_number() OVER (ORDER BY keyword) FROM ch WHERE n1 = 0 AND n2 > 0) SELECT keyword, n1, n2, change, list, place::INT AS place FROM l WHERE place <= 6""")
def srt09_rising_and_falling(spark: SparkSession, sf: str) -> DataFrame:
    first, second = D.compare_period("last_week", DAY), D.compare_period("this_week", DAY)
    counts = lambda p: A.keyword_counts(listing(spark, sf).where(F.col("date").between(F.lit(p[0]), F.lit(p[1]))))
    changes = A.compare_counts(counts(first), counts(second), "keyword").drop("change_pct")
    return history.movers(changes, "keyword", 6)


@query(TOKENS + f""", k AS (SELECT keyword, count(*) AS n FROM words WHERE {IN_DAYS} GROUP BY 1 ORDER BY n DESC, keyword LIMIT 10), t AS (SELECT DISTINCT title FROM listing WHERE {IN_DAYS})
  SELECT title, sum(CASE WHEN contains(lower(title), lower(keyword)) THEN n ELSE 0 END)::BIGINT AS score FROM t CROSS JOIN k GROUP BY 1 ORDER BY score DESC, title LIMIT 5""")
def srt12_sample_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf).where(F.expr(IN_DAYS))
    return history.sample_titles(rows.select("title").distinct(), A.top_keywords(rows, 10), 5)


# ---- days, times and replies


@query(f"""WITH p AS (SELECT * FROM (VALUES ('today', DATE '{DAY}', DATE '{DAY}'), ('yesterday', DATE '1998-06-14', DATE '1998-06-14'), ('last_week', DATE '1998-06-08', DATE '1998-06-14'),
  ('this_week', DATE '1998-06-15', DATE '{DAY}'), ('last_month', DATE '1998-05-16', DATE '1998-06-14'), ('this_month', DATE '1998-06-01', DATE '{DAY}')) v(period, a, b))
  SELECT period, count(l_orderkey) AS n FROM p LEFT JOIN lineitem ON l_shipdate::DATE BETWEEN a AND b GROUP BY 1""")
def dt08_period_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = ("today", "yesterday", "last_week", "this_week", "last_month", "this_month")
    day = F.to_date("l_shipdate")
    inside = [F.count_if(day.between(*map(F.lit, D.compare_period(p, DAY)))).alias(p) for p in names]
    row = table(spark, sf, "lineitem").agg(*inside)
    return row.select(F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.col(p).alias("n")) for p in names))).alias("x")).select("x.*")


@query(f"""SELECT o_orderkey, round(epoch_us(TIMESTAMP '1998-06-15 12:00:00' - o_orderdate) / 86400e6, 6) AS age, CASE WHEN o_orderdate::DATE > DATE '{DAY}' THEN 'future'
  WHEN DATE '{DAY}' - o_orderdate::DATE > 365 THEN 'old' ELSE 'ok' END AS state FROM orders""")
def dt13_ages_and_guards(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("o_orderdate").cast("timestamp")
    age = D.age_days(ts, F.lit("1998-06-15 12:00:00").cast("timestamp"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(age, 6).alias("age"), D.day_state(F.to_date("o_orderdate"), F.lit(DAY)).alias("state"))


@query("SELECT strftime(ts, '%H:%M') AS clock, count(*) AS n FROM events GROUP BY 1")
def dt12_clock_times(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [F.date_format("ts", f) for f in ("yyyy-MM-dd HH:mm:ss", "HH-mm", "HH:mm")]
    mixed = F.when(F.col("event_id") % 3 == 0, kinds[0]).when(F.col("event_id") % 3 == 1, kinds[1]).otherwise(kinds[2])
    return table(spark, sf, "events").select(D.clock(mixed).alias("clock")).groupBy("clock").agg(F.count("*").alias("n"))


@query("SELECT event_id AS item_id, (user_id % 7)::BIGINT AS tag_id, 0.25::DOUBLE AS score FROM events")
def jsn04_mended_replies(spark: SparkSession, sf: str) -> DataFrame:
    entry = F.format_string("{'id': %d, \"tag_id\": %d, \"score\": '0.25',}", "event_id", F.col("user_id") % 7)
    end = F.when(F.col("user_id") % 2 == 0, ',{"id": 9, "tag').otherwise(",]\nThat is all.")
    entries = table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.collect_list(entry), ", ").alias("entries"))
    replies = entries.select(F.concat(F.lit("Here it is:\n["), "entries", end).alias("body"))
    return classify.reply_rows(replies).select("item_id", "tag_id", "score")
