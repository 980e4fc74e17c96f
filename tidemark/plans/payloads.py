"""Queries over payloads, replies and versions that are made of the tables' rows and read again, over table maintenance and report modes, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, display
from ..operators import analytics as A
from ..operators import history, store
from ..sources import feeds
from ..sources.observations import listing, observations, table
from .queries import DAY, OBS, RULES, query
from .reports import EARLY
from .trends import _REPORT

# ---- payloads of lists and feeds


@query(OBS + """, l AS (SELECT date, batch, platform_id, 'item ' || (item % 40) AS title, 'https://x/' || item AS url, rank FROM obs)
  SELECT strftime(date, '%Y-%m-%d') || ' ' || batch || ' ' || platform_id AS source_id, title, array_to_string(list(rank ORDER BY rank), ',') AS ranks, arg_min(url, rank) AS url FROM l GROUP BY ALL""")
def src02_list_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Each poll as the payload of a list page, read again: a title that stands twice has both ranks."""
    obs = observations(spark, sf)
    item = F.struct(F.concat(F.lit("item "), (F.col("item") % 40).cast("string")).alias("title"), F.concat(F.lit("https://x/"), F.col("item").cast("string")).alias("url"))
    source = F.concat_ws(" ", F.col("date").cast("string"), F.col("batch").cast("string"), "platform_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"])
    polls = obs.groupBy(source.alias("source_id")).agg(F.to_json(F.struct(F.lit("success").alias("status"), ordered.alias("items"))).alias("body"))
    return feeds.list_items(polls).select("source_id", "title", F.array_join("ranks", ",").alias("ranks"), "url")


_PART_DAY = "TIMESTAMP '2024-01-01 08:00:00' + to_days(p_size::INT)"


def _published() -> Column:
    return F.lit("2024-01-01 08:00:00").cast("timestamp") + F.make_dt_interval(F.col("p_size").cast("int"))


@query(f"""SELECT p_brand AS source_id, CASE WHEN p_size % 5 = 0 THEN p_type ELSE p_name END AS title, CASE WHEN p_size % 3 = 0 THEN 'id' || p_partkey ELSE 'https://x/' || p_partkey END AS url,
  {_PART_DAY} AS published_at, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '5 < 6' END AS summary FROM part""")
def src04_json_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's parts as a JSON feed, read again with its fallbacks for title, link and summary."""
    none = F.lit(None).cast("string")
    size = F.col("p_size")
    key = F.col("p_partkey").cast("string")
    item = F.struct(
        F.concat(F.lit("id"), key).alias("id"), F.when(size % 5 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.when(size % 3 != 0, F.concat(F.lit("https://x/"), key)).alias("url"),
        F.col("p_type").alias("content_text"), F.when(size % 2 != 0, "5 < 6").otherwise(none).alias("summary"), F.date_format(_published(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published"),
    )
    body = F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.collect_list(item).alias("items")))
    found = feeds.json_feed_items(table(spark, sf, "part").groupBy(F.col("p_brand").alias("source_id")).agg(body.alias("body")))
    return found.select("source_id", "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "summary")


@query(f"""SELECT p_brand AS source_id, p_name || ' & more' AS title, 'https://x/' || p_partkey AS url, {_PART_DAY} AS published_at, p_type || ' <3' AS summary, p_brand AS author FROM part""")
def src03_xml_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's parts as RSS, RDF or Atom, by the brand, with prefixes of their own, read again."""
    named = lambda tag, text: F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))
    title, link = F.concat("p_name", F.lit(" &amp; more")), F.concat(F.lit("https://x/"), F.col("p_partkey").cast("string"))
    summary, iso = F.concat("p_type", F.lit(" &amp;lt;3")), F.date_format(_published(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    mail = F.date_format(_published(), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    rss = named("item", F.concat(named("title", title), named("link", link), named("pubDate", mail), named("description", summary), named("d:creator", F.col("p_brand"))))
    rdf = named("r:item", F.concat(named("r:title", title), named("r:link", link), named("d:date", iso), named("r:description", summary), named("d:creator", F.col("p_brand"))))
    atom = named(
        "entry", F.concat(named("title", title), F.lit('<link href="'), link, F.lit('"/>'), named("updated", iso), named("summary", summary), named("author", named("name", F.col("p_brand"))))
    )
    kind = F.length("p_brand") + F.ascii(F.right("p_brand", F.lit(1)))
    docs = table(spark, sf, "part").groupBy(F.col("p_brand").alias("source_id"), (kind % 3).alias("kind")).agg(
        *(F.array_join(F.collect_list(x), "").alias(n) for n, x in (("rss", rss), ("rdf", rdf), ("atom", atom)))
    )
    dc = 'xmlns:d="http://purl.org/dc/elements/1.1/"'
    body = (
        F.when(F.col("kind") == 0, F.concat(F.lit(f'<rss version="2.0" {dc}><channel>'), "rss", F.lit("</channel></rss>")))
        .when(F.col("kind") == 1, F.concat(F.lit(f'<x:RDF xmlns:x="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:r="http://purl.org/rss/1.0/" {dc}>'), "rdf", F.lit("</x:RDF>")))
        .otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "atom", F.lit("</feed>")))
    )
    found = feeds.rss_items(docs.select("source_id", body.alias("body")))
    return found.select("source_id", "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "summary", "author")


# ---- replies, versions, phrases


@query("SELECT conv_id, (turn + 1)::INT AS n, 'said ' || length(text) AS text FROM conversations")
def str21_numbered_replies(spark: SparkSession, sf: str) -> DataFrame:
    """A reply of numbered entries in falling order for each conversation, as its entries in order."""
    entry = F.format_string("[%d] said %d", F.col("turn") + 1, F.length("text"))
    told = F.transform(F.sort_array(F.collect_list(F.struct("turn", entry.alias("e"))), asc=False), lambda x: x["e"])
    replies = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(told, "\n").alias("reply"), F.count("*").cast("int").alias("n"))
    texts = display.numbered_reply(F.col("reply"), F.col("n"))
    return replies.select("conv_id", F.posexplode(texts).alias("at", "text")).select("conv_id", (F.col("at") + 1).alias("n"), "text")


@query("""WITH v AS (SELECT [o_orderkey % 3, o_orderkey % 5, o_orderkey % 7] AS v, o_orderkey % 11 = 0 AS bad FROM orders),
  w AS (SELECT CASE WHEN bad THEN [0, 0, 0] ELSE v END AS v FROM v) SELECT CASE WHEN v < [1, 2, 3] THEN 'behind' WHEN v > [1, 2, 3] THEN 'ahead' ELSE 'same' END AS state, count(*) AS n FROM w GROUP BY 1""")
def str23_version_states(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    version = F.when(k % 11 == 0, F.format_string("%d.x", k % 3)).otherwise(F.format_string(" %d.%d.%d", k % 3, k % 5, k % 7))
    return table(spark, sf, "orders").groupBy(display.version_state(version, F.lit("1.2.3")).alias("state")).agg(F.count("*").alias("n"))


@query(f"""WITH p(phrase, a, b) AS (VALUES ('this week', DATE '1998-06-15', DATE '{DAY}'), ('last week', DATE '1998-06-08', DATE '1998-06-14'), ('本月', DATE '1998-06-01', DATE '{DAY}'), ('last month', DATE '1998-05-01', DATE '1998-05-31'),
  ('最近30天', DATE '{DAY}' - 29, DATE '{DAY}'), ('3 days ago', DATE '{DAY}' - 3, DATE '{DAY}' - 3)) SELECT phrase, count(l_orderkey) AS n FROM p LEFT JOIN lineitem ON l_shipdate::DATE BETWEEN a AND b GROUP BY 1""")
def dt07_phrases(spark: SparkSession, sf: str) -> DataFrame:
    phrases = ("this week", "last week", "本月", "last month", "最近30天", "3 days ago")
    day = F.to_date("l_shipdate")
    row = table(spark, sf, "lineitem").agg(*(F.count_if(day.between(*map(F.lit, dates.date_range(p, DAY)))).alias(p) for p in phrases))
    return row.select(F.explode(F.array(*(F.struct(F.lit(p).alias("phrase"), F.col(f"`{p}`").alias("n")) for p in phrases))).alias("x")).select("x.*")


# ---- modes of a report


def _report_sql(day: date, keep: str) -> str:
    upto = _REPORT.replace("FROM lineitem JOIN part ON l_partkey = p_partkey)", f"FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate::DATE <= DATE '{day}')").replace(f"DATE '{DAY}'", f"DATE '{day}'")
    return upto + f", p AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY weight DESC, platform_id, title)::INT AS place FROM r WHERE {keep}) SELECT * FROM p"


def _report(spark: SparkSession, sf: str, day: date, mode: str) -> DataFrame:
    """The report of a day, made of all rows up to it."""
    rows = listing(spark, sf).where(F.col("date") <= F.lit(day))
    titles = rows.groupBy("platform_id", "title").agg(F.round(A.hotness_of_group("rank", 3), 4).alias("weight"))
    titles = titles.withColumn("position", RULES.group_of(F.col("title"))).where("position >= 0")
    return history.report_rows(titles, history.history(rows), F.lit(day), mode=mode)


@query(_report_sql(DAY, f"last_date = DATE '{DAY}'"))
def prj05_current_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf, DAY, "current")


@query(_report_sql(EARLY, "is_new"))
def prj05_incremental_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf, EARLY, "incremental")


@query(_REPORT + " SELECT platform_id, title, weight, first_date, times FROM r")
def prj01_presented(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without what was not asked for."""
    rows = listing(spark, sf)
    titles = rows.groupBy("platform_id", "title").agg(F.round(A.hotness_of_group("rank", 3), 4).alias("weight")).where(RULES.accepts(F.col("title")))
    found = titles.join(history.history(rows), ["platform_id", "title"]).drop("last_date")
    return history.presented(found.withColumns({"url": F.lit("https://x"), "summary": F.lit("none")}))


# ---- table maintenance


_TWO = "WITH t AS (SELECT c_custkey AS k, 'customer' AS v FROM customer WHERE c_nationkey < 15), n AS (SELECT o_custkey AS k, 'order' AS v FROM orders WHERE o_totalprice > 200000)"


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    one = table(spark, sf, "customer").where("c_nationkey < 15").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("v"))
    return one, table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"), F.lit("order").alias("v"))


@query(_TWO + " SELECT * FROM t UNION ALL SELECT DISTINCT k, v FROM n WHERE k NOT IN (SELECT k FROM t)")
def snk04_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return store.insert_ignore(*_two(spark, sf), ["k"])


@query(_TWO + " SELECT * FROM t WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT DISTINCT k, v FROM n")
def snk03_insert_replace(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _two(spark, sf)
    return store.insert_replace(old, new.distinct(), ["k"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice > 100000 END, false) = false")
def snk08_delete_where(spark: SparkSession, sf: str) -> DataFrame:
    """Rows for which the condition is unknown stay."""
    dear = F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice") > 100000)
    return store.delete_where(table(spark, sf, "orders"), dear).select("o_orderkey", "o_orderpriority")


@query(OBS + " SELECT date, platform_id, count(*) AS n FROM obs WHERE date >= (SELECT max(date) FROM obs) - 7 GROUP BY ALL")
def snk11_retained(spark: SparkSession, sf: str) -> DataFrame:
    obs = observations(spark, sf)
    newest = obs.agg(F.max("date").alias("newest"))  # one row
    kept = store.retained(obs.crossJoin(F.broadcast(newest)), "date", F.col("newest"), 7)
    return kept.groupBy("date", "platform_id").agg(F.count("*").alias("n"))
