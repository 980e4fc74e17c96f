"""Queries over the log of polls and over tables that are kept by day, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, observe, versions
from ..sources.days import DayStore, coverage
from ..sources.observations import observations, polled, table, titled
from .queries import OBS, query
from .trends import POLLS

_TITLED = POLLS.replace(
    "WITH best AS",
    """WITH titles AS (SELECT ts::DATE AS date, (hour(ts) // 6)::INT AS batch, event_type AS platform_id, user_id AS item,
  'title ' || (arg_max((props->>'k')::BIGINT, (value, event_id)) % 3) AS title FROM events GROUP BY ALL), best AS""",
) + """, st AS (SELECT * FROM seen JOIN titles USING (date, batch, platform_id, item)),
  o AS (SELECT *, lag(title) OVER w AS old, row_number() OVER w AS nth FROM st WINDOW w AS (PARTITION BY date, platform_id, item ORDER BY batch)),
  nx AS (SELECT *, lead(batch) OVER (PARTITION BY date ORDER BY batch) AS nb FROM b),
  gone AS (SELECT s.date, s.platform_id, s.item, nx.nb AS batch FROM seen s JOIN nx ON nx.date = s.date AND nx.batch = s.batch
    JOIN polls p ON p.date = s.date AND p.platform_id = s.platform_id AND p.batch = nx.nb AND p.status = 'success'
    WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.date = s.date AND x.platform_id = s.platform_id AND x.item = s.item AND x.batch = nx.nb))"""


def _titled_polls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    obs, polls = polled(spark, sf)
    return titled(spark, sf).join(polls.where("status = 'success'").drop("status"), ["date", "platform_id", "batch"], "left_semi"), polls


@query(_TITLED + """, g AS (SELECT date, platform_id, batch, count(*) AS off_list FROM gone GROUP BY ALL),
  r AS (SELECT date, platform_id, batch, count(*) AS n, count(*) FILTER (nth = 1) AS new, count(*) FILTER (nth > 1) AS updated, count(*) FILTER (old <> title) AS title_changed FROM o GROUP BY ALL)
  SELECT p.date, p.platform_id, p.batch, p.status, coalesce(n, 0) AS n, coalesce(new, 0) AS new, coalesce(updated, 0) AS updated, coalesce(title_changed, 0) AS title_changed, coalesce(off_list, 0) AS off_list
  FROM polls p LEFT JOIN r USING (date, platform_id, batch) LEFT JOIN g USING (date, platform_id, batch)""")
def snk01_poll_log(spark: SparkSession, sf: str) -> DataFrame:
    return history.poll_log(*_titled_polls(spark, sf))


@query(_TITLED + " SELECT date, platform_id, item, batch, old AS old_title, title AS new_title FROM o WHERE old <> title")
def snk01_title_log(spark: SparkSession, sf: str) -> DataFrame:
    return observe.title_changes(_titled_polls(spark, sf)[0], observe.KEY, "title", "batch")


# ---- tables by day


def _store(rows: DataFrame) -> DayStore:
    store = DayStore.create(rows.sparkSession, rows.schema)
    store.write(rows)
    return store


@query(OBS + " SELECT date, batch, platform_id, item, rank FROM obs WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' AND platform_id IN ('click', 'error')")
def src07_days_of_store(spark: SparkSession, sf: str) -> DataFrame:
    """Some days and platforms of the observations out of a table by day."""
    return _store(observations(spark, sf)).read(date(2024, 1, 5), date(2024, 1, 9), platform_id=["click", "error"])


_DAYS = """WITH o AS (SELECT DISTINCT ts::DATE AS date FROM events WHERE value > 200 AND event_type = 'error'), s AS (SELECT DISTINCT ts::DATE AS date FROM events WHERE value > 200 AND event_type = 'click')"""


def _day_stores(spark: SparkSession, sf: str) -> tuple[DayStore, DayStore]:
    """Events of high value of two types, each as a table by day; some days have none."""
    high = table(spark, sf, "events").where("value > 200").withColumn("date", F.to_date("ts"))
    return _store(high.where("event_type = 'error'")), _store(high.where("event_type = 'click'"))


@query(_DAYS + """ SELECT 'error' AS store, min(date) AS first_day, max(date) AS last_day, count(*) AS days, max(date) - min(date) + 1 - count(*) AS missing FROM o
  UNION ALL SELECT 'click', min(date), max(date), count(*), max(date) - min(date) + 1 - count(*) FROM s""")
def anl32_store_status(spark: SparkSession, sf: str) -> DataFrame:
    """First and last day, days and missing days of two tables by day, from their partitions alone."""
    errors, clicks = (store.status() for store in _day_stores(spark, sf))
    return errors.withColumn("store", F.lit("error")).unionByName(clicks.withColumn("store", F.lit("click")))


@query(_DAYS + " SELECT date, CASE WHEN o.date IS NULL THEN 'second' WHEN s.date IS NULL THEN 'first' ELSE 'both' END AS kind FROM o FULL JOIN s USING (date)")
def src14_store_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage(*_day_stores(spark, sf))


# ---- changes of several tables


@query("""WITH t AS (SELECT n_nationkey AS tag_id, n_regionkey = 2 AS gone FROM nation), r AS (SELECT c_custkey AS item_id, c_nationkey AS tag_id, c_acctbal < 0 AS old FROM customer UNION ALL SELECT o_custkey, o_orderkey % 25, o_orderkey % 5 = 0 FROM orders),
  x AS (SELECT item_id, tag_id, old OR gone AS dep, NOT old AND gone AS now FROM r JOIN t USING (tag_id)), l AS (SELECT item_id FROM x GROUP BY 1 HAVING NOT (bool_or(now) AND bool_and(dep)))
  SELECT 'tags' AS part, CASE WHEN gone THEN 'deprecated' ELSE 'active' END AS status, count(*) AS n, count(*) FILTER (gone) AS dated FROM t GROUP BY ALL
  UNION ALL SELECT 'results', CASE WHEN dep THEN 'deprecated' ELSE 'active' END, count(*), count(*) FILTER (now) FROM x GROUP BY ALL UNION ALL SELECT 'log', 'analysed', count(*), 0 FROM l""")
def snk05_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Tags (nations) of one region are deprecated with their results; items that keep none leave the log."""
    none, status = F.lit(None).cast("timestamp").alias("deprecated_at"), lambda old: F.when(old, "deprecated").otherwise("active").alias("status")
    nation = table(spark, sf, "nation")
    tags = nation.select(F.col("n_nationkey").cast("long").alias("tag_id"), F.lit("active").alias("status"), none)
    one = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("item_id"), F.col("c_nationkey").cast("long").alias("tag_id"), status(F.col("c_acctbal") < 0), none)
    two = table(spark, sf, "orders").select(F.col("o_custkey").cast("long"), (F.col("o_orderkey") % 25).cast("long"), status(F.col("o_orderkey") % 5 == 0), none)
    results = one.union(two)
    gone = nation.where("n_regionkey = 2").select(F.col("n_nationkey").cast("long").alias("tag_id"))
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    new_tags, new_results, log = versions.deprecate_tags(tags, results, results.select("item_id").distinct(), gone, at)
    count = lambda f, name: f.groupBy("status").agg(F.count("*").alias("n"), F.count("deprecated_at").alias("dated")).select(F.lit(name).alias("part"), "status", "n", "dated")
    left = log.agg(F.lit("log").alias("part"), F.lit("analysed").alias("status"), F.count("*").alias("n"), F.lit(0).cast("long").alias("dated"))
    return count(new_tags, "tags").unionByName(count(new_results, "results")).unionByName(left)
