"""Every query of the reference's operators against its SQL, and the smoke entry."""

import duckdb
import oracle
import pytest

import __spark_entry__ as entry
from tidemark.plans.queries import ORACLE_SQL, QUERIES


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert oracle.differ(QUERIES[name](spark, sf).toPandas(), oracle.connect(sf).execute(ORACLE_SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_plain_html_query_equals_sql_on_cut_references(spark, tmp_path):
    pages = ["<title>the&amp;&amp</title><p>x &quot y</p>", "<h1>a&am</h1>&copy;&middot", "&ampquot; <b>&amp;lt</b>&lt;i&gt; &#38; &amp;quot;", "<p>a &amp</p>\n<p>&quo\t&quot;&middot;</p>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["str06_plain_html"](spark, str(tmp_path)).toPandas()
    assert oracle.differ(got, con.execute(ORACLE_SQL["str06_plain_html"]).df()) == ""
