"""Recorded payloads of list pages and feeds, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_html

LIST = "status STRING, items ARRAY<STRUCT<title STRING, url STRING, mobileUrl STRING>>"
JSON_FEED = (
    "version STRING, items ARRAY<STRUCT<id STRING, title STRING, url STRING, external_url STRING, content_text STRING, content_html STRING, "
    "summary STRING, date_published STRING, date_modified STRING, authors ARRAY<STRUCT<name STRING>>>>"
)

_ITEM = (
    "ARRAY<STRUCT<title STRUCT<_VALUE STRING>, `dc:title` STRING, link STRING, guid STRUCT<_VALUE STRING>, `_rdf:about` STRING, pubDate STRING, `dc:date` STRING, "
    "description STRING, `dc:description` STRING, `content:encoded` STRING, author STRING, `dc:creator` STRING>>"
)
#: RSS 2.0 has its items in the channel, RDF beside it, Atom has entries.
XML_FEED = (
    f"channel STRUCT<item {_ITEM}, title STRING>, item {_ITEM}, "
    "entry ARRAY<STRUCT<title STRUCT<_VALUE STRING>, link ARRAY<STRUCT<_href STRING, _rel STRING, _type STRING>>, id STRING, published STRING, "
    "updated STRING, summary STRUCT<_VALUE STRING>, content STRUCT<_VALUE STRING>, author ARRAY<STRUCT<name STRING>>>>, _broken STRING"
)


def list_items(payloads: DataFrame, source: str = "source_id", body: str = "body") -> DataFrame:
    """(source, title, ranks, url, mobile_url): positions count from 1, blank titles are skipped."""
    rows = payloads.select(source, F.from_json(body, LIST).alias("p")).where("p.status IN ('success', 'cache')")
    rows = rows.select(source, F.posexplode("p.items").alias("at", "item")).where("trim(item.title) <> ''")
    first = lambda c: F.min_by(c, "at")
    return rows.groupBy(source, F.trim("item.title").alias("title")).agg(
        F.array_sort(F.collect_list(F.col("at") + 1)).alias("ranks"), first("item.url").alias("url"), first("item.mobileUrl").alias("mobile_url")
    )


def json_feed_items(payloads: DataFrame, source: str = "source_id", body: str = "body", most: int = 0) -> DataFrame:
    """Entries of JSON feeds, with fallbacks for title, link and date; ``most`` for each feed if above 0."""
    rows = payloads.select(source, F.from_json(body, JSON_FEED).alias("p")).where("p.version LIKE 'https://jsonfeed.org/version/%'")
    rows = rows.select(source, F.posexplode("p.items").alias("at", "i"))
    if most > 0:
        rows = rows.where(F.col("at") < most)
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(
        source,
        F.coalesce(empty("i.title"), F.left("i.content_text", F.lit(100)), F.lit("")).alias("title"),
        F.coalesce(empty("i.url"), empty("i.external_url"), empty("i.id")).alias("url"),
        F.coalesce(F.try_to_timestamp("i.date_published"), F.try_to_timestamp("i.date_modified")).alias("published_at"),
        F.coalesce(empty("i.summary"), empty("i.content_text"), F.regexp_replace("i.content_html", "<[^>]+>", "")).alias("summary"),
        F.array_join(F.transform("i.authors", lambda a: a["name"]), ", ").alias("author"),
    )


#: Namespaces of feeds, with the prefix that the schema has for each.
NAMESPACES = {
    "http://www.w3.org/2005/Atom": "",
    "http://purl.org/rss/1.0/": "",
    "http://my.netscape.com/rdf/simple/0.9/": "",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf:",
    "http://purl.org/dc/elements/1.1/": "dc:",
    "http://purl.org/rss/1.0/modules/content/": "content:",
}


def usual_prefixes(body: Column) -> Column:
    """The document with the schema's prefixes in place of those that it has chosen itself for known namespaces.

    Atom elements in another kind of feed (``<atom:link>`` in RSS) keep theirs: they are not the feed's own."""
    root = F.regexp_extract(body, r"<([A-Za-z_][\w.-]*:)?[A-Za-z_][\w.-]*[\s>/]", 1)
    out = body
    for uri, usual in NAMESPACES.items():
        at = uri.replace(".", r"\.")
        prefix = F.regexp_extract(body, rf"xmlns:([A-Za-z_][\w.-]*)\s*=\s*[\"']{at}[\"']", 1)
        own = F.concat(prefix, F.lit(":"))
        other = (prefix != "") & (own != usual)
        if not usual:
            other = other & ((root == own) | F.lit("Atom" not in uri))
        literal = F.replace(prefix, F.lit("."), F.lit(r"\."))
        # Where nothing is to be changed the pattern matches nowhere, so that each step stands in the plan once.
        tag = F.when(other, F.concat(F.lit("(</?)"), literal, F.lit(":"))).otherwise("(?!)()")
        out = F.regexp_replace(out, tag, F.lit(f"$1{usual}"))
        if usual:
            attribute = F.when(other, F.concat(F.lit(r"(<[^<>]*\s)"), literal, F.lit(r":([\w.-]+\s*=)"))).otherwise("(?!)()")
            out = F.regexp_replace(out, attribute, F.lit(f"$1{usual}$2"))
    return out


def _parsed(payloads: DataFrame, source: str, body: str) -> DataFrame:
    return payloads.select(source, F.col(body).alias("_body"), F.from_xml(usual_prefixes(F.col(body)), XML_FEED, {"columnNameOfCorruptRecord": "_broken"}).alias("p"))


def failed_feeds(payloads: DataFrame, source: str = "source_id", body: str = "body") -> DataFrame:
    """(source, reason) of the documents that give no entry because they can't be read: ``empty``, ``broken`` (no XML) or ``unknown``
    (XML, but no feed). A feed without entries is none of them."""
    rows = _parsed(payloads, source, body)
    nothing = F.coalesce(F.trim("_body"), F.lit("")) == ""
    feed = F.coalesce("p.channel.item", "p.item").isNotNull() | F.col("p.entry").isNotNull() | F.col("p.channel").isNotNull()
    named = F.col("_body").rlike(r"<([A-Za-z_][\w.-]*:)?(rss|feed|RDF)[\s>/]")
    reason = F.when(nothing, "empty").when(F.col("p._broken").isNotNull() & ~feed, "broken").when(~feed & ~named, "unknown")
    return rows.select(source, reason.alias("reason")).where("reason IS NOT NULL")


def rss_items(payloads: DataFrame, source: str = "source_id", body: str = "body", most: int = 0) -> DataFrame:
    """Entries of RSS 2.0, RDF (RSS 0.9 and 1.0) and Atom documents, whatever prefixes they have, with fallbacks for title, link,
    date, summary and author; blank titles are skipped, ``most`` for each feed if above 0. ``failed_feeds`` tells what can't be read."""
    rows = _parsed(payloads, source, body)
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    rss = rows.select(source, F.posexplode(F.coalesce("p.channel.item", "p.item")).alias("at", "i")).select(
        source,
        "at",
        F.coalesce("i.title._VALUE", "i.`dc:title`").alias("title"),
        empty("i.link").alias("url"),
        F.coalesce(_day_time(F.col("i.pubDate")), _day_time(F.col("i.`dc:date`"))).alias("published_at"),
        F.coalesce(empty("i.description"), empty("i.`dc:description`"), empty("i.`content:encoded`")).alias("summary"),
        F.coalesce(empty("i.author"), empty("i.`dc:creator`")).alias("author"),
        F.coalesce(empty("i.guid._VALUE"), empty("i.`_rdf:about`"), empty("i.link")).alias("guid"),
    )
    best = F.filter("i.link", lambda x: F.coalesce(x["_rel"] == "alternate", F.lit(False)) | F.coalesce(x["_type"].startswith("text/html"), F.lit(False)))
    link = F.coalesce(F.get(best, F.lit(0))["_href"], F.get("i.link", F.lit(0))["_href"])
    atom = rows.select(source, F.posexplode("p.entry").alias("at", "i")).select(
        source,
        "at",
        F.col("i.title._VALUE").alias("title"),
        empty(link).alias("url"),
        F.coalesce(_day_time(F.col("i.published")), _day_time(F.col("i.updated"))).alias("published_at"),
        F.coalesce(empty("i.summary._VALUE"), empty("i.content._VALUE")).alias("summary"),
        F.array_join(F.transform("i.author", lambda a: a["name"]), ", ").alias("author"),
        F.coalesce(empty("i.id"), empty(link)).alias("guid"),
    )
    both = rss.unionByName(atom).withColumns({"title": plain_html(F.col("title")), "summary": plain_html(F.col("summary"))}).where("title <> ''")
    return (both.where(F.col("at") < most) if most > 0 else both).drop("at")


def _day_time(text: Column) -> Column:
    """A time as feeds write it: ``Tue, 02 Jan 2024 03:04:05 +0000`` (or GMT) or ISO 8601."""
    mail = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", ""), "(GMT|UTC|UT)$", "+0000")
    return F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(text)))
