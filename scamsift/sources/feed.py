"""Threat feeds, sender lists and redirect tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import urls
from ..operators.url_signals import feed_key

#: Feeds and lists up to this many rows are broadcast, longer ones shuffled.
BROADCAST_ROWS = 200_000


def entries(lines: DataFrame, line: str = "value") -> DataFrame:
    """Distinct feed entries (column ``entry``): the first link of every line that is no comment, without trailing slashes."""
    t = F.trim(F.col(line))
    first = F.get(urls(t), F.lit(0))
    return lines.where((t != "") & ~t.startswith("#")).select(feed_key(first).alias("entry")).where("entry is not null").distinct()


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return entries(spark.read.text(path))


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is found to have at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_match(rows: DataFrame, feed: DataFrame, key: str, links: str = "links") -> DataFrame:
    """``key`` and ``feed_url``: of each row's links (array of text) the first one in the feed."""
    each = rows.select(key, F.posexplode(links).alias("at", "url")).withColumn("entry", feed_key(F.col("url")))
    return each.join(sized(feed.select("entry")), "entry").groupBy(key).agg(F.min_by("entry", "at").alias("feed_url"))


def redirects(rows: DataFrame, table: DataFrame, key: str, links: str = "links") -> DataFrame:
    """``key`` and ``resolved``: destinations of the row's shortened links by a table (url, destination), in order, each once.

    Links are looked up in their https form; only one hop is followed.
    """
    from ..functions.domains import is_shortener, parse_urls

    each = rows.select(key, F.posexplode(parse_urls(F.col(links))).alias("at", "u")).where(is_shortener(F.col("u.host")))
    each = each.withColumn("url", https(F.col("u.url")))
    found = each.join(sized(table.select("url", "destination").dropna().dropDuplicates(["url"])), "url")
    return found.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "destination"))), lambda s: s["destination"])).alias("resolved"))


def https(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), F.regexp_replace(url, "(?i)^http://", "https://")).otherwise(F.concat(F.lit("https://"), url))
