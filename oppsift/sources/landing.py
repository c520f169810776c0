"""Readers of landed posts: files that a collector has put in a folder for each source.

A collector outside Spark fetches posts and lands them as JSON lines (RSS and Atom feeds as XML); what a search, a feed or
a repository listing gives differs in shape only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppsift.operators.normalize import SOURCES, limited

# How many posts of each query are taken, by source.
LIMITS = {"twitter": 15, "reddit": 15, "github": 100, "hackernews": 50, "youtube": 30, "rss": 15}

#: Where the posts lie within a landed object, by source; the others land one post a line.
LISTS = {"hackernews": "hits", "youtube": "entries"}
#: The natural id that a source names differently.
IDS = {"github": "fullName", "hackernews": "objectID"}


def _numbered(rows: DataFrame, source: str) -> DataFrame:
    # monotonically_increasing_id follows files and lines, which is the order of reading
    return rows.select(F.lit(source).alias("source"), "query", F.monotonically_increasing_id().alias("pos"), "raw")


def posts(lines: DataFrame, source: str) -> DataFrame:
    """Lines (value, path) of one source as bronze rows: source, query, pos, raw. A line that is no JSON has a null raw.

    Posts are in the order in which the collector landed them; the searches give the newest first.
    """
    raw = F.try_parse_json("value")
    query = F.coalesce(F.try_variant_get(raw, "$._collector_query", "string"), F.nullif(F.regexp_extract("path", r"query=([^/]*)", 1), F.lit("")), F.lit("") if source in LISTS else F.col("path"))
    rows = lines.select(raw.alias("raw"), query.alias("query"))
    if source in LISTS:
        listed = F.try_variant_get("raw", f"$.{LISTS[source]}", "array<variant>")
        one = F.array("raw")
        rows = rows.select("query", F.explode(F.coalesce(listed, one)).alias("raw"))
    return _numbered(rows, source)


def read_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Landed JSON lines of a source; lines that are broken stay, with a null raw, for the quarantine."""
    return posts(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")), source)


#: An item of an RSS feed or an entry of an Atom feed. A link is a text there and has an address here, and an author a name.
FEED_ITEM = (
    "STRUCT<guid: STRING, id: STRING, title: STRING, link: ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING>>, author: STRUCT<_VALUE: STRING, name: STRING>, creator: STRING, "
    "description: STRING, summary: STRING, content: STRING, pubDate: STRING, published: STRING, updated: STRING>"
)
FEED = f"channel STRUCT<item: ARRAY<{FEED_ITEM}>>, item ARRAY<{FEED_ITEM}>, entry ARRAY<{FEED_ITEM}>"


def feed_posts(files: DataFrame) -> DataFrame:
    """Whole feeds (value, path), RSS or Atom, as bronze rows; limits count by feed, its file. A feed that is no XML is a row with
    a null raw, for the quarantine, and harms no other."""
    feed = F.from_xml(F.col("value"), FEED, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    items = F.coalesce("feed.channel.item", "feed.item", "feed.entry")
    rows = files.select("path", feed.alias("feed")).select("path", F.explode_outer(items).alias("i"))
    when = F.coalesce("i.pubDate", "i.published", "i.updated")
    moment = F.coalesce(F.try_to_timestamp(F.regexp_replace(when, r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(when, r"^\w{3},\s*|GMT$", ""), F.lit("d MMM yyyy HH:mm:ss ")), when.try_cast("timestamp"))
    parts = F.when(moment.isNotNull(), F.array(*(f(moment) for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second))))
    plain = F.get(F.filter(F.col("i.link"), lambda x: x["_href"].isNull() | F.coalesce(x["_rel"], F.lit("alternate")).isin("alternate")), F.lit(0))
    link = F.coalesce(plain["_href"], plain["_VALUE"], F.get("i.link", F.lit(0))["_href"])
    post = F.struct(
        F.coalesce("i.guid", "i.id").alias("id"), "i.title", link.alias("link"), F.coalesce("i.author.name", "i.author._VALUE", "i.creator").alias("author"), F.coalesce("i.description", "i.summary", "i.content").alias("summary"),
        parts.alias("published_parsed"), F.col("path").alias("_collector_query"),
    )
    return _numbered(rows.select(F.col("path").alias("query"), F.when(F.col("i").isNotNull(), F.parse_json(F.to_json(post))).alias("raw")), "rss")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The RSS and Atom feeds of a folder, a file each."""
    return feed_posts(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")))


#: How each source is read; a new source is put in here and in ``normalize.SOURCES``.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {s: (lambda spark, path, s=s: read_json(spark, path, s)) for s in SOURCES if s != "rss"} | {"rss": read_feed}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything has landed there, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_landed(spark: SparkSession, folder: str, sources: list[str] | None = None, limits: dict[str, int] | None = None, per_query_limit: int | None = None) -> DataFrame:
    """The posts of all sources that have landed in folder/<source>, limited for each query; a source without files gives none."""
    limits = {s: per_query_limit for s in LIMITS} if per_query_limit else LIMITS | (limits or {})
    found = [READERS[s](spark, f"{folder}/{s}") for s in sources or READERS if s in READERS and exists(spark, f"{folder}/{s}")]
    if not found:
        return spark.createDataFrame([], "source string, query string, pos bigint, json string").select("source", "query", "pos", F.try_parse_json("json").alias("raw"))
    return limited(reduce(DataFrame.unionByName, found), limits)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file of KEY=VALUE lines; blank lines and those with # in front are left out, the last of a key counts."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).withColumn("line", F.trim("value"))
    kept = lines.where("line != '' and not startswith(line, '#') and contains(line, '=')")
    pairs = kept.select(F.trim(F.regexp_extract("line", "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("line", "^[^=]*=(.*)$", 1)).alias("value"), "n")
    return pairs.groupBy("key").agg(F.max_by("value", "n").alias("value"))
