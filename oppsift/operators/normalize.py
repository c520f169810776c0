"""Raw posts of each source to one record, the signal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oppsift.functions import scalars as S
from oppsift.functions import text as T
from oppsift.functions.urls import canonical_url

ENGAGEMENT = "struct<likes: bigint, comments: bigint, views: bigint, score: bigint>"

#: Landed posts: one line of JSON each, as a variant, with the source, query and position at which it was read.
BRONZE = "source string, query string, pos bigint, raw variant"


def _field(name: str) -> Column:
    return F.try_variant_get("raw", f"$.{name}", "variant")


def _text(name: str) -> Column:
    return S.text_of_variant(_field(name))


def _count(name: str) -> Column:
    return S.counter_of_variant(_field(name))


def _strings(name: str) -> Column:
    found = F.coalesce(F.try_variant_get("raw", f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    return F.filter(found, lambda x: F.coalesce(x, F.lit("")) != "")


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def _metadata(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _plain(name: str) -> Column:
    """A field as JSON text, whatever its type."""
    return F.to_json(F.try_variant_get("raw", f"$.{name}", "variant"))


def _twitter() -> dict[str, Column]:
    return {
        "source_id": F.coalesce(_text("id"), F.col("raw_key")),
        "url": _text("url"),
        "author": _text("author"),
        "published_at": _iso(S.mail_date(_text("created_at"))),
        "title": F.lit(None).cast("string"),
        "body": _text("text"),
        "basis": _text("text"),
        "likes": _count("likes"),
        "views": _count("views"),
        "media": _strings("media_urls"),
        "metadata": _metadata(bio=_text("bio"), has_media=_plain("has_media"), card=_plain("card"), quoted_tweet=_plain("quoted_tweet")),
    }


def _reddit() -> dict[str, Column]:
    preview = F.filter(F.array(_text("url_overridden_by_dest")), lambda x: F.coalesce(x, F.lit("")) != "")
    return {
        "source_id": F.coalesce(_text("id"), F.col("raw_key")),
        "url": _text("url"),
        "author": _text("author"),
        "published_at": _iso(S.epoch_date(_text("created_utc"))),
        "title": T.clean_text(_text("title")),
        "body": _text("selftext"),
        "basis": _joined(_text("title"), _text("selftext")),
        "comments": _count("comments"),
        "score": _count("score"),
        "subreddit": _text("subreddit"),
        "media": F.concat(preview, _strings("gallery_urls")),
        "metadata": _metadata(post_hint=_text("post_hint"), preview_image_url=_text("preview_image_url")),
    }


def _github() -> dict[str, Column]:
    return {
        "source_id": S.filled(_text("fullName"), _text("url"), F.col("raw_key")),
        "url": _text("url"),
        "author": _text("owner.login"),
        "published_at": _text("updatedAt"),
        "title": _text("fullName"),
        "body": _text("description"),
        "basis": _text("description"),
        "score": _count("stargazersCount"),
    }


def _hackernews() -> dict[str, Column]:
    return {
        "source_id": F.coalesce(_text("objectID"), F.col("raw_key")),
        "url": S.filled(_text("url"), F.concat(F.lit("https://news.ycombinator.com/item?id="), _text("objectID"))),
        "author": _text("author"),
        "published_at": _text("created_at"),
        "title": T.clean_text(_text("title")),
        "body": _text("story_text"),
        "basis": _joined(_text("title"), _text("story_text")),
        "comments": _count("num_comments"),
        "score": _count("points"),
    }


def _youtube() -> dict[str, Column]:
    return {
        "source_id": F.coalesce(_text("id"), F.col("raw_key")),
        "url": S.filled(_text("url"), _text("webpage_url")),
        "author": _text("channel"),
        "published_at": F.lit(None).cast("string"),
        "title": T.clean_text(_text("title")),
        "body": _text("title"),
        "basis": _text("title"),
        "views": _count("view_count"),
        "metadata": _metadata(duration_seconds=_plain("duration")),
    }


def _rss() -> dict[str, Column]:
    summary = T.strip_tags(_text("summary"))
    return {
        "source_id": S.filled(_text("id"), _text("link"), F.col("raw_key")),
        "url": _text("link"),
        "author": _text("author"),
        "published_at": _iso(S.parts_date(F.try_variant_get("raw", "$.published_parsed", "array<int>"))),
        "title": T.clean_text(_text("title")),
        "body": summary,
        "basis": _joined(_text("title"), summary),
    }


#: A source's fields by signal column; more sources may be put in.
SOURCES: dict[str, Callable[[], dict[str, Column]]] = {"twitter": _twitter, "reddit": _reddit, "github": _github, "hackernews": _hackernews, "youtube": _youtube, "rss": _rss}


def raw_key() -> Column:
    """The natural key of a raw post; a fingerprint of the post if it has none."""
    return S.filled(*(_text(k) for k in ("id", "fullName", "objectID", "guid", "link", "url")), F.sha1(F.to_json("raw")))


def raw_dedup(bronze: DataFrame) -> DataFrame:
    """One row for each source and natural key, the first read, with the distinct queries in the order they brought it.

    Two aggregates that combine before the shuffle: a key that comes again and again stays one row.
    """
    keyed = bronze.where("raw is not null and is_variant_null(raw) = false").withColumn("raw_key", raw_key())
    queries = keyed.groupBy("source", "raw_key", "query").agg(F.min("pos").alias("pos"))
    queries = queries.groupBy("source", "raw_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "query"))), lambda x: x["query"]).alias("matched_queries"))
    first = keyed.groupBy("source", "raw_key").agg(F.min_by(F.to_json("raw"), "pos").alias("json"), F.min("pos").alias("pos"))
    return first.join(queries, ["source", "raw_key"]).select("source", "raw_key", "pos", F.try_parse_json("json").alias("raw"), "matched_queries")


def normalize_source(raw: DataFrame, source: str, collected_at: Column) -> DataFrame:
    """Signals of one source from the rows of ``raw_dedup``; what is no object is left out."""
    f = SOURCES[source]()
    rows = raw.where((F.col("source") == source) & F.schema_of_variant("raw").startswith("OBJECT"))
    counts = [F.coalesce(f[c], F.lit(None)).cast("bigint").alias(c) if c in f else F.lit(None).cast("bigint").alias(c) for c in ("likes", "comments", "views", "score")]
    empty = F.lit("")
    rows = rows.select(
        F.lit(source).alias("source"), f["source_id"].alias("source_id"), F.coalesce(f["url"], empty).alias("url"), F.coalesce(f["author"], empty).alias("author"), f["published_at"].alias("published_at"),
        collected_at.alias("collected_at"), f["title"].alias("title"), T.clean_text(f["body"]).alias("text"), F.lit(source).alias("platform"), F.struct(*counts).alias("engagement"),
        f.get("subreddit", F.lit(None)).cast("string").alias("subreddit"), f.get("media", F.array().cast("array<string>")).alias("media"),
        F.coalesce(f.get("metadata", F.lit(None).cast("string")), F.lit("{}")).alias("metadata"), "matched_queries", "pos", T.clean_text(f["basis"]).alias("basis"),
    )
    return finished(rows)


def finished(rows: DataFrame) -> DataFrame:
    """Rows with url and basis (the cleaned text to compare) get canonical_url, normalized_text and content_hash."""
    rows = rows.withColumn("canonical_url", canonical_url(F.col("url"))).withColumn("normalized_text", T.dedup_text(F.col("basis"))).drop("basis")
    return rows.withColumn("content_hash", S.content_hash(F.col("canonical_url"), F.col("normalized_text")))


def normalize(raw: DataFrame, collected_at: Column, sources: list[str] | None = None) -> DataFrame:
    """Signals of all known sources; rows of unknown ones are dropped."""
    parts = [normalize_source(raw, s, collected_at) for s in sources or SOURCES]
    return reduce(DataFrame.unionByName, parts)


def rejected(raw: DataFrame) -> DataFrame:
    """The rows that ``normalize`` leaves out, with the reason: the quarantine table."""
    known = F.col("source").isin(*SOURCES)
    reason = F.when(~known, "unknown source").when(F.col("raw").isNull() | ~F.schema_of_variant("raw").startswith("OBJECT"), "no object")
    return raw.withColumn("reason", reason).where("reason is not null")


def limited(bronze: DataFrame, limits: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """The first rows of each source and query; sources without a limit stay whole."""
    table = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)) if limits else None
    if table is None:
        return bronze
    n = F.row_number().over(W.partitionBy(*(by or ["source", "query"])).orderBy("pos"))
    return bronze.withColumn("n", n).where(F.coalesce(F.col("n") <= F.element_at(table, F.col("source")), F.lit(True))).drop("n")
