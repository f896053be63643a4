"""RSS and Atom files -> feed items (the input of the two RSS normalizers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodmill.functions.text import first_non_empty, strip_space
from moodmill.schemas import S, struct

ITEM_COLUMNS = ("feed_url", "feed_title", "guid", "link", "title", "description", "published", "ordinal")

_GUID = T.StructType([T.StructField("_VALUE", S), T.StructField("_isPermaLink", S)])
_CHANNEL = struct(
    title=S,
    item=T.ArrayType(struct(title=S, link=S, description=S, guid=_GUID, pubDate=S)),
)
_LINK = T.StructType([T.StructField("_href", S), T.StructField("_rel", S)])
_FEED = struct(
    title=S,
    entry=T.ArrayType(struct(id=S, title=S, summary=S, published=S, updated=S, link=T.ArrayType(_LINK))),
)


def parse_feed_date(text: Column) -> Column:
    """RFC 822 or RFC 3339 text to timestamp, NULL when neither."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]+,\s*", ""), r"\s*(GMT|UTC|UT|Z)\s*$", " +0000")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text)
    )


def read_rss(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Items of RSS 2.0 files; the file path stands for the feed's address."""
    channels = (
        spark.read.format("xml").option("rowTag", "channel").schema(_CHANNEL).load(paths)
        .withColumn("feed_url", F.col("_metadata.file_path"))
    )
    items = channels.select("feed_url", F.col("title").alias("feed_title"), F.posexplode("item").alias("ordinal", "i"))
    return items.select(
        "feed_url",
        strip_space(first_non_empty("feed_title")).alias("feed_title"),
        strip_space(first_non_empty("i.guid._VALUE")).alias("guid"),
        strip_space(first_non_empty("i.link")).alias("link"),
        first_non_empty("i.title").alias("title"),
        first_non_empty("i.description").alias("description"),
        parse_feed_date(F.col("i.pubDate")).alias("published"),
        "ordinal",
    )


def read_atom(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of Atom files."""
    feeds = (
        spark.read.format("xml").option("rowTag", "feed").schema(_FEED).load(paths)
        .withColumn("feed_url", F.col("_metadata.file_path"))
    )
    entries = feeds.select("feed_url", F.col("title").alias("feed_title"), F.posexplode("entry").alias("ordinal", "e"))
    alternate = F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return entries.select(
        "feed_url",
        strip_space(first_non_empty("feed_title")).alias("feed_title"),
        strip_space(first_non_empty("e.id")).alias("guid"),
        first_non_empty(F.try_element_at(alternate, F.lit(1))["_href"]).alias("link"),
        first_non_empty("e.title").alias("title"),
        first_non_empty("e.summary").alias("description"),
        parse_feed_date(first_non_empty("e.published", "e.updated")).alias("published"),
        "ordinal",
    )
