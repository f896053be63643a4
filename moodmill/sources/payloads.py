"""Landed search responses of each platform -> the unified document table.

Input frames hold one raw JSON response per row in ``payload``. Every function
returns the SOURCED columns plus ``ordinal``, the item's position in its
response. A response that is not the expected JSON yields no rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodmill.functions.hashing import doc_hash, search_hash
from moodmill.functions.text import (
    first_non_empty,
    is_blank,
    join_non_empty,
    strip_html,
    strip_space,
)
from moodmill.functions.times import now_literal, parse_seendate, parse_timestamp, rfc3339
from moodmill.schemas import SOURCED, S, struct

COLUMNS = (*SOURCED.fieldNames(), "ordinal")


def _items(raw: DataFrame, payload: str, schema: T.StructType, array: str) -> DataFrame:
    """One row per element of an array inside the payload, with its position."""
    parsed = raw.select(F.from_json(payload, schema).alias("body"))
    return parsed.select("body", F.posexplode(f"body.{array}").alias("ordinal", "item"))


def _array_of(name: str, item: T.StructType) -> T.StructType:
    return struct(**{name: T.ArrayType(item)})


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _sourced(df: DataFrame, platform: str, **columns: Column) -> DataFrame:
    fields = {"language": F.lit(""), "url": F.lit(""), "author": F.lit(""), **columns}
    fields["platform"] = F.lit(platform)
    return df.select(
        *[fields[f.name].cast(f.dataType).alias(f.name) for f in SOURCED.fields], "ordinal"
    )


_HITS = _array_of(
    "hits",
    struct(objectID=S, title=S, story_text=S, comment_text=S, author=S, url=S, created_at=S),
)


def normalize_hackernews(raw: DataFrame, payload: str = "payload") -> DataFrame:
    items = _items(raw, payload, _HITS, "hits")
    body = first_non_empty("item.comment_text", "item.story_text", "item.title")
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), _text("item.objectID"))
    return _sourced(
        items.withColumn("_body", body).where(F.col("_body") != ""),
        "hackernews",
        doc_id=F.concat(F.lit("hn-"), _text("item.objectID")),
        text=strip_html("_body"),
        url=first_non_empty("item.url", page),
        author=_text("item.author"),
        posted_at=parse_timestamp("item.created_at"),
    )


_POSTS = _array_of(
    "posts",
    struct(uri=S, author=struct(did=S, handle=S), record=struct(text=S, createdAt=S)),
)


def normalize_bluesky(raw: DataFrame, payload: str = "payload") -> DataFrame:
    items = _items(raw, payload, _POSTS, "posts").where(~is_blank("item.record.text"))
    handle, uri = _text("item.author.handle"), _text("item.uri")
    return _sourced(
        items,
        "bluesky",
        doc_id=F.concat(F.lit("bluesky-"), F.regexp_replace(uri, "^at://", "")),
        text=strip_space("item.record.text"),
        url=F.concat(
            F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), F.substring_index(uri, "/", -1)
        ),
        author=handle,
        posted_at=parse_timestamp("item.record.createdAt"),
    )


_ARTICLES = _array_of("articles", struct(url=S, title=S, seendate=S, domain=S))


def normalize_gdelt(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Headlines only: article bodies are never part of a row."""
    items = _items(raw, payload, _ARTICLES, "articles").where(~is_blank("item.title"))
    return _sourced(
        items,
        "gdelt",
        doc_id=F.concat(F.lit("gdelt-"), search_hash(_text("item.url"))),
        text=strip_space("item.title"),
        url=_text("item.url"),
        author=_text("item.domain"),
        posted_at=parse_seendate("item.seendate"),
    )


def normalize_gdelt_harvest(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Corpus rows of the same response."""
    items = _items(raw, payload, _ARTICLES, "articles").where(~is_blank("item.title"))
    return items.select(
        F.lit("gdelt").alias("platform"),
        doc_hash(_text("item.url")).alias("doc_id"),
        _text("item.domain").alias("author"),
        strip_space("item.title").alias("text"),
        F.coalesce(rfc3339(parse_seendate("item.seendate")), F.lit("")).alias("created_at"),
    )


_LISTING = struct(
    data=_array_of(
        "children",
        struct(
            kind=S,
            data=struct(
                id=S, subreddit=S, author=S, title=S, selftext=S, permalink=S,
                created_utc=T.DoubleType(),
            ),
        ),
    )
)


def normalize_reddit(raw: DataFrame, payload: str = "payload") -> DataFrame:
    items = _items(raw, payload, _LISTING, "data.children")
    own = _text("item.data.selftext")
    # A self text always follows a line break, even below an empty title.
    body = F.concat(
        strip_space(_text("item.data.title")),
        F.when(own != "", F.concat(F.lit("\n"), own)).otherwise(F.lit("")),
    )
    return _sourced(
        items.withColumn("_body", body).where(F.col("_body") != ""),
        "reddit",
        doc_id=F.concat(F.lit("reddit-"), _text("item.data.id")),
        text=F.col("_body"),
        url=F.concat(F.lit("https://www.reddit.com"), _text("item.data.permalink")),
        author=_text("item.data.author"),
        posted_at=F.timestamp_seconds(F.coalesce("item.data.created_utc", F.lit(0.0)).cast("long")),
    )


_MESSAGES = _array_of(
    "messages", struct(id=T.LongType(), body=S, created_at=S, user=struct(username=S))
)


def normalize_stocktwits(raw: DataFrame, payload: str = "payload") -> DataFrame:
    items = _items(raw, payload, _MESSAGES, "messages").where(_text("item.body") != "")
    user, number = _text("item.user.username"), F.col("item.id").cast("string")
    return _sourced(
        items,
        "stocktwits",
        doc_id=F.concat(F.lit("stocktwits-"), number),
        text=F.col("item.body"),
        url=F.concat(F.lit("https://stocktwits.com/"), user, F.lit("/message/"), number),
        author=user,
        posted_at=parse_timestamp("item.created_at"),
    )


_TWEETS = struct(
    data=T.ArrayType(struct(id=S, text=S, author_id=S, created_at=S, lang=S)),
    includes=_array_of("users", struct(id=S, username=S)),
)


def author_lookup(users: Column, author_id: Column) -> Column:
    """User name of an author id inside one response; '' when unknown."""
    matching = F.filter(users, lambda u: u["id"] == author_id)
    return F.coalesce(F.try_element_at(F.transform(matching, lambda u: u["username"]), F.lit(-1)), F.lit(""))


def normalize_twitter(raw: DataFrame, payload: str = "payload") -> DataFrame:
    items = _items(raw, payload, _TWEETS, "data").withColumn(
        "_user", author_lookup(F.col("body.includes.users"), F.col("item.author_id"))
    )
    return _sourced(
        items,
        "twitter",
        doc_id=F.concat(F.lit("twitter-"), _text("item.id")),
        text=_text("item.text"),
        language=_text("item.lang"),
        url=F.concat(F.lit("https://twitter.com/"), F.col("_user"), F.lit("/status/"), _text("item.id")),
        author=F.col("_user"),
        posted_at=parse_timestamp("item.created_at"),
    )


_STATUSES = _array_of(
    "statuses", struct(id=S, content=S, url=S, created_at=S, account=struct(username=S))
)


def normalize_mastodon(raw: DataFrame, payload: str = "payload", since_seconds: int = 0,
                       now: dt.datetime | str | None = None) -> DataFrame:
    items = _items(raw, payload, _STATUSES, "statuses")
    docs = _sourced(
        items,
        "mastodon",
        doc_id=F.concat(F.lit("mastodon-"), _text("item.id")),
        text=strip_html(_text("item.content")),
        url=_text("item.url"),
        author=_text("item.account.username"),
        posted_at=parse_timestamp("item.created_at"),
    ).where(F.col("text") != "")
    if since_seconds > 0 and now is not None:
        cutoff = now_literal(now) - F.make_dt_interval(secs=F.lit(since_seconds))
        docs = docs.where(F.col("posted_at") >= cutoff)
    return docs


_VIDEOS = _array_of(
    "items",
    struct(
        id=struct(videoId=S),
        snippet=struct(title=S, description=S, channelTitle=S, publishedAt=S),
    ),
)


def normalize_youtube(raw: DataFrame, payload: str = "payload") -> DataFrame:
    items = _items(raw, payload, _VIDEOS, "items")
    about = _text("item.snippet.description")
    video = _text("item.id.videoId")
    return _sourced(
        items,
        "youtube",
        doc_id=F.concat(F.lit("youtube-"), video),
        text=F.concat(
            _text("item.snippet.title"),
            F.when(about != "", F.concat(F.lit("\n"), about)).otherwise(F.lit("")),
        ),
        url=F.concat(F.lit("https://www.youtube.com/watch?v="), video),
        author=_text("item.snippet.channelTitle"),
        posted_at=parse_timestamp("item.snippet.publishedAt"),
    )


def normalize_rss(items: DataFrame, loaded_at: dt.datetime | str) -> DataFrame:
    """Feed items as the search path sees them: the description, or the title
    where it is empty. Items without a date count as posted when loaded."""
    key = F.concat_ws("|", _text("feed_url"), _text("guid"), _text("link"))
    ordinal = F.col("ordinal") if "ordinal" in items.columns else F.lit(0)
    return _sourced(
        items.withColumn("ordinal", ordinal),
        "rss",
        doc_id=F.concat(F.lit("rss-"), search_hash(key)),
        text=first_non_empty(strip_html(_text("description")), _text("title")),
        url=_text("link"),
        author=_text("feed_title"),
        posted_at=F.coalesce("published", now_literal(loaded_at)),
    )


def normalize_rss_harvest(items: DataFrame) -> DataFrame:
    """Feed items as corpus rows: title, line break, description."""
    text = join_non_empty("\n", strip_space(_text("title")), strip_html(_text("description")))
    return items.select(
        F.lit("rss").alias("platform"),
        first_non_empty("guid", doc_hash(_text("link"))).alias("doc_id"),
        _text("feed_title").alias("author"),
        text.alias("text"),
        F.coalesce(rfc3339("published"), F.lit("")).alias("created_at"),
    ).where(F.col("text") != "")


NORMALIZERS = {
    "bluesky": normalize_bluesky,
    "gdelt": normalize_gdelt,
    "hackernews": normalize_hackernews,
    "mastodon": normalize_mastodon,
    "reddit": normalize_reddit,
    "stocktwits": normalize_stocktwits,
    "twitter": normalize_twitter,
    "youtube": normalize_youtube,
}


def landed_outcomes(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Per platform: did its landed responses parse, and how many were there.
    Needs columns ``platform`` and ``payload``; a response that is not a JSON
    object is a failure of its source."""
    good = F.coalesce(F.json_object_keys(payload).isNotNull(), F.lit(False))
    return raw.groupBy("platform").agg(
        F.when(F.count_if(good) > 0, F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.count_if(good).alias("docs"),
        F.when(F.count_if(good) == 0, F.lit("unexpected response")).alias("error"),
        F.lit(None).cast("long").alias("latency_ms"),
    )
