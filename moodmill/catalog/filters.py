"""Filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.catalog.registry import query
from moodmill.catalog.tables import (
    CORPUS,
    NOW,
    PLATFORMED,
    TEACHER,
    by_real_platform,
    corpus,
    longs,
    soft_labels,
    table,
    with_,
)
from moodmill.functions import text as X
from moodmill.operators import filters as flt
from moodmill.operators import platforms as plat
from moodmill.operators.platforms import PLATFORMS, platform_table, select_platforms

_IDS = "SELECT platform, doc_id FROM corpus WHERE "


def _ids(df):
    return df.select("platform", "doc_id")


@query(with_(CORPUS, _IDS + "length(text) BETWEEN 40 AND 2000"))
def length_between(spark, d):
    return _ids(flt.length_between(corpus(spark, d)))


@query(with_(CORPUS, _IDS + "strlen(text) BETWEEN 500 AND 3000"))
def bytes_between(spark, d):
    return _ids(flt.bytes_between(corpus(spark, d), 500, 3000))


@query(with_(CORPUS, _IDS + "split_part(lower(language || '-X'), '-', 1) IN ('en', 'fr')"))
def lang_allow(spark, d):
    tagged = corpus(spark, d).withColumn("langs", F.transform("langs", lambda t: F.concat(t, F.lit("-X"))))
    return _ids(flt.lang_allow(tagged, ["EN", "fr"]))


@query(
    with_(
        CORPUS,
        _IDS + "('0x' || substr(sha256(doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 < 0.2",
    )
)
def hash_sample(spark, d):
    return _ids(flt.hash_sample(corpus(spark, d), 0.2))


@query(with_(CORPUS, _IDS + "contains(lower(text), 'que')"))
def topic_match(spark, d):
    return _ids(flt.topic_match(corpus(spark, d), "Que"))


@query(with_(CORPUS, _IDS + "contains(lower(language || ' ' || text), 'que') AND contains(lower(language || ' ' || text), 'fr la')"))
def location_match(spark, d):
    found = flt.topic_match(corpus(spark, d), "QUE", "language", "text")
    return _ids(flt.location_match(found, ' "FR La" ', "language", "text"))


@query(
    with_(
        CORPUS,
        "SELECT platform, doc_id FROM corpus WHERE n % 9 = 0 "
        "OR posted_at >= TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 30 DAY",
    )
)
def posted_since(spark, d):
    # Every ninth document has no time and is kept.
    number = F.substring("doc_id", 3, 20).cast("long")
    docs = corpus(spark, d).withColumn("posted_at", F.when(number % 9 != 0, F.col("posted_at")))
    return _ids(flt.since(docs, 30 * 24 * 3600, NOW))


@query(
    with_(
        CORPUS,
        PLATFORMED,
        "SELECT platform, count(*) AS rows FROM platformed WHERE platform IN ('bluesky', 'rss') GROUP BY platform",
    )
)
def select_wanted_platforms(spark, d):
    # 'reddit' is disabled and 'nowhere' unknown: both are skipped.
    usable = select_platforms(platform_table(spark, disabled=["reddit"]), [" Bluesky", "RSS", "reddit", "nowhere"])
    docs = by_real_platform(corpus(spark, d)).join(usable, "platform", "left_semi")
    return docs.groupBy("platform").agg(F.count("*").alias("rows"))


_DURABLE = ", ".join(f"'{p[0]}'" for p in PLATFORMS if p[2])


@query(with_(CORPUS, PLATFORMED, f"SELECT platform, doc_id FROM platformed WHERE platform IN ({_DURABLE})"))
def corpus_eligible(spark, d):
    return _ids(plat.corpus_eligible(by_real_platform(corpus(spark, d)), platform_table(spark)))


@query(
    with_(
        CORPUS,
        PLATFORMED,
        f"""SELECT platform, count(*) AS rows, min(CASE WHEN platform IN ({_DURABLE}) THEN 1 ELSE 0 END)::BIGINT AS durable
FROM platformed GROUP BY platform""",
    )
)
def platform_policy_join(spark, d):
    joined = plat.platform_policy_join(by_real_platform(corpus(spark, d)), platform_table(spark))
    return joined.groupBy("platform").agg(
        F.count("*").alias("rows"), F.min(F.col("durable").cast("long")).alias("durable")
    )


@query("SELECT doc_id::VARCHAR AS doc_id FROM documents WHERE doc_id % 5 <> 0")
def drop_blank_text(spark, d):
    # Every fifth text is replaced by white space of several kinds.
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(" \t\n ")).otherwise(F.col("text")).alias("text"),
    )
    return flt.drop_blank_text(docs).select("doc_id")


@query(with_(CORPUS, _IDS + "language = 'de'"))
def language_match(spark, d):
    return _ids(flt.language_match(corpus(spark, d), "de"))


@query(with_(CORPUS, _IDS + "language = 'fr'"))
def version_pin(spark, d):
    # French documents were labelled by this version, the others by an older one.
    docs = corpus(spark, d)
    french = docs.where("language = 'fr'")
    others = docs.where("language <> 'fr'")
    labels = soft_labels(french).unionByName(
        soft_labels(others).withColumn("teacher_version", F.lit("older"))
    )
    return _ids(flt.version_pin(labels, TEACHER))


_FIRST_WORD = "regexp_extract(text, '[A-Za-z]+')"


@query(
    f"""
SELECT doc_id, CASE WHEN length({_FIRST_WORD}) BETWEEN 1 AND 5 THEN upper({_FIRST_WORD}) ELSE '' END AS symbol
FROM documents"""
)
def extract_symbol(spark, d):
    topic = F.concat(F.lit("watching $"), F.regexp_extract("text", "[A-Za-z]+", 0), F.lit(", today"))
    return table(spark, d, "documents").select("doc_id", X.extract_symbol(topic).alias("symbol"))


@query(f"SELECT doc_id FROM documents WHERE upper({_FIRST_WORD}) = 'THE'")
def cashtag_match(spark, d):
    tagged = table(spark, d, "documents").withColumn(
        "text", F.concat(F.lit("$"), F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("!"))
    )
    return flt.cashtag_match(tagged, "news on $the").select("doc_id")


@query(with_(CORPUS, "SELECT platform, count(*) AS rows FROM corpus WHERE platform <> 'src3' GROUP BY platform"))
def purge_source(spark, d):
    return flt.purge_source(corpus(spark, d), "src3").groupBy("platform").agg(F.count("*").alias("rows"))


@query(with_(CORPUS, _IDS + "posted_at >= TIMESTAMP '2024-07-15 00:00:00' - INTERVAL 180 DAY"))
def expire_text(spark, d):
    return _ids(flt.expire_text(corpus(spark, d), "2024-07-15T00:00:00Z"))


# Places as users type them: a country's name, its ISO code, other case, a city.
_PLACES = ("germany", "DE", " France ", "fr", "GM", "Atlantis", "ivory coast", "us", "United States", "Austin")
_CODES = ("GM", "GM", "FR", "FR", "GA", None, "IV", "US", "US", None)


@query(
    "SELECT c_custkey::BIGINT AS c_custkey, (["
    + ", ".join("NULL" if c is None else f"'{c}'" for c in _CODES)
    + f"])[(c_custkey % {len(_CODES)})::INTEGER + 1] AS fips FROM customer"
)
def country_lookup(spark, d):
    places = F.array(*[F.lit(p) for p in _PLACES])
    customers = table(spark, d, "customer").select(
        "c_custkey", F.element_at(places, (F.col("c_custkey") % len(_PLACES)).cast("int") + 1).alias("location")
    )
    found = plat.country_lookup(customers, plat.country_table(spark))
    return longs(found.select("c_custkey", "fips"), "c_custkey")


