"""Export queries: the rows and lines that are written, read back as columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from moodmill.catalog.registry import query
from moodmill.catalog.tables import (
    BACKEND,
    CORPUS,
    NOW,
    PLATFORMED,
    aggregate_sql,
    by_real_platform,
    corpus,
    longs,
    scored_sql,
    table,
    with_,
)
from moodmill.operators.platforms import platform_table
from moodmill.plans.topic import analyze_text, analyze_topic
from moodmill.session import checkpoint_dir
from moodmill.sinks import corpus as sink
from moodmill.sinks import export as X
from moodmill.sources.corpus import read_documents

_FLOATS = ("confidence", "polarity", "p_negative", "p_neutral", "p_positive")


def scratch(spark, name: str) -> str:
    """A fresh folder every executor can reach; Spark creates it on writing."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _inline(spark, d):
    return table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "text", (F.col("conv_id") * 100 + F.col("turn")).alias("index")
    )


_INLINE = "inline AS (SELECT conv_id || '-' || turn AS id, text, conv_id * 100 + turn AS index FROM conversations)"
_NUM = ", ".join(f"round({c}::FLOAT::DOUBLE, 5) AS {c}" for c in _FLOATS)


def _numbers(df):
    return df.withColumns({c: F.round(F.col(c).cast("float").cast("double"), 5) for c in _FLOATS})


@query(with_(_INLINE, scored_sql("inline"), f"SELECT index, label, {_NUM} FROM scored"))
def text_csv(spark, d):
    path = f"{scratch(spark, 'text-csv')}/out"
    X.export_text_csv(analyze_text(_inline(spark, d), backend=BACKEND).results, path, single_file=False)
    return _numbers(longs(spark.read.option("header", True).csv(path), "index"))


_TOPIC = [
    CORPUS,
    PLATFORMED,
    """
found AS (
  SELECT * FROM platformed WHERE contains(lower(text), 'que')
)""",
    scored_sql("found"),
]


def topic_analysis(spark, d, aspects=("la", "the")):
    return analyze_topic(
        by_real_platform(corpus(spark, d)), "que", platforms=platform_table(spark),
        aspects=aspects, backend=BACKEND, now=NOW,
    )


@query(
    with_(
        *_TOPIC,
        f"""SELECT platform, doc_id, strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, label, {_NUM}, text FROM scored""",
    )
)
def topic_csv(spark, d):
    path = f"{scratch(spark, 'topic-csv')}/out"
    X.export_topic_csv(topic_analysis(spark, d).results, path, single_file=False)
    read = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    return _numbers(read)


def _field(path: str) -> F.Column:
    return F.get_json_object("line", path)


@query(with_(_INLINE, scored_sql("inline"), "SELECT index, id, label, round(polarity::FLOAT::DOUBLE, 5) AS polarity FROM scored"))
def text_ndjson(spark, d):
    lines = X.text_result_objects(analyze_text(_inline(spark, d), backend=BACKEND, now=NOW).results)
    return longs(
        lines.select(
            "index", _field("$.id").alias("id"), _field("$.overall.label").alias("label"),
            F.round(_field("$.overall.polarity").cast("float").cast("double"), 5).alias("polarity"),
        ),
        "index",
    )


@query(
    with_(
        *_TOPIC,
        f"""totals AS (SELECT {aggregate_sql()} FROM scored)""",
        """SELECT 0::BIGINT AS ord, platform, doc_id, label, text, NULL::BIGINT AS sample_size FROM scored
UNION ALL SELECT 1, NULL, NULL, modal_label, NULL, sample_size FROM totals""",
    )
)
def topic_ndjson(spark, d):
    a = topic_analysis(spark, d)
    lines = X.topic_ndjson_lines(a.results, a.aggregate, a.aspect_scores)
    return longs(
        lines.select(
            "ord",
            _field("$.document.platform").alias("platform"),
            _field("$.document.document.id").alias("doc_id"),
            F.coalesce(_field("$.result.overall.label"), _field("$.aggregate.modal_label")).alias("label"),
            _field("$.document.document.text").alias("text"),
            _field("$.aggregate.sample_size").alias("sample_size"),
        ),
        "ord", "sample_size",
    )


@query(
    with_(
        *_TOPIC,
        """SELECT 'que' AS topic, (SELECT count(*) FROM scored) AS results,
  (SELECT count(DISTINCT platform) FROM scored) AS platforms, 2::BIGINT AS aspects, 'false' AS partial""",
    )
)
def analysis_json(spark, d):
    rows = X.analysis_envelope(topic_analysis(spark, d))
    value = lambda field: F.max(F.when(F.col("field") == field, F.col("value")))
    size = lambda field: F.size(F.json_object_keys(value(field))).cast("long")
    is_result = (F.col("field") == "results") & F.json_object_keys("value").isNotNull()
    return rows.agg(
        F.get_json_object(value("topic"), "$").alias("topic"), F.count_if(is_result).alias("results"),
        size("by_platform").alias("platforms"), size("by_aspect").alias("aspects"), value("partial").alias("partial"),
    )


@query(
    with_(
        *_TOPIC,
        "SELECT platform, count(*) AS sample_size FROM scored GROUP BY platform",
    )
)
def analysis_xml(spark, d):
    path = scratch(spark, "xml")
    X.export_analysis_xml(topic_analysis(spark, d), path)
    read = spark.read.format("xml").option("rowTag", "platform").schema(
        "_key string, mean_polarity double, modal_label string, sample_size long"
    ).load(f"{path}/by_platform")
    return read.select(F.col("_key").alias("platform"), "sample_size")


@query(
    with_(
        CORPUS,
        """SELECT platform, count(*) AS rows, min(content_sha256) AS first_sha, '2024-03-01' AS dt FROM corpus GROUP BY platform""",
    )
)
def write_corpus(spark, d):
    # Written twice as the same batch: the second run replaces the first.
    root = scratch(spark, "corpus")
    for _ in range(2):
        sink.write_corpus(corpus(spark, d).drop("content_sha256", "hash_version"), root, NOW, batch="once")
    return read_documents(spark, root).groupBy("platform").agg(
        F.count("*").alias("rows"), F.min("content_sha256").alias("first_sha"),
        F.min("dt").cast("string").alias("dt"),
    )
