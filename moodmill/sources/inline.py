"""Documents submitted inline, as JSON or XML request files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodmill.schemas import INLINE, B, S, struct

REQUEST = struct(documents=T.ArrayType(INLINE), include_aspects=B)


def _reject_unknown(payload, allowed: list[str], what: str):
    extra = F.array_except(F.json_object_keys(payload), F.array(*[F.lit(a) for a in allowed]))
    return F.when(
        F.size(extra) > 0,
        F.raise_error(F.concat(F.lit(f"unknown {what} field: "), F.array_join(extra, ", "))),
    )


def parse_requests(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Request bodies, one JSON object per row -> document rows with their
    position. Unknown fields are an error."""
    checked = raw.withColumn(
        "_bad", _reject_unknown(F.col(payload), REQUEST.fieldNames(), "request")
    )
    docs = checked.withColumn(
        "_docs", F.from_json(F.get_json_object(payload, "$.documents"), T.ArrayType(S))
    )
    bad_doc = F.exists(
        "_docs",
        lambda d: F.size(F.array_except(F.json_object_keys(d), F.array(*[F.lit(a) for a in INLINE.fieldNames()]))) > 0,
    )
    verdict = F.when(bad_doc, F.raise_error(F.lit("unknown document field")))
    return (
        docs.where(F.col("_bad").isNull() & verdict.isNull())
        .select(F.from_json(payload, REQUEST).alias("r"))
        .select("r.include_aspects", F.posexplode("r.documents").alias("index", "d"))
        .select("index", "include_aspects", "d.*")
    )


def read_inline_documents(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Rows (index, id, text, language, aspects, ...) of request files."""
    if kind == "json":
        bodies = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))
        return parse_requests(bodies)
    if kind != "xml":
        raise ValueError(f"unsupported request format: {kind}")
    schema = T.StructType(
        [
            T.StructField("include_aspects", B),
            T.StructField(
                "documents",
                struct(
                    document=T.ArrayType(
                        T.StructType(
                            [
                                T.StructField("_id", S),
                                T.StructField("_language", S),
                                T.StructField("text", S),
                                T.StructField("aspects", struct(aspect=T.ArrayType(S))),
                            ]
                        )
                    )
                ),
            ),
        ]
    )
    requests = spark.read.format("xml").option("rowTag", "analyze_text").schema(schema).load(path)
    return requests.select(
        "include_aspects", F.posexplode("documents.document").alias("index", "d")
    ).select(
        "index",
        "include_aspects",
        F.col("d._id").alias("id"),
        F.col("d.text").alias("text"),
        F.col("d._language").alias("language"),
        F.col("d.aspects.aspect").alias("aspects"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )
