"""The operators over the shared tables, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill.llm.common import table
from moodmill.llm.conversation import conversation_repair
from moodmill.llm.divergence import divergence_sql, source_divergence
from moodmill.llm.lm_scoring import lm_scores
from moodmill.llm.mixing import mixing_rates, quality_domains
from moodmill.llm.ngram_join import jaccard_components
from moodmill.llm.packing import pack_documents
from moodmill.llm.pii import find_pii
from moodmill.llm.quality_rules import quality_rules, quality_sql
from moodmill.llm.secret_scan import scan_secrets
from moodmill.llm.simhash import simhash_components
from moodmill.llm.token_counts import token_counts
from moodmill.llm.toxicity import toxicity
from moodmill.llm.vector_graph import nearest_neighbours

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Target shares of tokens by domain.
MIXTURE = {"clean": 0.87, "junk": 0.04, "toxic": 0.09}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")


SQL["op2_quality_rules"] = quality_sql()


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


@query
def op4_vector_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "redacted_text")


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = mixing_rates(docs, quality_domains(table(spark, sf_dir, "labels")), MIXTURE)
    return rated.select(
        "doc_id", "n_tokens", *(F.col("domain_posteriors")[i].alias(f"p_{d}") for i, d in enumerate(MIXTURE)), "rate"
    )


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("found")


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(table(spark, sf_dir, "conversations"))


@query
def op12_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL["op13_source_divergence"] = divergence_sql()
