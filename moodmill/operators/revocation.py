"""Honouring deletions before anything reads the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A prolific author may own a large share of the corpus. Documents are spread
# over this many sub-keys per author and account tombstones repeated for each;
# AQE splits what is still uneven.
AUTHOR_SALTS = 16


def doc_tombstones(tombstones: DataFrame) -> DataFrame:
    return (
        tombstones.where((F.col("scope") == "doc") & F.col("doc_id").isNotNull())
        .select("platform", "doc_id").distinct()
    )


def account_tombstones(tombstones: DataFrame) -> DataFrame:
    return (
        tombstones.where((F.col("scope") == "account") & F.col("author_did").isNotNull())
        .select("platform", "author_did").distinct()
    )


def revoke_docs(docs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Drop documents whose own tombstone exists, on (platform, doc_id)."""
    return docs.join(doc_tombstones(tombstones), ["platform", "doc_id"], "left_anti")


def _author_key() -> Column:
    # Rows without an author can match nothing; a key of their own keeps them
    # from meeting in one partition.
    return F.coalesce(F.col("author_did"), F.concat(F.lit("\0"), F.col("doc_id")))


def _salted_accounts(tombstones: DataFrame, salts: int) -> DataFrame:
    return account_tombstones(tombstones).select(
        "platform",
        F.col("author_did").alias("_author"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )


def _salted_docs(docs: DataFrame, salts: int) -> DataFrame:
    return docs.withColumns(
        {
            "_author": _author_key(),
            "_salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"),
        }
    )


_ACCOUNT_KEY = ["platform", "_author", "_salt"]


def revoke_accounts(docs: DataFrame, tombstones: DataFrame, salts: int = AUTHOR_SALTS) -> DataFrame:
    """Drop every document of a revoked author, on (platform, author_did)."""
    alive = _salted_docs(docs, salts).join(
        _salted_accounts(tombstones, salts), _ACCOUNT_KEY, "left_anti"
    )
    return alive.select(*docs.columns)


def revoke(docs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Documents alive after both kinds of tombstone."""
    return revoke_accounts(revoke_docs(docs, tombstones), tombstones).select(*docs.columns)


def mark_revoked(docs: DataFrame, tombstones: DataFrame, flag: str = "revoked",
                 salts: int = AUTHOR_SALTS) -> DataFrame:
    """All documents, with a flag instead of a filter."""
    gone = lambda df, name: df.withColumn(name, F.lit(True))
    marked = docs.join(gone(doc_tombstones(tombstones), "_doc"), ["platform", "doc_id"], "left")
    marked = _salted_docs(marked, salts).join(
        gone(_salted_accounts(tombstones, salts), "_account"), _ACCOUNT_KEY, "left"
    )
    revoked = F.col("_doc").isNotNull() | F.col("_account").isNotNull()
    return marked.select(*docs.columns, revoked.alias(flag))
