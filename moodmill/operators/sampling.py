"""Deterministic caps, tails, shuffles and reservoirs.

A cap orders by md5 of the row key. Sorting the whole input for it, or letting
one task hold the kept rows, does not scale, so the cap is turned into a plain
filter: count rows per md5 prefix, find the prefix the n-th row falls into, sort
only that prefix's keys to get the n-th key, and keep what is not above it. The
two helper passes read key columns only, and the filter runs before any shuffle
the caller adds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from moodmill.functions.hashing import UNIT_SEPARATOR, order_hash
from moodmill.session import local_table

# 16**5 prefixes: a bound on the histogram, whatever the input holds. The
# prefix holding the n-th row has about a millionth of the input.
PREFIX_DIGITS = 5

PLATFORM_DOC = ("platform", "doc_id")


def _ordered_key(keys: Sequence[str], ties: Sequence[str], separator: str) -> Column:
    return F.struct(order_hash(separator, *keys).alias("h"), *[F.col(c) for c in (*keys, *ties)])


def hash_cut(df: DataFrame, n: int, keys: Sequence[str] = PLATFORM_DOC,
             separator: str = UNIT_SEPARATOR, ties: Sequence[str] = ()) -> Row | None:
    """Key of the n-th row in hash order, or None if there are at most n rows."""
    keyed = df.select(_ordered_key(keys, ties, separator).alias("k"))
    prefix = F.substring("k.h", 1, PREFIX_DIGITS)
    counts = keyed.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("rows"))
    # One task, but over at most 16**5 counts.
    running = counts.withColumn("upto", F.sum("rows").over(Window.orderBy("prefix")))
    found = running.agg(
        F.sum("rows").alias("total"),
        F.min(F.when(F.col("upto") >= n, F.struct("prefix", "upto", "rows"))).alias("at"),
    ).first()
    if found["total"] is None or found["total"] <= n:
        return None
    at = found["at"]
    inside = n - (at["upto"] - at["rows"])
    return (
        keyed.where(prefix == at["prefix"]).orderBy("k").limit(inside).agg(F.max("k").alias("k")).first()["k"]
    )


def at_or_below(cut: Row, keys: Sequence[str], ties: Sequence[str], separator: str) -> Column:
    literal = F.struct(F.lit(cut["h"]), *[F.lit(cut[c]) for c in (*keys, *ties)])
    return _ordered_key(keys, ties, separator) <= literal


def hash_cap(df: DataFrame, n: int, keys: Sequence[str] = PLATFORM_DOC,
             separator: str = UNIT_SEPARATOR, ties: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in md5 order of ``keys``. Keys plus ``ties`` must
    identify a row."""
    if n <= 0:
        return df.limit(0)
    cut = hash_cut(df, n, keys, separator, ties)
    return df if cut is None else df.where(at_or_below(cut, keys, ties, separator))


def split_tail(df: DataFrame, n: int, keys: Sequence[str] = PLATFORM_DOC,
               separator: str = UNIT_SEPARATOR, ties: Sequence[str] = (),
               total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(head, tail): the last ``n`` rows in md5 order are the tail."""
    total = df.count() if total is None else total
    if n <= 0:
        return df, df.limit(0)
    if n >= total:
        return df.limit(0), df
    cut = hash_cut(df, total - n, keys, separator, ties)
    head = at_or_below(cut, keys, ties, separator)
    return df.where(head), df.where(~head)


# Hold-out ceilings and the smallest labelled set worth training on.
HOLDOUT_ROWS, MIN_LABELED_ROWS, HOLDOUT_PAIRS = 5_000, 2_500, 2_000


def holdout_rows(n_labeled: int, ceiling: int = HOLDOUT_ROWS, floor: int = MIN_LABELED_ROWS) -> int:
    """A fifth of the rows up to a ceiling; too few rows is an error."""
    if n_labeled < floor:
        raise RuntimeError(f"only {n_labeled} labeled rows; need at least {floor}")
    return min(ceiling, n_labeled // 5)


def holdout_pairs(n_pairs: int, ceiling: int = HOLDOUT_PAIRS) -> int:
    return min(ceiling, n_pairs // 5)


def seeded_order(seed: int, *keys: str, separator: str = UNIT_SEPARATOR) -> Column:
    """Sort key of a reproducible shuffle."""
    return order_hash(separator, F.lit(str(seed)), *keys)


def seeded_shuffle(df: DataFrame, seed: int, keys: Sequence[str] = PLATFORM_DOC) -> DataFrame:
    """All rows in a reproducible pseudo-random order (a range-partitioned sort)."""
    return df.orderBy(seeded_order(seed, *keys), *keys)


def seeded_budget(df: DataFrame, n: int, seed: int, keys: Sequence[str] = PLATFORM_DOC) -> DataFrame:
    """The first ``n`` rows of that shuffle, found without sorting."""
    return hash_cap(df.withColumn("_seed", F.lit(str(seed))), n, ("_seed", *keys)).drop("_seed")


# Cuts of up to so many strata become a local table, which the planner broadcasts by its size; more are joined as they are.
LOCAL_STRATA = 10_000


def reservoir_level(sizes: DataFrame, n: int) -> tuple[int, int]:
    """(level, extra): each stratum gives up to ``level`` rows and ``extra`` of the larger ones give one more.

    ``sizes`` has one total per stratum. Together they give ``n`` rows, or all there are.
    """
    # One task, but over at most one row per distinct size.
    by_size = Window.orderBy("total").rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        sizes.groupBy("total").agg(F.count("*").alias("strata"))
        .withColumn("below", F.coalesce(F.sum(F.col("total") * F.col("strata")).over(by_size), F.lit(0)))
        .withColumn("passed", F.coalesce(F.sum("strata").over(by_size), F.lit(0)))
        .crossJoin(sizes.agg(F.count("*").alias("all")))
        .withColumn("open", F.col("all") - F.col("passed"))
    )
    # The first size at which the reservoir would be full.
    full = steps.where(F.col("below") + F.col("total") * F.col("open") >= n).orderBy("total").first()
    if full is None:
        return max((steps.agg(F.max("total")).first()[0] or 0), 0), 0
    return divmod(n - full["below"], full["open"])


def stratified_reservoir(df: DataFrame, n: int, stratum: str, keys: Sequence[str] = PLATFORM_DOC,
                         separator: str = UNIT_SEPARATOR, *, fill: bool = False) -> DataFrame:
    """``n`` rows spread evenly over the strata, first in hash order within each.

    With ``fill``, what a short stratum leaves goes to the others and a remainder
    to those first in the order of a hash of their name, so ``n`` rows come
    back while there are as many. Without, each stratum gives ``n // strata``
    rows (one at least) or all it has. A null stratum is one like
    others. The same cut as ``hash_cap``, found for all strata at once, so a
    stratum with most of the rows is never gathered anywhere.
    """
    if n <= 0:
        return df.limit(0)
    key = _ordered_key(keys, (), separator)
    # Strata as text beside a mark for null, so that equal joins take them all.
    name = F.struct(F.col(stratum).isNull().alias("no"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("of"))
    keyed = df.select(name.alias("s"), key.alias("k")).withColumn("prefix", F.substring("k.h", 1, PREFIX_DIGITS))
    counts = keyed.groupBy("s", "prefix").agg(F.count("*").alias("rows"))
    sizes = counts.groupBy("s").agg(F.sum("rows").alias("total"))
    level, extra = reservoir_level(sizes, n) if fill else (max(n // max(sizes.count(), 1), 1), 0)
    quotas = sizes.withColumn("quota", F.least(F.col("total"), F.lit(level)))
    if extra:
        larger = sizes.where(F.col("total") > level).orderBy(F.md5(F.to_json("s")), "s").limit(extra).select("s", F.lit(1).alias("more"))
        quotas = sizes.join(larger, "s", "left").withColumn(
            "quota", F.least(F.col("total"), F.lit(level) + F.coalesce("more", F.lit(0)))
        )
    quotas = quotas.where("quota > 0")
    running = counts.withColumn("upto", F.sum("rows").over(Window.partitionBy("s").orderBy("prefix")))
    at = (
        running.join(quotas, "s").where(F.col("upto") >= F.col("quota")).groupBy("s")
        .agg(F.min(F.struct("prefix", "upto", "rows", "quota")).alias("at"))
        .select("s", "at.prefix", (F.col("at.quota") - (F.col("at.upto") - F.col("at.rows"))).alias("inside"))
    )
    # Only keys of one prefix per stratum are ranked.
    rank = F.row_number().over(Window.partitionBy("s").orderBy("k"))
    edge = keyed.join(at, ["s", "prefix"]).withColumn("_rank", rank).where(F.col("_rank") <= F.col("inside"))
    cuts = edge.groupBy("s").agg(F.max("k").alias("_cut")).select(F.col("s").alias("_stratum"), "_cut")
    few = [tuple(r.asDict(recursive=True).values()) for r in cuts.limit(LOCAL_STRATA + 1).collect()]
    if len(few) <= LOCAL_STRATA:
        cuts = local_table(df.sparkSession, few, cuts.schema)
    named = df.withColumn("_stratum", name)
    return named.join(cuts, "_stratum").where(key <= F.col("_cut")).select(*[named[c] for c in df.columns])
