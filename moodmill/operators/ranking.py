"""Per-platform limits, request positions and length-ordered batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodmill.functions.hashing import UNIT_SEPARATOR, order_hash

# The most one live search of each source returns. They mean
# nothing for landed documents and apply only where a caller passes them.
SOURCE_CAPS = {
    "hackernews": 100, "bluesky": 100, "gdelt": 250, "reddit": 100, "twitter": 100,
    "mastodon": 40, "youtube": 50, "stocktwits": 30,
}

# Texts longer than this make a full batch too large for a model's memory.
LONG_TEXT = 1200


def newest_first(posted_at: str = "posted_at") -> list[Column]:
    return [F.col(posted_at).desc_nulls_last(), F.col("doc_id")]


def limit_per_platform(df: DataFrame, limit: int | None = None,
                       caps: Mapping[str, int] | None = None,
                       order: Sequence[Column] | None = None) -> DataFrame:
    """The first rows of each platform, up to the request limit or the source's
    own cap; all rows if neither is given. Spark keeps at most that many rows per
    task before the shuffle."""
    if limit is None and not caps:
        return df
    if limit is not None and limit <= 0:
        raise ValueError(f"limit must be positive, not {limit}")
    caps = caps or {}
    rank = F.row_number().over(
        Window.partitionBy("platform").orderBy(*(order or newest_first()))
    )
    allowed = F.lit(limit).cast("int")
    for platform, cap in caps.items():
        if limit is None or cap < limit:
            allowed = F.when(F.col("platform") == platform, F.lit(cap)).otherwise(allowed)
    ranked = df.withColumn("_rank", rank)
    # The plain comparison lets the planner push a group limit below the
    # shuffle; the per-source caps then only trim what is left.
    if limit is not None:
        ranked = ranked.where(F.col("_rank") <= limit)
    return ranked.where(allowed.isNull() | (F.col("_rank") <= allowed)).drop("_rank")


def with_index(df: DataFrame, items: str, index: str = "index") -> DataFrame:
    """Explode an array column, keeping each element's position."""
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, F.posexplode(items).alias(index, items))


def platform_order(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Export order: platform id, then source order."""
    return df.orderBy("platform", ordinal)


def length_rank(df: DataFrame, keys: Sequence[str] = ("platform", "doc_id"), text: str = "text",
                rank: str = "rank") -> DataFrame:
    """Exact global 1-based rank by ascending text length, hash order within a
    length, without a global sort.

    Rows are grouped by (length, three hash digits), so even a single length
    shared by a third of the input spreads over 4096 groups; a group's offset
    comes from the group counts.
    """
    group = ["_length", "_slice"]
    keyed = df.withColumns(
        {"_length": F.coalesce(F.length(text), F.lit(0)), "_hash": order_hash(UNIT_SEPARATOR, *keys)}
    ).withColumn("_slice", F.substring("_hash", 1, 3))
    counts = keyed.groupBy(*group).agg(F.count("*").alias("_rows"))
    within_length = counts.withColumn(
        "_before", F.sum("_rows").over(Window.partitionBy("_length").orderBy("_slice")) - F.col("_rows")
    )
    # One task, but over one row per distinct length.
    lengths = counts.groupBy("_length").agg(F.sum("_rows").alias("_rows"))
    shorter = lengths.select(
        "_length", (F.sum("_rows").over(Window.orderBy("_length")) - F.col("_rows")).alias("_shorter")
    )
    offsets = within_length.join(shorter, "_length").select(
        *group, (F.col("_shorter") + F.col("_before")).alias("_offset")
    )
    position = F.row_number().over(Window.partitionBy(*group).orderBy("_hash", *keys))
    ranked = keyed.join(offsets, group).withColumn(rank, F.col("_offset") + position)
    return ranked.select(*df.columns, rank)


def length_order_batches(df: DataFrame, max_batch: int = 32, flush_every: int | None = None,
                         keys: Sequence[str] = ("platform", "doc_id"), text: str = "text",
                         long_text: int = LONG_TEXT) -> DataFrame:
    """Assign rows to batches of similar length.

    Batches hold up to ``max_batch`` rows in length order, restarting at every
    ``flush_every`` rows; one that contains a text over ``long_text`` characters
    is cut in half. Adds flush_id, batch_id and half.
    """
    ranked = length_rank(df, keys, text, "_rank")
    position = F.col("_rank") - 1
    flush_id = F.floor(position / flush_every) if flush_every else F.lit(0)
    inside = position - (flush_id * flush_every if flush_every else F.lit(0))
    batched = ranked.withColumns(
        {
            "flush_id": flush_id.cast("long"),
            "batch_id": F.floor(inside / max_batch).cast("long"),
            "_slot": (inside % max_batch).cast("long"),
        }
    )
    batch = Window.partitionBy("flush_id", "batch_id")
    n = F.count("*").over(batch)
    longest = F.max(F.length(text)).over(batch)
    half = F.when(
        (longest > long_text) & (n > 1) & (F.col("_slot") >= F.floor(n / 2)), F.lit(1)
    ).otherwise(F.lit(0))
    return batched.withColumn("half", half).drop("_rank", "_slot")


def batch_padding_cost(batched: DataFrame, text: str = "text") -> DataFrame:
    """Per batch: rows, longest text, characters with and without padding."""
    n_chars = F.length(text)
    return batched.groupBy("flush_id", "batch_id", "half").agg(
        F.count("*").alias("rows"),
        F.max(n_chars).alias("longest"),
        F.sum(n_chars).alias("real_chars"),
        (F.count("*") * F.max(n_chars)).alias("padded_chars"),
    )
