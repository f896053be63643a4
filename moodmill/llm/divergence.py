"""Operator 13: how the sources of a language differ, by bitmaps of terms that share a count.

A pair's value sums f(p, q) over all kept terms, and f depends on the two counts of a
term only. So the terms of a (group, count) are one bitset, cut into words of 64 term
ids: the popcount of the AND of two bitsets is the number of terms with that pair of
counts. Terms a group lacks are the complement: with f00, f(p, 0) and f(0, q) for the
missing sides,

    value = V f00 + sum |B_c| (f(c, 0) - f00) + sum |B_d| (f(0, d) - f00)
          + sum |B_c AND B_d| (f(c, d) - f(c, 0) - f(0, d) + f00)

over counts c, d above zero. Ids follow the language's counts, so rare terms, most of
all, share words with few counts. Each word of ids is met once, by one task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodmill.llm.common import bounded_batches, stored

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
# Different (group, count) levels that are met in one step, by rows and by columns.
LEVELS = 1024
# Distinct terms a task holds before it hands its counts on.
HELD_TERMS = 400_000
# Groups up to this number are sent to every task.
FEW_GROUPS = 20_000

TERM = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def batch_of(group: tuple[str, str], n: Counter, docs: Counter) -> pa.RecordBatch:
        size = len(n) + 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([group[0]] * size), pa.array([group[1]] * size),
                pa.array([None, *n], pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )

    for batch in batches:
        groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        for group, text in zip(groups, batch.column(2).cast(pa.large_binary()), strict=True):
            n, docs = counts[group]
            terms = text.as_py().translate(TERM).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) + 1 for n, _ in counts.values()) > HELD_TERMS:
            for group, (n, docs) in counts.items():
                yield batch_of(group, n, docs)
            counts.clear()
    for group, (n, docs) in counts.items():
        yield batch_of(group, n, docs)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs (documents holding it); a null term for each group that occurs."""
    lacking = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*lacking).mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (n + 1) / (total + terms)); decimals, as the product may pass a long."""
    return F.when(
        total + terms > 0, F.lit(1) + F.call_function("div", F.lit(SCALE) * (n + 1).cast("decimal(28,0)"), (total + terms).cast("decimal(28,0)"))
    ).cast("long")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _cells(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the joint cells of the levels of ``a`` and ``b``, by pair of groups."""
    joint = np.zeros((len(a["p"]), len(b["p"])), dtype=np.int64)
    for x, y in zip(a["bits"].T, b["bits"].T, strict=True):
        joint += np.bitwise_count(x[:, None] & y[None, :])
    p, p0, q, q0 = a["p"][:, None], a["p0"][:, None], b["p"][None, :], b["p0"][None, :]
    joint *= _gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)
    rows, columns = (np.flatnonzero(np.diff(x["group"], prepend=-1)) for x in (a, b))
    sums = np.add.reduceat(np.add.reduceat(joint, rows, axis=0), columns, axis=1)
    left, right = a["group"][rows], b["group"][columns]
    return np.repeat(left, len(right)), np.tile(right, len(left)), sums.ravel()


def _levels(words: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One row a (group, count) with its bitset over all words, groups together."""
    cols = {n: np.concatenate([w[n] for w in words]) for n in words[0]}
    key = np.stack((cols["group"], cols["n"]))
    _, first, place = np.unique(key, axis=1, return_index=True, return_inverse=True)
    bits = np.zeros((len(first), len(words)), dtype=np.uint64)
    bits[place.ravel(), np.repeat(np.arange(len(words)), [len(w["n"]) for w in words])] = cols["bits"].view(np.uint64)
    return {n: cols[n][first] for n in ("group", "p", "p0")} | {"bits": bits}


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joint cells of every word; words in a row are met together while their levels are few."""

    def met(words: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        levels = _levels(words)
        tiles = [{n: c[k : k + LEVELS] for n, c in levels.items()} for k in range(0, len(levels["p"]), LEVELS)]
        for a in tiles:
            for b in tiles:
                left, right, value = _cells(a, b)
                keep = left != right
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left[keep]), pa.array(right[keep]), pa.array(value[keep])], ["left", "right", "value"]
                )

    held: list[dict[str, np.ndarray]] = []
    levels: set[tuple[int, int]] = set()
    rest: dict[str, np.ndarray] | None = None

    def add(word: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        here = set(zip(word["group"].tolist(), word["n"].tolist(), strict=True))
        if held and (held[0]["lang"][0] != word["lang"][0] or len(levels | here) > LEVELS):
            yield from met(held)
            held.clear()
            levels.clear()
        held.append(word)
        levels.update(here)

    for batch in batches:
        now = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        if rest is not None:
            now = {n: np.concatenate((rest[n], c)) for n, c in now.items()}
        cuts = np.flatnonzero((np.diff(now["lang"]) != 0) | (np.diff(now["word"]) != 0)) + 1
        edges = [0, *cuts.tolist()]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield from add({n: c[lo:hi] for n, c in now.items()})
        rest = {n: c[edges[-1] :] for n, c in now.items()}
    if rest is not None and len(rest["lang"]):
        yield from add(rest)
    if held:
        yield from met(held)


def source_divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from the others, and its own terms.

    Part ``pair`` has each other source of the language, by the sum of f over the
    kept terms; part ``term`` the ``top_terms`` terms that a group uses more than
    its language does. Nulls in text, lang and source count as ''. A group without
    terms has rows too; a language without kept terms has value 0 throughout, and
    a group alone in its language has no pairs. Repeated rows count each time,
    other columns are ignored, and an empty table gives no rows. Exact as long as
    a language keeps fewer than 10**9 terms.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = stored(term_counts(docs))
    kept = stored(
        counts.filter("term IS NOT NULL")
        .groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_docs).drop("docs")
        .repartitionByRange("lang", F.desc("lang_n"), "term").sortWithinPartitions("lang", F.desc("lang_n"), "term")
        .withColumn("id", F.monotonically_increasing_id())
    )
    cells = stored(counts.filter("n > 0").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "id"))

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = stored(
        counts.filter("term IS NULL").select("lang", "source")
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")))
        .withColumns({"p0": share(zero, F.col("total"), F.col("terms")), "group": F.monotonically_increasing_id()})
    )
    few = groups.count() <= FEW_GROUPS
    sized = F.broadcast(groups) if few else groups

    shares = cells.join(sized, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    bitsets = (
        shares.groupBy("lang", F.shiftright("id", 6).alias("word"), "group", "n", "p", "p0")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63).cast("int"))).alias("bits"))
    )
    # The language is a number from here on; equal words of two languages are told apart by it.
    numbers = stored(bitsets.select(F.xxhash64("lang").alias("lang"), "word", "group", "n", "p", "p0", "bits"))
    joint = (
        numbers.repartition("lang", "word").sortWithinPartitions("lang", "word", "group", "n")
        .mapInArrow(_pair_sums, "left long, right long, value long")
    )

    one = groups.select("lang", F.col("group").alias("left"), F.col("p0").alias("p0_left"), "terms")
    other = groups.select("lang", F.col("group").alias("right"), F.col("p0").alias("p0_right"))
    pairs = one.join(F.broadcast(other) if few else other, "lang").filter("left <> right")
    f00 = F.when(F.col("terms") > 0, gap(F.col("p0_left"), F.col("p0_right"))).otherwise(0)
    base = pairs.select("left", "right", (F.col("terms") * f00).alias("value"))
    # |B_c| of each level, by group and count over the whole language.
    sizes = stored(numbers.groupBy("group", "n", "p", "p0").agg(F.sum(F.bit_count("bits")).alias("size")))
    levels = sizes.select(F.col("group").alias("left"), "p", "p0", "size")
    facing = pairs.select("left", "right", "p0_right")
    sided = levels.join(F.broadcast(facing) if few and facing.count() <= FEW_GROUPS else facing, "left")
    ahead = sided.select("left", "right", (F.col("size") * (gap(F.col("p"), F.col("p0_right")) - gap(F.col("p0"), F.col("p0_right")))).alias("value"))
    # The same levels as the right side: f(0, d) of every pair turned round.
    behind = sided.select(
        F.col("right").alias("left"), F.col("left").alias("right"),
        (F.col("size") * (gap(F.col("p0_right"), F.col("p")) - gap(F.col("p0_right"), F.col("p0")))).alias("value"),
    )
    summed = (
        base.union(ahead).union(behind).union(joint)
        .groupBy("left", "right").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    )
    named = groups.select("group", "lang", "source")
    named = F.broadcast(named) if few else named
    of_pairs = (
        summed.join(named.withColumnRenamed("group", "left"), "left")
        .join(named.select(F.col("group").alias("right"), F.col("source").alias("item")), "right")
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        .withColumn("rank", _rank())
    )
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    of_terms = (
        shares.withColumn("q", q).filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", _rank()).filter(F.col("rank") <= top_terms)
    )
    return of_pairs.unionByName(of_terms)


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def divergence_sql(min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> str:
    """The same rows in DuckDB SQL, pair by pair and term by term."""
    share_of = f"1 + ({SCALE}::HUGEINT * ({{n}} + 1)) // ({{total}} + terms)"
    return rf"""
    WITH rows AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text,
            row_number() OVER () AS doc
        FROM documents
    ), words AS (
        SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows
    ), kept AS (
        SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {min_docs}
    ), counts AS (
        SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
    ), langs AS (
        SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM kept GROUP BY lang
    ), totals AS (
        SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source
    ), groups AS (
        SELECT lang, source, coalesce(total, 0) AS total, coalesce(terms, 0) AS terms, coalesce(lang_total, 0) AS lang_total
        FROM (SELECT DISTINCT lang, source FROM rows) LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)
    ), shares AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
            {share_of.format(n="coalesce(c.n, 0)", total="total")} AS p, {share_of.format(n="lang_n", total="lang_total")} AS q
        FROM groups g JOIN kept k ON k.lang = g.lang
        LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), all_pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    ), terms AS (
        SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
    )
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
    WHERE part = 'pair' OR rank <= {top_terms}
    """
