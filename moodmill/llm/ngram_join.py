"""Operator 6: documents whose word 5-gram sets overlap enough, by T-occurrence search.

A document must share at least T of its n shingles with a partner. Shingles are
taken in the order of their hashes, and only the first n - T + c of a document
are listed: any partner then shares at least about c listed shingles with it.
That leaves few documents at all (``viable``). The smallest document of a list
is its hub, and the documents of all lists of one hub form its cell, so any two
linked documents meet in a cell. Within a cell, documents are first compared with
the hub; those not yet in its main group search all others by DivideSkip: short
inverted lists are merged and counted, the longest ones are only probed for the
candidates left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodmill.llm.common import (
    BROADCAST_IDS,
    LOWER,
    bounded_batches,
    byte_steps,
    gather,
    keyed_rows,
    mix,
    span_hashes,
    stored,
    text_buffer,
    word_spans,
)
from moodmill.llm.graph import components

WORDS = 5
SIMILARITY_PCT = 75
# Listed shingles beyond the least prefix, in hundredths of a set.
EXTRA_PCT = 10
# Shingles of the documents in one search task.
BLOCK_SHINGLES = 2_000_000
# Digests a task remembers so as to list equal sets once.
REMEMBERED = 1_000_000
# Weight of a probe against a step of a merge, as in the method's choice of the number of long lists.
PROBE_WEIGHT = 0.1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lower-cased.

    A text of fewer words has its whole sequence as its one shingle, a text of
    none an empty set.
    """
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    seed = np.uint64(0x2545F4914F6CDD1D)
    rolled = hashes[: max(0, len(hashes) - words + 1)] + seed
    for k in range(1, words):
        rolled = mix(rolled) + hashes[k : len(hashes) - words + 1 + k]
    rolled = mix(rolled)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= words:
            yield np.unique(rolled[lo : hi - words + 1])
        elif hi > lo:
            whole = np.array([hi - lo], dtype=np.uint64)
            for h in hashes[lo:hi]:
                whole = mix(whole) + h
            yield mix(whole)
        else:
            yield hashes[:0]


def least_overlap(n: int, pct: int) -> int:
    """Shingles that a set of n must share with any set that it is similar to."""
    return -(-n * pct // 100)


def listed(n: int, pct: int) -> int:
    """How many of n shingles are listed."""
    return min(n, n - least_overlap(n, pct) + max(1, -(-n * EXTRA_PCT // 100)))


def _lists(a: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in a]))).astype(np.int32)
    values = np.concatenate(a).view(np.int64) if a else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _prefixes(pct: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids = batch.column(0)
            for lo, hi in byte_steps(offsets):
                size, digests, prefixes = [], [], []
                part = ids.slice(lo, hi - lo)
                known = part.is_valid().to_numpy(zero_copy_only=False)
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                for usable, s in zip(known, sets, strict=True):
                    digest = blake2b(s.tobytes(), digest_size=16).digest()
                    fresh = usable and len(s) and digest not in seen
                    if fresh and len(seen) < REMEMBERED:
                        seen.add(digest)
                    size.append(len(s))
                    digests.append(digest)
                    prefixes.append(s[: listed(len(s), pct)] if fresh else s[:0])
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(size, pa.int64()), pa.array(digests, pa.binary()), _lists(prefixes)],
                    ["doc_id", "n_shingles", "digest", "prefix"],
                )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in byte_steps(offsets):
                sets = list(shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(sets)], ["node", "shingles"])

    return run


def divide_skip(
    nodes: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, pct: int, *, whole: bool
) -> list[tuple[int, int]]:
    """Links that join the groups of all similar pairs of a query (``asks``) and a listed set.

    Without ``whole``, queries are no members. With it, every row is both, and
    once one group holds most rows, its rows no longer ask: the others still ask
    them. Pairs of one group are passed over, so a group costs one link a row.
    """
    groups, links = groups.copy(), []
    listed_rows = np.arange(len(nodes)) if whole else np.flatnonzero(~asks)
    queries = np.flatnonzero(asks)
    if not len(listed_rows) or not len(queries):
        return []
    sizes = np.array([len(x) for x in sets])
    tokens = np.concatenate([sets[i] for i in listed_rows])
    owner = np.repeat(listed_rows, sizes[listed_rows])
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    probe = PROBE_WEIGHT * math.log2(max(2, len(listed_rows))) + 1
    main = None

    def settle() -> int | None:
        labels, counts = np.unique(groups, return_counts=True)
        return labels[counts.argmax()] if whole and counts.max() * 2 > len(groups) else None

    main = settle()
    for q in queries.tolist():
        if main is not None and groups[q] == main:
            continue
        mine, n = sets[q], int(sizes[q])
        need = least_overlap(n, pct)
        lo, hi = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
        held = hi > lo
        if held.sum() < need:
            continue
        lo, hi = lo[held], hi[held]
        by_length = np.argsort(hi - lo, kind="stable")
        n_long = min(need - 1, int(need / probe))
        short, long = by_length[: len(by_length) - n_long], by_length[len(by_length) - n_long :]
        merged = owner[gather(lo[short], (hi - lo)[short])]
        counts = np.bincount(merged, minlength=len(nodes))
        fits = (sizes * pct <= n * 100) & (n * pct <= sizes * 100) & (groups != groups[q])
        found = np.flatnonzero((counts >= need - n_long) & fits)
        if not len(found):
            continue
        shared = counts[found]
        for i in long.tolist():
            mates = owner[lo[i] : hi[i]]
            place = np.minimum(np.searchsorted(mates, found), len(mates) - 1)
            shared = shared + (mates[place] == found)
        similar = found[shared * 100 >= (n + sizes[found] - shared) * pct]
        for other in similar.tolist():
            if groups[other] != groups[q]:
                links.append((int(nodes[q]), int(nodes[other])))
                old, new = groups[other], groups[q]
                if main is not None and old == main:
                    old, new = new, old
                groups[groups == old] = new
        if main is None and len(similar):
            main = settle()
    return links


def _with_hub(nodes: np.ndarray, sets: list[np.ndarray], hub: int, pct: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Group labels after comparing each set with the hub's, and the links found."""
    groups, links = nodes.copy(), []
    at = np.flatnonzero(nodes == hub)
    if len(at):
        mine = sets[at[0]]
        for i, other in enumerate(sets):
            if nodes[i] != hub:
                place = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                shared = int((mine[place] == other).sum())
                if shared * 100 >= (len(mine) + len(other) - shared) * pct:
                    groups[i] = hub
                    links.append((int(nodes[i]), hub))
    return groups, links


def _read_cell(batches: Iterator[pa.RecordBatch]):
    nodes, labels, asks, hubs, sets = [], [], [], [], []
    for batch in batches:
        flat = batch.column("shingles")
        values = flat.values.to_numpy(zero_copy_only=False).view(np.uint64)
        offsets = flat.offsets.to_numpy()
        sets += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        for to, name in ((nodes, "node"), (labels, "part_of"), (asks, "asks"), (hubs, "hub")):
            to.append(batch.column(name).to_numpy(zero_copy_only=False))
    return np.concatenate(nodes), np.concatenate(labels), np.concatenate(asks), int(hubs[0][0]), sets


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _search_block(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, _, asks, hub, sets = _read_cell(batches)
        groups, links = _with_hub(nodes, sets, hub, pct)
        yield _pairs(links + divide_skip(nodes, groups, sets, np.ones(len(nodes), dtype=bool), pct, whole=True))

    return run


def _search_across(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, labels, asks, _, sets = _read_cell(batches)
        yield _pairs(divide_skip(nodes, labels, sets, asks, pct, whole=False))

    return run


def _needed(n: Column, pct: int) -> Column:
    """Listed shingles that a document of n shares with any partner at least.

    The partner's own list may be the shorter one, but of no fewer than pct of
    the shingles.
    """
    return F.greatest(F.lit(1), F.ceil(n * EXTRA_PCT * pct / 10000))


def _shared(posts: DataFrame) -> DataFrame:
    """Posts whose token occurs in several documents, with its smallest document as ``hub``."""
    token = Window.partitionBy("token")
    bounds = posts.withColumns({"hub": F.min("node").over(token), "top": F.max("node").over(token)})
    return bounds.filter("hub < top").drop("top")


def _cells(sets: DataFrame, pct: int) -> DataFrame:
    """(node, n, hub): in which cells each document has to be.

    Two linked documents share at least ``_needed`` listed shingles. Each leaves
    its smallest cells, as long as they hold less than half of that many of its
    shingles; so both still meet in one.
    """
    posts = sets.filter(F.size("prefix") > 0).select(
        F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("prefix").alias("token")
    )
    needed = _needed(F.col("n"), pct)
    hits = stored(_shared(posts).drop("hub"))
    viable = hits.groupBy("node", "n").count().filter(F.col("count") >= needed).select("node")
    cells = _shared(keyed_rows(hits, viable, "node", "left_semi").select("node", "n", "token")).groupBy("node", "n", "hub").agg(F.count(F.lit(1)).alias("k"))
    mine = Window.partitionBy("node")
    return (
        cells.withColumns({"total": F.sum("k").over(mine), "left": F.sum("k").over(mine.orderBy("k", "hub"))})
        .filter((F.col("total") >= needed) & (F.col("left") * 2 > needed - 1))
        .select("node", "n", "hub", "k")
    )


def _links(rows: DataFrame, cells: DataFrame, words: int, pct: int) -> DataFrame:
    """Links (a, b) that connect all similar documents, some through others.

    A cell of more shingles than a task should hold is dealt to blocks; the hub is
    in each. Then the documents of such cells that are not in their largest group
    ask the other blocks.
    """
    sizes = cells.groupBy("hub").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    blocks = F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int")
    placed = stored(
        cells.select("node", "hub").join(sizes.select("hub", blocks.alias("blocks")), "hub")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    nodes = placed.select(F.col("node").alias("doc_id")).distinct()
    full = (
        keyed_rows(rows, nodes, "doc_id", "left_semi").select("doc_id", "text")
        .mapInArrow(_full_sets(words), "node long, shingles array<long>").filter(F.size("shingles") > 0)
    )
    hub_too = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    near = placed.select("node", "hub", F.explode(hub_too).alias("block"))
    few = placed.count() <= BROADCAST_IDS
    own = F.col("node").alias("part_of")
    near = full.join(F.broadcast(near) if few else near, "node").select("node", own, "shingles", "hub", "block", F.lit(True).alias("asks"))
    found = stored(near.groupBy("hub", "block").applyInArrow(_search_block(pct), "a long, b long"))
    wide = placed.filter("blocks > 1")
    if wide.isEmpty():
        return found

    label = components(found)
    grouped = stored(
        wide.join(label, "node", "left").select("node", "hub", "blocks", "block", F.coalesce("component_id", "node").alias("part_of"))
    )
    largest = grouped.groupBy("hub", "part_of").count().groupBy("hub").agg(
        F.max_by("part_of", F.struct("count", "part_of")).alias("largest")
    )
    todo = grouped.join(largest, "hub")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    as_query = todo.filter("part_of <> largest").select("node", "part_of", "hub", every.alias("block"), F.col("block").alias("turn"), F.lit(True).alias("asks"))
    as_member = todo.select("node", "part_of", "hub", "block", every.alias("turn"), F.lit(False).alias("asks"))
    asked = as_query.select("hub", "block", "turn").distinct()
    both = as_member.join(asked, ["hub", "block", "turn"], "left_semi").unionByName(as_query.filter("block <> turn"))
    both = both.join(full, "node").select("node", "part_of", "shingles", "hub", "block", "turn", "asks")
    return found.union(both.groupBy("hub", "block", "turn").applyInArrow(_search_across(pct), "a long, b long"))


def jaccard_components(
    docs: DataFrame, *, words: int = WORDS, similarity_pct: int = SIMILARITY_PCT, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; two documents link from ``similarity_pct`` on.

    Sets are compared by 64-bit hashes of their shingles. Null and empty texts
    and texts without words have no shingles, link with nothing and keep their
    own id. Rows of one id are one node: the component of an id that occurs
    with several texts joins what any of them links with. Rows with a null id
    are returned with a null component and link nothing. An empty table gives no
    rows; other columns are ignored. Equal sets are one class and searched once
    for each task that reads them.
    """
    bounded_batches(docs.sparkSession)
    pct = similarity_pct
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = stored(
        rows.mapInArrow(_prefixes(pct, words), "doc_id long, n_shingles long, digest binary, prefix array<long>")
    )
    cells = stored(_cells(sets, pct))
    links = stored(_links(rows, cells, words, pct))

    classes = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    keyed = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "digest").join(classes, "digest")
    equal = keyed.filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    linked = components(links.union(equal))
    return (
        sets.select("doc_id", "n_shingles")
        .join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )
