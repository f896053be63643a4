"""Operator 12: near duplicates by SimHash, found with covering locality-sensitive hashing.

Each of the 64 fingerprint bits has a nonzero vector of radius + 1 bits, and each
nonzero vector v of that length is a table, whose mask keeps the fingerprint bits
whose vector has an odd product with v. Any ``radius`` vectors leave some v to which
all of them are orthogonal, so two fingerprints that differ in those bits have equal
keys in the table of v: no pair within the radius is missed. A table keeps about half
of the bits.

Equal fingerprints are one class, and only classes enter the tables. A bucket is
compared by xor and popcount within its task; a larger one is dealt to blocks, and
then those classes that are not in the bucket's largest component ask the other
blocks. So a dense bucket costs about one link a class rather than all its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.llm.common import bounded_batches, stored
from moodmill.llm.graph import components

WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
# Classes of a bucket that one task compares with each other.
BLOCK_CLASSES = 4096
# Buckets of up to so many classes are compared together with their neighbours in one vector step.
SHORT = 8
# Bytes of a text whose words are held at once.
PIECE = 1 << 20

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of each run of ``size`` words; of the whole sequence where it is shorter."""
    import xxhash

    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1]
    spans = zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans]


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """The 64 majority bits of a text's shingle hashes, repeats included; zero without words.

    A long text is read in pieces that share ``size`` - 1 words, so only one
    piece's words and hashes are held.
    """
    ones, n, carried, at = np.zeros(BITS, dtype=np.int64), 0, [], 0
    while at < len(text):
        cut = SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        words = carried + text[at:end].translate(LOWER).split()
        at = end
        if len(words) < size and at < len(text):
            carried = words
            continue
        # A last piece may bring no new word; its carried words were hashed with the one before.
        if n == 0 or len(words) >= size:
            found = np.array(_shingle_hashes(words, size), dtype="<u8")
            ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(found)
        carried = words[max(0, len(words) - size + 1) :]
    return sum(1 << int(k) for k in np.flatnonzero(ones * 2 > n))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            codes = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return run


def covering_masks(radius: int) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks; any ``radius`` bits are all left out by one of them at least."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + k % size for k in range(BITS)]
    return [sum(1 << k for k, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_block(codes: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all classes within the radius, some through others.

    The class nearest to the bitwise majority gathers its neighbours; once a group
    holds most classes, its own no longer ask, as the others ask them.
    """
    bits = np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    centre = np.packbits(bits.sum(axis=0) * 2 > len(codes), bitorder="little").view("<u8")[0]
    first = int(np.bitwise_count(codes ^ centre).argmin())
    groups, links, main = np.arange(len(codes)), [], None
    for q in [first, *(k for k in range(len(codes)) if k != first)]:
        if main is not None and groups[q] == main:
            continue
        near = np.flatnonzero((np.bitwise_count(codes ^ codes[q]) <= radius) & (groups != groups[q]))
        if not len(near):
            continue
        labels, at = np.unique(groups[near], return_index=True)
        links += [(int(nodes[q]), int(nodes[other])) for other in near[at]]
        groups[np.isin(groups, labels)] = groups[q]
        if main is None or main in labels:
            main = groups[q] if (groups == groups[q]).sum() * 2 > len(groups) else None
    return links


def link_across(codes: np.ndarray, nodes: np.ndarray, parts: np.ndarray, asks: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A link from each asking class to each group of the others that it reaches."""
    links, held = [], np.flatnonzero(~asks)
    for q in np.flatnonzero(asks):
        near = held[(np.bitwise_count(codes[held] ^ codes[q]) <= radius) & (parts[held] != parts[q])]
        _, at = np.unique(parts[near], return_index=True)
        links += [(int(nodes[q]), int(nodes[other])) for other in near[at]]
    return links


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of whole runs of equal keys in a sorted partition, and where each run begins."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        if rest is not None:
            now = {n: np.concatenate((rest[n], c)) for n, c in now.items()}
        size = len(now[keys[0]])
        if not size:
            continue
        change = np.zeros(size, dtype=bool)
        for k in keys:
            change[1:] |= now[k][1:] != now[k][:-1]
        starts = np.flatnonzero(change)
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield {n: c[:last] for n, c in now.items()}, np.concatenate(([0], starts[:-1]))
        rest = {n: c[last:] for n, c in now.items()}
    if rest is not None and len(rest[keys[0]]):
        yield rest, np.zeros(1, dtype=np.int64)


def _link_batch(a: np.ndarray, b: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    x, y = (np.array(c, dtype=np.int64) for c in (zip(*links, strict=True) if links else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, x))), pa.array(np.concatenate((b, y)))], ["a", "b"])


def _in_buckets(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in _runs(batches, ["mask", "key", "block"]):
            codes, nodes = cols["code"].view(np.uint64), cols["node"]
            sizes = np.diff(np.append(starts, len(codes)))
            owner, size = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
            left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for shift in range(1, min(SHORT, int(sizes.max()))):
                near = (owner[shift:] == owner[:-shift]) & (size[shift:] <= SHORT)
                near &= np.bitwise_count(codes[shift:] ^ codes[:-shift]) <= radius
                left.append(nodes[:-shift][near])
                right.append(nodes[shift:][near])
            long = []
            for k in np.flatnonzero(sizes > SHORT):
                part = slice(starts[k], starts[k] + sizes[k])
                long += link_block(codes[part], nodes[part], radius)
            yield _link_batch(np.concatenate(left), np.concatenate(right), long)

    return run


def _across_blocks(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        for cols, starts in _runs(batches, ["mask", "key", "block", "turn"]):
            for lo, hi in zip(starts, np.append(starts[1:], len(cols["code"])), strict=True):
                part = {n: c[lo:hi] for n, c in cols.items()}
                links = link_across(part["code"].view(np.uint64), part["node"], part["part"], part["asks"], radius)
                yield _link_batch(none, none, links)

    return run


def fingerprint_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between ``node``s that join all ``code``s within the radius, some through others."""
    masks = F.array(*(F.col("code").bitwiseAND(F.lit(_signed(m))) for m in covering_masks(radius)))
    posts = classes.select("code", "node", F.posexplode(masks).alias("mask", "key"))
    sizes = posts.groupBy("mask", "key").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK_CLASSES).cast("int")
    # The planner sizes posts, and so their counts, as if there were one a class, and would broadcast either side.
    placed = stored(
        posts.join(sizes.select("mask", "key", blocks.alias("blocks")).hint("merge"), ["mask", "key"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    bucket = ["mask", "key", "block"]
    found = stored(
        placed.select(*bucket, "code", "node").repartition(*bucket).sortWithinPartitions(*bucket)
        .mapInArrow(_in_buckets(radius), "a long, b long")
    )
    wide = placed.filter("blocks > 1")
    if wide.isEmpty():
        return found

    label = components(found)
    grouped = stored(wide.join(label, "node", "left").withColumn("part", F.coalesce("component_id", "node")).drop("component_id"))
    largest = (
        grouped.groupBy("mask", "key", "part").count()
        .groupBy("mask", "key").agg(F.max_by("part", F.struct("count", "part")).alias("largest"))
    )
    asking = grouped.join(largest, ["mask", "key"]).filter("part <> largest")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    turns = asking.select("mask", "key", "blocks", F.col("block").alias("turn")).distinct()
    queries = asking.select("mask", "key", every.alias("block"), F.col("block").alias("turn"), "code", "node", "part")
    members = grouped.join(turns.drop("blocks"), ["mask", "key"]).filter("block <> turn")
    both = queries.filter("block <> turn").withColumn("asks", F.lit(True)).unionByName(
        members.select("mask", "key", "block", "turn", "code", "node", "part").withColumn("asks", F.lit(False))
    )
    pair = [*bucket, "turn"]
    across = both.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(_across_blocks(radius), "a long, b long")
    return found.union(stored(across))


def simhash_components(
    docs: DataFrame, *, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row; fingerprints link up to ``radius`` bits apart.

    Null and empty texts and texts without words have the fingerprint zero, which
    links like any other. Rows of one id are one node: the component of an id that
    occurs with several texts joins what any of them links with. Rows with a null id
    are returned with a null component and link nothing. Repeated rows give a row
    each, an empty table gives no rows, other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(rows.mapInArrow(_fingerprints(words), "doc_id long, code long"))
    known = prints.filter("doc_id IS NOT NULL")
    classes = stored(known.groupBy("code").agg(F.min("doc_id").alias("node")))
    links = fingerprint_links(classes, radius)

    # Only ids that occur with several fingerprints link classes by themselves.
    several = known.groupBy("doc_id").agg(F.min("code").alias("low"), F.max("code").alias("high")).filter("low <> high")
    mixed = known.join(several.select("doc_id"), "doc_id", "left_semi").join(classes, "code")
    least = mixed.groupBy("doc_id").agg(F.min("node").alias("least"))
    joined = mixed.join(least, "doc_id").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    linked = components(links.union(joined))
    named = classes.join(linked, "node", "left").select("code", F.coalesce("component_id", "node").alias("component_id"))
    return (
        prints.join(named, "code", "left")
        .select(
            "doc_id",
            F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
            F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        )
    )
