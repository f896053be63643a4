"""Operator 4: nearest neighbours by robust-pruned directed graphs, one per shard.

Distinct vectors are dealt to shards of bounded size. In each, nodes join a graph
in batches: a greedy search from the shard's centre proposes neighbours, and
pruning keeps a proposal only if no kept one is nearer to it, by a relaxed
factor, than the new node is. Queries then run a beam search over every shard's
graph, and their best results are merged and scored on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodmill.llm.common import bounded_batches, stored

# Distinct vectors of a shard, and queries that one search task takes, at most about so many.
SHARD_ROWS, QUERY_ROWS = 4096, 8192
DEGREE, BEAM, RELAX = 32, 64, 1.2
# Nodes inserted at a time once the graph has as many; before that it doubles.
INSERT = 512


def _distances(x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 - cosine of unit vectors y (b, d) to x[rows] (b, m, d)."""
    return 1.0 - np.einsum("bmd,bd->bm", x[rows], y)


def beam_search(
    x: np.ndarray, edges: np.ndarray, entry: int, y: np.ndarray, beam: int, limit: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the beam of each query, nearest first; -1 and inf where there are fewer.

    All queries advance together: each expands its nearest node not yet expanded
    until its beam holds none. ``limit`` restricts the search to the first nodes.
    """
    b = len(y)
    ids = np.full((b, beam), -1, dtype=np.int64)
    dist = np.full((b, beam), np.inf)
    done = np.ones((b, beam), dtype=bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = _distances(x, ids[:, :1], y)[:, 0]
    active = np.arange(b)
    while len(active):
        open_dist = np.where(done[active], np.inf, dist[active])
        pick = open_dist.argmin(1)
        going = np.isfinite(open_dist[np.arange(len(active)), pick])
        active, pick = active[going], pick[going]
        if not len(active):
            break
        done[active, pick] = True
        near = edges[ids[active, pick]]
        valid = near >= 0
        if limit is not None:
            valid &= near < limit
        d = np.where(valid, _distances(x, np.where(valid, near, 0), y[active]), np.inf)
        valid &= d < dist[active, -1:]  # nothing beyond the beam's end can enter
        valid &= ~(near[:, :, None] == ids[active][:, None, :]).any(2)
        all_ids = np.concatenate([ids[active], np.where(valid, near, -1)], 1)
        all_dist = np.concatenate([dist[active], np.where(valid, d, np.inf)], 1)
        all_done = np.concatenate([done[active], ~valid], 1)
        order = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        dist[active] = np.take_along_axis(all_dist, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Neighbours of each node from its candidates (-1 for none): nearest first, each diverse from those kept."""
    found = np.where(found == nodes[:, None], -1, found)
    found = np.sort(found, 1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    dist = np.where(found >= 0, _distances(x, np.maximum(found, 0), x[nodes]), np.inf)
    order = np.argsort(dist, 1, kind="stable")
    found, dist = np.take_along_axis(found, order, 1), np.take_along_axis(dist, order, 1)
    vectors = x[np.maximum(found, 0)]
    kept = np.full((len(nodes), degree), -1, dtype=np.int64)
    every = np.arange(len(nodes))
    for slot in range(degree):
        pick = dist.argmin(1)
        some = np.isfinite(dist[every, pick])
        if not some.any():
            break
        kept[some, slot] = found[every, pick][some]
        between = 1.0 - np.einsum("bmd,bd->bm", vectors, vectors[every, pick])
        dist = np.where(relax * between <= dist, np.inf, dist)
        dist[every, pick] = np.inf
    return kept


def _reverse(x: np.ndarray, edges: np.ndarray, nodes: np.ndarray, degree: int, relax: float) -> None:
    """Adds edges back from the neighbours of ``nodes``, pruning where they grow too many."""
    to, source = edges[nodes].ravel(), np.repeat(nodes, degree)
    source, to = source[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    width = int(counts.max()) if len(counts) else 0
    for lo in range(0, len(targets), 1024):
        part = slice(lo, lo + 1024)
        extra = np.full((len(targets[part]), width), -1, dtype=np.int64)
        for i, (a, n) in enumerate(zip(first[part].tolist(), counts[part].tolist(), strict=True)):
            extra[i, :n] = source[a : a + n]
        edges[targets[part]] = robust_prune(x, targets[part], np.concatenate([edges[targets[part]], extra], 1), degree, relax)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """Edges (n, degree; -1 for none) over unit vectors and the node to start from.

    Rows are inserted in their given order. Nodes that cannot be reached in the
    end get an edge from the nearest node that can.
    """
    n = len(x)
    edges = np.full((n, degree), -1, dtype=np.int64)
    centre = x.mean(0)
    entry = int(np.argmax(x @ centre))
    x[[0, entry]] = x[[entry, 0]]  # the start is the first node while the graph grows
    size = 1
    while size < n:
        nodes = np.arange(size, min(n, size + min(size, INSERT)))
        ids, _ = beam_search(x, edges, 0, x[nodes], beam, limit=size)
        edges[nodes] = robust_prune(x, nodes, ids, degree, relax)
        _reverse(x, edges, nodes, degree, relax)
        size = nodes[-1] + 1
    seen = np.zeros(n, dtype=bool)
    front = np.array([0])
    while True:
        while len(front):
            seen[front] = True
            front = np.unique(edges[front][edges[front] >= 0])
            front = front[~seen[front]]
        lost = np.flatnonzero(~seen)
        if not len(lost):
            break
        # Give the lost node to the nearest reachable one, in place of its farthest edge if it has no room.
        node = lost[0]
        reachable = np.flatnonzero(seen)
        host = reachable[np.argmax(x[reachable] @ x[node])]
        free = np.flatnonzero(edges[host] < 0)
        if len(free):
            edges[host, free[0]] = node
        else:
            edges = np.concatenate([edges, np.full((n, 1), -1, dtype=np.int64)], 1)
            edges[host, -1] = node
        front = np.array([node])
    x[[0, entry]] = x[[entry, 0]]
    swapped = np.where(edges == 0, entry, np.where(edges == entry, 0, edges))
    swapped[[0, entry]] = swapped[[entry, 0]]
    return swapped, entry


def _unit(values: pa.Array, dim: int) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # Scaling by the largest part first keeps very large and small vectors exact.
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _build(dim: int, degree: int, beam: int, relax: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("rep").combine_chunks()
        x = _unit(t.column("vector").chunk(0), dim)
        order = np.random.default_rng(7).permutation(len(x))
        edges, entry = build_graph(x[order], degree, beam, relax)
        near = np.where(edges >= 0, order[np.maximum(edges, 0)], -1)
        back = np.empty(len(x), dtype=np.int64)
        back[order] = np.arange(len(x))
        rows = [e[e >= 0] for e in near[back]]
        yield pa.RecordBatch.from_arrays(
            [
                t.column("shard").chunk(0), t.column("rep").chunk(0), t.column("vector").chunk(0), pa.array(np.arange(len(x))),
                pa.array(rows, pa.list_(pa.int64())), pa.array(np.arange(len(x)) == order[entry]),
            ],
            ["shard", "rep", "vector", "place", "near", "entry"],
        )

    return run


def _search(dim: int, beam: int, want: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_rep": pa.array([], pa.int64()), "rep": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        left = left.sort_by("place").combine_chunks()
        x = _unit(left.column("vector").chunk(0), dim)
        near = left.column("near").to_pylist()
        width = max(1, max(map(len, near)))
        edges = np.full((len(x), width), -1, dtype=np.int64)
        for i, e in enumerate(near):
            edges[i, : len(e)] = e
        entry = int(np.flatnonzero(left.column("entry").to_numpy())[0])
        y = _unit(right.combine_chunks().column("vector").chunk(0), dim)
        hits = [beam_search(x, edges, entry, y[lo : lo + 256], beam) for lo in range(0, len(y), 256)]
        ids, far = (np.concatenate(h)[:, :want] for h in zip(*hits, strict=True))
        reps = left.column("rep").to_numpy()
        asked = np.repeat(right.column("rep").to_numpy(), ids.shape[1])
        flat = ids.ravel()
        held = flat >= 0
        return pa.table({
            "query_rep": pa.array(asked[held]), "rep": pa.array(reps[flat[held]]), "distance": pa.array(far.ravel()[held].astype(float))
        })

    return run


def _scaled(v: Column) -> Column:
    """The vector times a power of two that brings its largest part near one: exact, and its squares stay finite."""
    power = -F.floor(F.log2(F.array_max(F.transform(v, lambda x: F.abs(x)))))
    half = F.floor(power / 2)
    # In two steps, as the power of a tiny vector is no double itself.
    return F.transform(v, lambda x: x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Of vectors as ``_scaled`` gives them."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot / (_norm(a) * _norm(b))


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, *, k: int = 5, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM,
    relax: float = RELAX, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest other rows of each query found.

    Equal vectors are one node that keeps its k + 1 smallest ids, all that any
    result can hold, so a vector of very many rows costs no more than others.
    Ties go to the smaller id. Null, empty and zero vectors and those with null
    or non-finite parts take no part, nor do null ids; vectors of a length other
    than the commonest take none either, as no cosine is defined. Of rows of one
    id and vector one is kept. Other columns are ignored; an empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)).withColumn(
        "vector", F.transform("vector", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    )
    rows = stored(rows.distinct())
    top = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = int(top["d"]) if top else 1
    rows = rows.filter(F.size("vector") == dim)

    # Distinct vectors with their smallest ids: cut before the shuffle, as a limit on the row number.
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.select("vector", "vec_id").withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1)
    groups = stored(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))).withColumn("rep", F.col("ids")[0])
    n = groups.count()
    shards = max(1, -(-n // shard_rows))
    dealt = groups.select(F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"), "rep", "vector")
    index = stored(dealt.groupBy("shard").applyInArrow(
        _build(dim, degree, beam, relax), "shard int, rep long, vector array<double>, place long, near array<long>, entry boolean"
    ))

    asking = stored(rows.filter("asks").groupBy("vector").agg(F.min("vec_id").alias("rep")))
    blocks = max(1, -(-asking.count() // QUERY_ROWS))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = asking.select(every_shard.alias("shard"), F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"), "rep", "vector")
    found = (
        index.withColumn("block", every_block).groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(_search(dim, beam, k + 1), "query_rep long, rep long, distance double")
    )
    # Of all shards' answers only the nearest meet their vectors again, cut before the shuffle; twice as
    # many as are wanted, and equal up to rounding by their ids, as these distances are not exact.
    close = Window.partitionBy("query_rep").orderBy(F.round("distance", 9), "rep")
    found = found.withColumn("nth", F.row_number().over(close)).filter(F.col("nth") <= 2 * (k + 1)).drop("nth")

    # Distinct results with exact scores; k + 1 of them hold the k nearest rows of any query of that vector.
    scored = (
        found.join(asking.select(F.col("rep").alias("query_rep"), F.col("vector").alias("asked")), "query_rep")
        .join(groups.select("rep", "ids", "vector"), "rep")
        .select("query_rep", "ids", cosine(_scaled(F.col("asked")), _scaled(F.col("vector"))).alias("score"))
    )
    best = Window.partitionBy("query_rep").orderBy(F.desc("score"), F.col("ids")[0])
    kept = scored.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    near = kept.groupBy("query_rep").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    queries = rows.filter("asks").join(asking.withColumnRenamed("rep", "query_rep"), "vector").select(
        F.col("vec_id").alias("query_id"), "query_rep"
    )
    each = queries.join(near, "query_rep").select("query_id", F.explode("found").alias("f")).select(
        "query_id", "f.score", F.explode("f.ids").alias("vec_id")
    ).filter("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
