"""N-gram components and vector search against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import moodmill.llm.ngram_join as join
from moodmill.llm.graph import components
from moodmill.llm.ngram_join import divide_skip, jaccard_components
from moodmill.llm.vector_graph import beam_search, build_graph, nearest_neighbours

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = {}
    for i, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in held[g] if j < i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family_rows(seed=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(55)]
    bases = [[rng.choice(words) for _ in range(rng.randint(5, 150))] for _ in range(12)]
    rows = []
    for i in range(260):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
            t[rng.randrange(len(t))] = f"z{rng.randrange(60)}"
        if rng.random() < 0.3:
            t += passage
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, rng.choice(["a", "a b", "A b", "a b c d e", "a b c d e f g h", "a b c d e f g h i", None, "", " \t"])) for i in range(40)]
    return rows


@pytest.mark.parametrize("block", [2_000_000, 1500])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(join, "BLOCK_SHINGLES", block)
    rows = family_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("node", F.lit("x")).withColumn("digest", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_component_edge_cases(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (3, text), (None, text), (None, None), (7, ""), (8, "x " * 20000)]
    got = Counter(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 3, 3): 2, (3, 3, 3): 1, (None, 3, None): 1, (None, 0, None): 1, (7, 0, 7): 1, (8, 1, 8): 1})
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_divide_skip_joins_all_similar_pairs():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = []
    for _ in range(60):
        base = pool[: rng.integers(20, 60)]
        sets.append(np.unique(np.where(rng.random(len(base)) < 0.08, rng.integers(0, 2**63, len(base)).astype(np.uint64), base)))
    nodes = np.arange(60)
    links = divide_skip(nodes, nodes, sets, np.ones(60, dtype=bool), 75, whole=True)
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)
        parent[root(a)] = root(b)
    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert root(a) == root(b)


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 100), (7, 7)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 100: 50}


def brute_nearest(rows, asks, k=5):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if asks(q):
            scores = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in ok if i != q]
            out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def test_vector_search_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(900)]
    rows += [(2000 + i, [1.0] + [0.0] * 15) for i in range(40)]  # one vector of many rows
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [None] + [1.0] * 15), (3004, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 10 == 0, shard_rows=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    expected = brute_nearest(rows, lambda i: i % 10 == 0)
    assert set(got) == set(expected)
    hits = sum(len(set(got[q]) & set(e)) for q, e in expected.items()) / sum(map(len, expected.values()))
    assert hits >= 0.95
    assert got[2000] == [2001, 2002, 2003, 2004, 2005]


def test_few_vectors_are_all_found(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest_neighbours(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 2, round(2**-0.5, 9)), (0, 2, 1, 0.0)]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_graph_reaches_every_node():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges, entry = build_graph(x.copy(), degree=4, beam=8)
    ids, _ = beam_search(x, edges, entry, x[:1], 400)
    assert set(ids[0].tolist()) == set(range(400))


def test_tiny_and_huge_vectors_have_their_cosines(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8))
    scales = [1e-170, 1e170, 1.0, 1e-300, 1e300]
    rows = [(i, (base[i] * scales[i % 5]).tolist()) for i in range(40)] + [(100, [5e-324] * 8), (101, [1e308] * 8)]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=5).collect()
    exact = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    exact = {i: v / np.linalg.norm(v) for i, v in exact.items()}
    for query in (0, 100):
        want = sorted(((-float(exact[query] @ v), i) for i, v in exact.items() if i != query))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query)
        assert [m[1] for m in mine] == [i for _, i in want]
        assert [m[2] for m in mine] == pytest.approx([-s for s, _ in want], abs=1e-12)
