"""SimHash components against comparing all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

import moodmill.llm.simhash as sh
from moodmill.llm import common, graph
from moodmill.llm.simhash import covering_masks, fingerprint, link_across, link_block, simhash_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    parts = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_components(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    codes = np.array([c for _, c in prints], dtype=np.uint64)
    near = [
        (prints[k][0], prints[j][0]) for k in range(len(prints))
        for j in np.flatnonzero(np.bitwise_count(codes[: k + 1] ^ codes[k]) <= 4).tolist()
    ]
    component = roots({i for i, _ in rows}, near)
    return sorted((i, f"{c:016x}", component[i]) for i, c in prints)


def found(df):
    return sorted(tuple(r) for r in simhash_components(df).collect())


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        masks = covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in combinations(range(0, 64, 1 if radius < 3 else 2), radius):
            assert any(all(not m >> b & 1 for b in bits) for m in masks)
    rng, masks = random.Random(1), covering_masks(4)
    for _ in range(20_000):
        bits = rng.sample(range(64), 4)
        assert any(all(not m >> b & 1 for b in bits) for m in masks)
    assert {m.bit_count() for m in masks} <= {32, 33, 34}


def test_fingerprint_of_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["", " ", "One", "one two\tTHREE", "a b c d", "É x É x É x É x", "a " * 50]
    texts += [" ".join(rng.choice(["ab", "C", "é", "word", "xxxxxxxxxxxx"]) for _ in range(rng.randrange(200))) + rng.choice(["", "  ", "\n"]) for _ in range(60)]
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(sh, "PIECE", piece)
        assert [fingerprint(t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


def near_codes(rng, n, flips):
    centre = rng.getrandbits(64)
    return list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips + 1))) for _ in range(n)})


@pytest.mark.parametrize("flips", [2, 5, 9, 30])
def test_block_links_keep_components(flips):
    rng = random.Random(flips)
    codes = np.array(near_codes(rng, 250, flips) + near_codes(rng, 40, 1), dtype=np.uint64)
    nodes = np.arange(len(codes)) + 1000
    near = [(1000 + a, 1000 + b) for a, b in combinations(range(len(codes)), 2) if int(codes[a] ^ codes[b]).bit_count() <= 4]
    links = link_block(codes, nodes, 4)
    assert roots(nodes.tolist(), links) == roots(nodes.tolist(), near)
    assert set(map(frozenset, links)) <= set(map(frozenset, near)) and len(links) < len(codes)
    asks = np.arange(len(codes)) % 2 == 0
    across = link_across(codes, nodes, nodes, asks, 4)
    assert roots(nodes.tolist(), across) == roots(nodes.tolist(), [p for p in near if (p[0] - p[1]) % 2])


def family_rows(seed=11):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    bases = [[rng.choice(words) for _ in range(rng.randint(4, 220))] for _ in range(10)]
    rows = []
    for i in range(400):
        t = list(rng.choice(bases if rng.random() < 0.6 else bases[:1]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            t[rng.randrange(len(t))] = f"Z{rng.randrange(90)}"
        rows.append((i * 3, " ".join(t)))
    return rows + [(2000 + k, t) for k, t in enumerate([None, "", " ", "a", "A", "a b c", "a b c d", None])]


@pytest.mark.parametrize("block", [4096, 6])
def test_components_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(sh, "BLOCK_CLASSES", block)
    rows = family_rows()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, code int, node string")
    assert found(df.repartition(5)) == brute_components(rows)


def test_sizes_of_buckets_are_never_broadcast(spark, monkeypatch):
    plans, store = [], sh.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(sh, "stored", seen)
    rows = family_rows()[:60]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)
    (placed,) = [p for p in plans if "Generate posexplode" in p]
    assert "SortMergeJoin" in placed and "Broadcast" not in placed


def test_components_of_many_links_broadcast_nothing(spark, monkeypatch):
    rng = random.Random(4)
    links = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(200)) if a != b]
    want = roots({n for link in links for n in link}, links)
    for few in (10**6, 10):
        plans, store = [], graph.stored
        monkeypatch.setattr(common, "BROADCAST_IDS", few)
        monkeypatch.setattr(graph, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
        got = graph.components(spark.createDataFrame(links, "a long, b long"))
        monkeypatch.setattr(graph, "stored", store)
        assert dict(map(tuple, got.collect())) == want
        rounds = [p for p in plans if "Join" in p]
        assert rounds and all(("Broadcast" in p) == (few > 10) for p in rounds)


def test_repeated_ids_and_null_ids(spark):
    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, text), (5, text), (3, text), (9, other), (9, text), (7, other), (8, "x " * 20_000)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)
    null = spark.createDataFrame([(None, text), (None, None), (4, text)], "doc_id long, text string")
    prints = {f"{brute_fingerprint(text):016x}", "0" * 16}
    got = simhash_components(null).collect()
    assert {r.fingerprint for r in got if r.doc_id is None} == prints
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert [r.component_id for r in got if r.doc_id == 4] == [4]
    assert found(null.limit(0)) == []
