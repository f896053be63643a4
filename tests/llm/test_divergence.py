"""Source divergence against counting every term of every pair."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import moodmill.llm.divergence as dv
from moodmill.llm.divergence import source_divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, top=200):
    docs, groups, counts = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        of_lang = shares(sum((counts[lang, s] for s in sources), Counter()))
        of = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept)) for o in sources if o != s]
            own = [(t, (of[s][t] - of_lang[t]) ** 2 // of_lang[t]) for t in kept if counts[lang, s][t] and of[s][t] > of_lang[t]]
            for part, items in (("pair", pairs), ("term", own)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[: None if part == "pair" else top]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


def found(df, **options):
    got = [tuple(r) for r in source_divergence(df, **options).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def random_rows(seed, n=500):
    rng = random.Random(seed)
    words = [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["É", "é", "ÉTÉ", "naïve", "日本", "x", "X", " "]
    return [
        (
            rng.choice([" ", "-", "\n", "1", "\x7f"]).join(rng.choice(words) for _ in range(int(rng.paretovariate(0.8)) % 90))
            if rng.random() < 0.95 else rng.choice([None, "", "123 !"]),
            rng.choice(["en", "en", "de", None, ""]),
            rng.choice(["a", "a", "a", "b", "c", "é", None]),
        )
        for _ in range(n)
    ] + [("alone alone", "xx", "only"), (None, "xx", "none"), ("", "yy", "single")]


@pytest.mark.parametrize("few", [20_000, 0])
def test_matches_counting_every_term(spark, monkeypatch, few):
    monkeypatch.setattr(dv, "FEW_GROUPS", few)
    rows = random_rows(4)
    df = spark.createDataFrame([(*r, 3, "k", "t") for r in rows], "text string, lang string, source string, n int, term string, id string")
    assert found(df.repartition(6)) == expected(rows)


def test_ranks_end_at_the_given_number(spark):
    rows = random_rows(9, 200)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert found(df, top_terms=5) == expected(rows, 5)


def test_no_rows_and_no_kept_terms(spark):
    schema = "text string, lang string, source string"
    assert found(spark.createDataFrame([], schema)) == set()
    rows = [("one two", "en", "a"), ("three", "en", "b"), (None, "en", None)]
    got = found(spark.createDataFrame(rows, schema))
    assert got == expected(rows) and len(got) == 6 and {r[4] for r in got} == {0}


@pytest.mark.parametrize("levels", [4, 64, 4096])
def test_joint_cells_do_not_depend_on_steps(monkeypatch, levels):
    """Sums over AND and popcount, however many words and tiles are met at once."""
    rng, size, groups = np.random.default_rng(levels), 300, 5
    counts = rng.choice([0, 0, 1, 2, 3, 40], size=(groups, size))
    p = 1 + 10**9 * (counts + 1) // (counts.sum(axis=1) + size)[:, None]
    p0 = 1 + 10**9 // (counts.sum(axis=1) + size)
    rows = []
    for word in range(-(-size // 64)):
        for g in range(groups):
            line = counts[g, word * 64 : word * 64 + 64]
            for n in sorted(set(line.tolist()) - {0}):
                bits = sum(1 << k for k, c in enumerate(line) if c == n)
                share = int(p[g][counts[g] == n][0])
                rows.append((7, word, g, n, share, int(p0[g]), bits - (1 << 64) if bits >> 63 else bits))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["lang", "word", "group", "n", "p", "p0", "bits"])
    monkeypatch.setattr(dv, "LEVELS", levels)
    sums = Counter()
    for out in dv._pair_sums(iter([batch.slice(0, 11), batch.slice(11)])):
        for a, b, v in zip(*(c.to_pylist() for c in out.columns), strict=True):
            sums[a, b] += v

    def f(x, y):
        return (x - y) ** 2 // y

    for a in range(groups):
        for b in range(groups):
            both = [k for k in range(size) if counts[a][k] and counts[b][k]]
            want = sum(
                f(int(p[a][k]), int(p[b][k])) - f(int(p[a][k]), int(p0[b])) - f(int(p0[a]), int(p[b][k])) + f(int(p0[a]), int(p0[b]))
                for k in both
            )
            assert a == b or sums[a, b] == want
