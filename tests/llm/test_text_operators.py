"""Token counts, quality rules and packing against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from moodmill.llm.bpe import part_encoder
from moodmill.llm.common import span_hashes, text_buffer, word_spans
from moodmill.llm.packing import _Gaps, pack_documents, pack_pieces, plan_fills
from moodmill.llm.quality_rules import quality_rules
from moodmill.llm.token_counts import token_counts

PARTS = [" ", "  ", "\n", "\t", "a", "Bc", "é", "ß", "1", "22", "'s", "it's", "!", "&&", "<|endoftext|>", "<|", "\xa0", " ", "’",
         "　", "\x85", "\x1c", "\x0b", "日本", "😀", "-", "word", "​", "\x00", ".", ","]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(1, None), (2, ""), (3, "word " * 9000), (4, "x" * 5000), (4, "x" * 5000), (5, " \n\t "), (None, "null id"), (6, "a <|endoftext|> b")]
    rows = [(i, t, "k", 0) for i, t in odd] + [(100 + i, t, None, 1) for i, t in enumerate(texts(60))]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, part int").cache()


def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_parts_encode_as_whole_texts():
    many = texts(3000, seed=7)
    data, offsets = text_buffer(pa.array(many))
    ids, at = part_encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(data, offsets)
    expected = [e.ids for e in plain_tokenizer().encode_batch(many, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == expected


def test_equal_hashes_are_told_apart(monkeypatch):
    import moodmill.llm.bpe as bpe

    monkeypatch.setattr(bpe, "span_hashes", lambda data, s, e: np.zeros(len(s), dtype=np.uint64))
    encoder = bpe.PartEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    data, offsets = text_buffer(pa.array(["one two", "three four five"]))
    expected = [len(e.ids) for e in plain_tokenizer().encode_batch(["one two", "three four five"])]
    assert encoder.counts(data, offsets).tolist() == expected


def test_words_and_hashes():
    many = texts(200, seed=3)
    data, offsets = text_buffer(pa.array(many))
    starts, ends, rows = word_spans(data, offsets)
    raw = data.tobytes()
    found = [(r, raw[a:b]) for r, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True)]
    expected = [(i, w.encode()) for i, t in enumerate(many) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert found == expected
    one_window, small = span_hashes(data, starts, ends), span_hashes(data, starts, ends, window=16)
    assert (one_window == small).all()
    assert len(set(one_window.tolist())) == len({w for _, w in expected})


def test_token_counts(docs):
    tok = plain_tokenizer()
    expected = Counter((r.doc_id, len((r.text or "").encode()), n := len(tok.encode(r.text or "").ids), n > 1024) for r in docs.collect())
    assert Counter(tuple(r) for r in token_counts(docs).collect()) == expected
    assert token_counts(docs.limit(0)).count() == 0


def test_piece_counts(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    some = docs.filter("doc_id >= 100")
    got = {r.doc_id: r.n_tokens for r in token_counts(some, tokenizer="piece_bpe_32k.model").collect()}
    assert got == {r.doc_id: len(model.encode(r.text)) for r in some.collect()}


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    c = Counter(wins)
    inside = {i + j for i, w in enumerate(wins) if c[w] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def test_quality_base(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "the", "x|y", "é", "#"]) for _ in range(rng.randint(0, 40))).replace("b a", "\n")) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "one two three four five " * 3000), (1003, "\n\n"), (1003, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("mine"))
    got = quality_rules(df).collect()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[n] for n in names) == brute_quality(r.text), r.doc_id
        assert not (r.kept and r.base_failed)


def test_lines_that_fail(spark):
    clean = "\n".join(" ".join(f"word{i}{c}" for c in "abcdefghijkl").capitalize() + "." for i in range(6))
    menu = "Home | About | News | Contact"
    rows = [(1, clean), (2, f"{menu}\n{clean}\nAll rights reserved."), (3, "\n".join([menu.replace("News", str(i)) for i in range(9)])),
            (4, " ".join(f"w{i}&&& x{i}!!" for i in range(30)))]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.kept for k, r in got.items()} == {1: True, 2: True, 3: False, 4: False}
    assert got[1].clean_text == clean and got[2].clean_text == clean
    assert got[2].n_failed_lines == 2
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(4, 60))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[1:] = rng.integers(0, 30, capacity) * (rng.random(capacity) < 0.6)
    left = counts.copy()
    for fill in plan_fills(counts, capacity):
        assert sum(length * k for length, k in fill.items) <= capacity
        for length, k in fill.items:
            left[length] -= k * fill.times
    assert not left.any()


def test_packing_round_trip(spark, docs):
    capacity = 64
    tok = plain_tokenizer()
    pieces = pack_documents(docs, capacity=capacity).collect()
    ids = Counter()
    for r in docs.collect():
        all_ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(all_ids) if len(all_ids) <= capacity else len(all_ids) % capacity or capacity
        cuts = [0, *range(first, len(all_ids) + 1, capacity)] if len(all_ids) > first else [0, first]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            crc = zlib.crc32(np.array(all_ids[a:b], dtype="<u4").tobytes())
            ids[r.doc_id, k, a, b - a, crc] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == ids
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(p.length for p in pieces)
    assert len(by_sequence) <= -(-total // capacity) * 1.05 + 1


def test_packing_closes_gaps_exactly(spark):
    lengths = [7, 3, 6, 2, 2, 5, 1, 1, 3, 10, 4, 4, 2]  # 50 ids in five sequences of ten
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    packed = pack_pieces(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), 10)
    assert packed.select("sequence_id").distinct().count() == 5
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sum_index_finds_what_every_combination_finds():
    """Also while lengths run out, which is when combinations are dropped from their sums."""
    rng = random.Random(2)
    for _ in range(40):
        counts = np.array([0, *(rng.choice([0, 0, 1, 2, 3]) for _ in range(24))])
        gaps = _Gaps(counts)
        while counts.any():
            for gap in rng.sample(range(1, 25), 8):
                for size, look in ((1, gaps.single), (2, gaps.pair), (3, gaps.triple)):
                    every = [
                        c for c in itertools.combinations_with_replacement(range(1, 25), size)
                        if sum(c) == gap and all(counts[x] >= c.count(x) for x in c)
                    ]
                    got = look(gap)
                    assert (got is not None) == bool(every)
                    assert got is None or tuple(sorted(got)) in every
            counts[rng.choice(np.flatnonzero(counts).tolist())] -= 1


def test_boilerplate_counts_between_word_boundaries_only(spark):
    clean = [
        "The catalog includes all of the works that she wrote in her last years.",
        "We stepped from the dialog into a long and quiet talk about old friends.",
        "Their design includes a garden, and they assign interns to look after it daily.",
        "Bake each cookie for ten minutes until golden and let them cool on a rack.",
        "He taught javascript to children at the village school for many happy years there.",
    ]
    notices = [
        "Please sign in or log in before you read any more of this long page today.",
        "We use cookies so that you get the best of our pages every time you come.",
        "Please enable JavaScript in your browser to see all of the pages on here today.",
        "Cookies", "Copyright 2020, all rights reserved.", "Back to top",
    ]
    rows = [*((i, x) for i, x in enumerate(clean)), *((100 + i, x) for i, x in enumerate(notices))]
    for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.n_failed_lines == int(r.doc_id >= 100), r.text
        assert r.kept == (r.doc_id < 100)


def test_sentences_and_short_lines_are_no_markup(spark):
    """Marks that end sentences, and few of any, say nothing; teasers and rules of marks fail."""
    clean = ["Thank you!", "Hello world!", "Stop!", "# Title", "$5 each", "50% off", "user@host.org", "Wait... what happened next?", "C# and F# code"]
    failing = ["====", "***  ***", "{{{x}}}", "Our best offers of the week ...", "Read on…\r", "| a | b | c |"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*clean, *failing])], "doc_id long, text string")
    got = {r.text: r.n_failed_lines for r in quality_rules(df).collect()}
    assert [got[t] for t in clean] == [0] * len(clean) and [got[t] for t in failing] == [1] * len(failing)
    talk = "\n".join(["Hi!", "Hello there!", "How are you?", "Fine, thanks!", "And you?", "Very well!", "Great!", "See you soon!", "Bye!", "Bye bye now!"])
    assert [r.kept for r in quality_rules(spark.createDataFrame([(1, talk)], "doc_id long, text string")).collect()] == [True]


def test_sql_says_what_the_rules_do(spark):
    import duckdb

    from moodmill.llm.quality_rules import quality_sql

    rng = random.Random(12)
    bits = ["cookie", "cookies", "accept", "Log in", "blog into", "catalog in", "sign in", "designs in", "javascript", "website", "!", "#", "&&&",
            "word", "and", "more", "...", "…", "|", ">", "licensed under", "é", "read more", "ready more", "_cookie", "our cookies"]
    rows = [(i, "\n".join(" ".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12)))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lines n_failed_lines kept_words".split()
    got = sorted(tuple(r[n] for n in names) for r in quality_rules(df).collect())
    base = duckdb.connect()
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})  # noqa: F841 - read by name
    assert sorted(base.sql(f"SELECT {', '.join(names)} FROM ({quality_sql()})").fetchall()) == got
