"""Reservoirs over strata of unequal sizes."""

from collections import Counter

from pyspark.sql import functions as F

from moodmill.operators import sampling


def reservoir(spark, sizes, n):
    rows = [("p", f"{s}-{i}", s) for s, size in sizes.items() for i in range(size)]
    df = spark.createDataFrame(rows, "platform string, doc_id string, s string")
    return sampling.stratified_reservoir(df, n, "s", fill=True).select("s", "doc_id").collect()


def test_a_reservoir_is_full_while_rows_remain(spark):
    sizes = {"a": 3, "b": 500, "c": 40, None: 200}
    got = Counter(r.s for r in reservoir(spark, sizes, 201))
    # 3 and 40 are all there is; the other 158 are shared.
    assert got == {"a": 3, "c": 40, "b": 79, None: 79}
    assert len(reservoir(spark, {"a": 30, "b": 30, "c": 30}, 50)) == 50
    assert len(reservoir(spark, sizes, 10_000)) == 743
    assert len(reservoir(spark, {"a": 5, "b": 5, "c": 5}, 2)) == 2
    assert reservoir(spark, sizes, 0) == []


def test_rows_are_first_in_hash_order_within_each_stratum(spark):
    df = spark.createDataFrame([("p", str(i), i % 3) for i in range(300)], "platform string, doc_id string, s int")
    got = {r.doc_id for r in sampling.stratified_reservoir(df, 60, "s", fill=True).collect()}
    want = set()
    for s in range(3):
        mine = df.where(F.col("s") == s).orderBy(F.md5(F.concat_ws(chr(31), "platform", "doc_id"))).limit(20)
        want |= {r.doc_id for r in mine.collect()}
    assert got == want


def test_strata_have_no_limit(spark, monkeypatch):
    monkeypatch.setattr(sampling, "LOCAL_STRATA", 10)
    got = reservoir(spark, {f"s{i}": 2 for i in range(50)}, 70)
    assert len(got) == 70 and len({r.s for r in got}) == 50
