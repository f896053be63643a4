"""Deterministic caps, slices, splits and reservoirs."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.catalog.registry import query
from moodmill.catalog.tables import BACKEND, CORPUS, corpus, longs, scored_sql, soft_labels, with_
from moodmill.catalog.text import _RANKED
from moodmill.functions.hashing import in_sample
from moodmill.operators import labels as L
from moodmill.operators import sampling as Z
from moodmill.operators.scoring import score_documents
from moodmill.operators.trend import newest_documents as newest
from moodmill.plans.training import CAP_SEPARATOR
from moodmill.session import checkpoint_dir

_UNIT = "md5(platform || chr(31) || doc_id)"


@query(
    with_(
        CORPUS,
        "SELECT platform, doc_id FROM corpus ORDER BY md5(platform || '|' || doc_id), platform, doc_id LIMIT 300",
    )
)
def hash_cap(spark, d):
    return Z.hash_cap(corpus(spark, d), 300, separator=CAP_SEPARATOR).select("platform", "doc_id")


@query(with_(CORPUS, "SELECT platform, doc_id FROM corpus"))
def hash_cap_above_size(spark, d):
    return Z.hash_cap(corpus(spark, d), 1_840_000, separator=CAP_SEPARATOR).select("platform", "doc_id")


@query(with_(CORPUS, f"SELECT platform, doc_id FROM corpus ORDER BY {_UNIT}, platform, doc_id LIMIT 150"))
def mine_slice(spark, d):
    return Z.hash_cap(corpus(spark, d), 150).select("platform", "doc_id")


@query(
    with_(
        _RANKED,
        """SELECT platform, doc_id, aspect FROM (
  SELECT source AS platform, 'd-' || r.doc_id AS doc_id, aspect FROM ranked r JOIN documents USING (doc_id) WHERE rank < 2)
ORDER BY md5(platform || chr(31) || doc_id || chr(31) || aspect), platform, doc_id, aspect LIMIT 400""",
    )
)
def pair_cap(spark, d):
    checkpoint_dir(spark)
    mined = L.all_mined_pairs(corpus(spark, d, spread=True)).select("platform", "doc_id", "aspect").checkpoint()
    return Z.hash_cap(mined, 400, L.PAIR_KEY)


_TAIL = f"""SELECT platform, doc_id, CASE WHEN r > total - {{held}} THEN 'held out' ELSE 'train' END AS part FROM (
  SELECT *, row_number() OVER (ORDER BY {{key}}) AS r, count(*) OVER () AS total FROM {{rows}})"""


def _parts(head, tail, *keys):
    return head.select(*keys, F.lit("train").alias("part")).unionByName(tail.select(*keys, F.lit("held out").alias("part")))


@query(with_(CORPUS, _TAIL.format(held="least(5000, total // 5)", key=f"{_UNIT}, platform, doc_id", rows="corpus")))
def holdout_split(spark, d):
    docs = corpus(spark, d)
    joined = L.train_label_join(docs, soft_labels(docs, BACKEND), "teacher@v1")
    n = joined.count()
    head, tail = Z.split_tail(joined, Z.holdout_rows(n, floor=100), total=n)
    return _parts(head, tail, "platform", "doc_id")


@query(
    with_(
        CORPUS,
        "pairs AS (SELECT platform, doc_id, unnest(['the', 'la']) AS aspect FROM corpus)",
        _TAIL.replace("SELECT platform, doc_id,", "SELECT platform, doc_id, aspect,", 1).format(
            held="least(2000, total // 5)",
            key="md5(platform || chr(31) || doc_id || chr(31) || aspect), platform, doc_id, aspect",
            rows="pairs",
        ),
    )
)
def holdout_pairs(spark, d):
    pairs = corpus(spark, d).select(
        "platform", "doc_id", F.explode(F.array(F.lit("the"), F.lit("la"))).alias("aspect")
    )
    n = pairs.count()
    head, tail = Z.split_tail(pairs, Z.holdout_pairs(n), L.PAIR_KEY, total=n)
    return _parts(head, tail, *L.PAIR_KEY)


_SEEDED = "md5('13' || chr(31) || platform || chr(31) || doc_id)"


@query(with_(CORPUS, f"SELECT platform, doc_id, {_SEEDED} AS sort_key FROM corpus"))
def seeded_shuffle(spark, d):
    shuffled = Z.seeded_shuffle(corpus(spark, d), 13)
    return shuffled.select("platform", "doc_id", Z.seeded_order(13, "platform", "doc_id").alias("sort_key"))


@query(with_(CORPUS, f"SELECT platform, doc_id FROM corpus ORDER BY {_SEEDED}, platform, doc_id LIMIT 250"))
def seeded_budget(spark, d):
    return Z.seeded_budget(corpus(spark, d), 250, 13).select("platform", "doc_id")


@query(
    with_(
        CORPUS,
        scored_sql("corpus"),
        f"""SELECT label, doc_id FROM scored QUALIFY row_number() OVER (
  PARTITION BY label ORDER BY {_UNIT}, platform, doc_id) <= 201 // (SELECT count(DISTINCT label) FROM scored)""",
    )
)
def stratified_reservoir(spark, d):
    scored = score_documents(corpus(spark, d, spread=True), BACKEND)
    return Z.stratified_reservoir(scored, 201, "label").select("label", "doc_id")


@query(
    with_(
        CORPUS,
        f"""SELECT platform, doc_id FROM corpus
ORDER BY date_trunc('day', posted_at) DESC, {_UNIT}, platform, doc_id LIMIT 333""",
    )
)
def newest_documents(spark, d):
    return newest(corpus(spark, d), 333, "posted_at").select("platform", "doc_id")


@query(
    with_(
        CORPUS,
        "SELECT platform, count(*) FILTER (('0x' || substr(sha256(doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 < 0.5) AS sampled, count(*) AS rows FROM corpus GROUP BY platform",
    )
)
def sample_share(spark, d):
    return longs(
        corpus(spark, d).groupBy("platform").agg(
            F.count_if(in_sample("doc_id", 0.5)).alias("sampled"), F.count("*").alias("rows")
        ),
        "sampled",
    )
