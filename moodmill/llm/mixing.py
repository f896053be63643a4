"""Operator 7: sampling rates that bring soft domains to target token totals.

A classifier trained on a labelled table gives each document its domain
posteriors. Projected-gradient steps then fit nonnegative rates by least squares, so
that the expected tokens of each domain, summed over posteriors, meet their targets.
A step moves every rate and clips it to its bounds; how far follows from its
posteriors and one number a domain, so rates are worked out where they are needed
and the driver sees one total a domain and step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodmill.llm.common import LOWER, bounded_batches, byte_steps, stored, text_buffer, word_spans

# Buckets of hashed byte triples; labelled rows of each domain that the classifier is fitted on, at most.
BUCKETS, MAX_LABELLED = 512, 4000
# Posteriors are multiples of 1 / GRID. Equal ones share their rate, so the fit runs over them.
GRID = 1 << 16
# The fit stops where no total is further from its target than this share of it, or no step lowers the squares by more.
STEPS, TOLERANCE, STILL = 80, 1e-6, 1e-9
# Steps tried in one job: damping beside the curvature, and lengths.
DAMPING, LENGTHS = (1e-9, 1e-4, 1e-1), (1.0, 0.3)


@dataclass(frozen=True)
class DomainModel:
    """Softmax weights by domain over hashed byte triples."""

    domains: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.T + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return on_grid(p / p.sum(1, keepdims=True))


def on_grid(p: np.ndarray) -> np.ndarray:
    """Rounded to the grid with sums kept at one: what rounding down leaves goes to the largest remainders."""
    whole = np.floor(p * GRID)
    order = np.argsort(whole - p * GRID, axis=1, kind="stable")
    left = GRID - whole.sum(1, keepdims=True)
    np.put_along_axis(whole, order, np.take_along_axis(whole, order, 1) + (np.arange(p.shape[1]) < left), 1)
    return whole / GRID


def byte_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Root shares of hashed triples of lower-cased bytes, a row per text."""
    rows = len(offsets) - 1
    low = LOWER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros((rows, BUCKETS))
    triple = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)
    bucket = ((triple ^ (triple >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(23)
    row = np.repeat(np.arange(rows), np.diff(offsets))[:-2]
    inside = np.arange(len(row)) + 2 < offsets[1:][row]
    counts = np.bincount(row[inside] * BUCKETS + bucket[inside], minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for lo, hi in byte_steps(offsets):
            x = byte_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), BUCKETS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["label", "x"])


def train_domains(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], max_labelled: int = MAX_LABELLED) -> DomainModel:
    """Fits on (doc_id, domain) rows, at most ``max_labelled`` of each domain in the order of a hash of the id.

    The share of each domain among all labelled rows is put back into the biases.
    Domains without rows get next to no posterior; without any rows all are even.
    """
    k = len(domains)
    index = F.create_map(*(x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(float(i)))))
    known = labelled.filter(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    weights, bias = np.zeros((k, BUCKETS)), np.zeros(k)
    if not counts:
        return DomainModel(domains, weights, bias)
    total = sum(counts.values())
    prior = np.array([max(counts.get(d, 0), 1e-6) / total for d in domains])
    if len(counts) == 1:
        return DomainModel(domains, weights, np.log(prior))
    order = F.xxhash64("doc_id")
    parts = [known.filter(F.col("domain") == d).orderBy(order, "doc_id").limit(max_labelled) for d in domains]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    # At most k * max_labelled ids.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(index[F.col("domain")].alias("label"), "text")
    sample = stored(rows.mapInArrow(_features, "label double, x array<double>"))
    seen = {int(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
    if len(seen) < 2:
        return DomainModel(domains, weights, np.log(prior))
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, standardization=False, labelCol="label", featuresCol="v").fit(
        sample.select("label", array_to_vector("x").alias("v"))
    )
    fitted = model.coefficientMatrix.toArray()
    weights[: len(fitted)], bias[: len(fitted)] = fitted, model.interceptVector.toArray()
    share = np.array([max(seen.get(i, 0), 1e-6) / sum(seen.values()) for i in range(k)])
    bias = np.where(share > 1e-5, bias, 0.0) + np.log(prior) - np.log(share) + np.where(share > 1e-5, 0.0, np.log(1e-9))
    return DomainModel(domains, weights, bias)


def _judged(batch: pa.RecordBatch, place: int, model: DomainModel) -> tuple[np.ndarray, np.ndarray]:
    """Words and domain posteriors of the texts in a column of a batch."""
    data, offsets = text_buffer(batch.column(place))
    tokens, p = [np.zeros(0, dtype=np.int64)], [np.zeros((0, len(model.domains)))]
    for lo, hi in byte_steps(offsets):
        raw, local = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        p.append(model.posteriors(byte_features(raw, local)))
        tokens.append(np.bincount(word_spans(raw, local)[2], minlength=hi - lo).astype(np.int64))
    return np.concatenate(tokens), np.concatenate(p)


def _lists(p: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))


def document_posteriors(texts: DataFrame, model: DomainModel) -> DataFrame:
    """(n_tokens, p) of rows (text): their words and domain posteriors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p = _judged(batch, 0, model)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), _lists(p)], ["n_tokens", "p"])

    return texts.mapInArrow(run, "n_tokens long, p array<double>")


Step = tuple[bool, tuple[float, ...]]


@dataclass(frozen=True)
class RateRule:
    """Rates after some projected-gradient steps, each given by one pull a domain.

    A plain step is divided by a rate's row sum of the squares to be minimised,
    which bounds their curvature, so that it never leads upward; others have the
    curvature between domains in their pulls.
    """

    steps: tuple[Step, ...]
    curve: tuple[float, ...]
    max_rate: float

    def step(self, r: np.ndarray, p: np.ndarray, plain: bool, pulls: tuple[float, ...]) -> np.ndarray:
        move = p @ np.array(pulls)
        if plain:
            width = p @ np.array(self.curve)
            move = move / np.where(width > 0, width, np.inf)
        return np.clip(r - move, 0.0, self.max_rate)

    def rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates, and which of them lie within their bounds."""
        r = np.full(len(p), min(1.0, self.max_rate))
        for plain, pulls in self.steps:
            r = self.step(r, p, plain, pulls)
        return r, (r > 0.0) & (r < self.max_rate)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def fit_rates(cells: DataFrame, targets: np.ndarray, *, max_rate: float) -> RateRule:
    """Nonnegative least squares over cells (p, tokens), by projected gradient on the rates.

    Minimises the squared misses of all domains, each relative to its own target;
    rates start at one. A step moves every rate along its gradient, scaled on the
    side of the domains by the damped inverse curvature of the rates within their
    bounds, and clips it. Whatever the damping, a point that such steps leave in
    place is a least of the squares. Each job tries a few of them and a plain
    gradient step, and returns totals and curvatures; the best goes on.
    """
    k = len(targets)
    width = k + k * k

    def sums(rule: RateRule, tried: list[Step | None]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = np.zeros((len(tried), width))
            for batch in batches:
                p, tokens = _matrix(batch.column(0), k), batch.column(1).to_numpy().astype(float)
                at = rule.rates(p)[0]
                for row, step in zip(values, tried, strict=True):
                    r = at if step is None else rule.step(at, p, *step)
                    free = tokens * ((r > 0.0) & (r < max_rate))
                    row[:k] += (tokens * r) @ p
                    row[k:] += ((p * free[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(values.size)), pa.array(values.ravel())], ["i", "v"])

        return run

    def measure(rule: RateRule, tried: list[Step | None]) -> np.ndarray:
        out = np.zeros(len(tried) * width)
        for i, v in cells.mapInArrow(sums(rule, tried), "i long, v double").groupBy("i").agg(F.sum("v")).collect():
            out[i] = v
        return out.reshape(len(tried), width)

    # Before any step the totals are at rates of one, or at the bound below it.
    rule = RateRule((), (0.0,) * k, max_rate)
    state = measure(rule, [None])[0]
    now = state[:k] / max(min(1.0, max_rate), 1e-300)
    # A target of nothing is measured by what there is.
    size = np.where(targets > 0, targets, np.maximum(now, 1.0))
    rule = RateRule((), tuple((now / size**2).tolist()), max_rate)
    for _ in range(STEPS):
        miss = (state[:k] - targets) / size
        if np.abs(miss).max() < TOLERANCE:
            break
        curvature = state[k:].reshape(k, k) / np.outer(size, size)
        unit = max(float(np.trace(curvature)) / k, float((now / size**2).max()) * 1e-6)
        tried: list[Step] = [(True, tuple((miss / size).tolist()))]
        for damping in DAMPING:
            pull = np.linalg.solve(curvature + damping * unit * np.eye(k), miss) / size
            tried += [(False, tuple((length * pull).tolist())) for length in LENGTHS]
        found = measure(rule, tried)
        squares = (((found[:, :k] - targets) / size) ** 2).sum(1)
        best = int(squares.argmin())
        if squares[best] > (miss**2).sum() * (1 - STILL):
            break
        rule, state = RateRule((*rule.steps, tried[best]), rule.curve, max_rate), found[best]
    return rule


def mixing_rates(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *, relative: bool = False, total: float | None = None,
    max_rate: float = float("inf"),
) -> DataFrame:
    """All columns of ``docs`` with n_tokens, domain_posteriors, and rate.

    ``labelled`` has (doc_id, domain). ``weights`` gives each domain's share of
    ``total`` tokens (all tokens by default) or, if ``relative``, its target as a
    multiple of what it has now. Tokens are runs of characters other than ASCII
    spaces. Null and empty texts have none, even features, and the rate of their
    posteriors; repeated rows count each for itself; an empty table gives no rows.
    Added columns replace those of the same name; labelled ids that are null or
    unknown are passed over.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("n_tokens", "domain_posteriors", "rate")
    domains = tuple(weights)
    k = len(domains)
    model = train_domains(docs, labelled, domains)
    seen = document_posteriors(docs.select("text"), model)
    cells = stored(seen.groupBy("p").agg(F.sum("n_tokens").alias("tokens")))
    now = cells.select(*(F.coalesce(F.sum(F.col("tokens") * F.col("p")[i]), F.lit(0.0)).alias(f"d{i}") for i in range(k))).first()
    present = np.array([float(x) for x in now])
    wanted = np.array([float(weights[d]) for d in domains])
    if relative:
        targets = wanted * present
    else:
        targets = wanted / max(wanted.sum(), 1e-12) * (present.sum() if total is None else total)
    rule = fit_rates(cells, targets, max_rate=max_rate)

    place = docs.columns.index("text")
    added = "n_tokens long, domain_posteriors array<double>, rate double"
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(added).fields])

    # Rates follow from texts alone, so that rows need not be found again after the fit.
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p = _judged(batch, place, model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens), _lists(p), pa.array(rule.rates(p)[0])], schema.names)

    return docs.mapInArrow(rate, schema)


def copies(doc_id: Column, rate: Column) -> Column:
    """A whole number of copies whose expectation over ids is the rate; the same id gets the same number."""
    draw = F.pmod(F.xxhash64(F.lit("mixing"), doc_id), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from a table of quality and toxicity labels."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL")
