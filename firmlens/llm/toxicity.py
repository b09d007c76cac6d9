"""Toxicity by non-negative positive-unlabelled learning on subword presence."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.sampling import bounded, held_out
from firmlens.llm.text import letter_runs

CACHE = 200_000  # words whose features a task remembers
ROWS = 256  # texts turned into Python strings at a time


def word_features(word: bytes) -> tuple[int, ...]:
    """Ids of the word, its beginnings of 3 to 6 characters and its endings of 4 and 5."""
    w = word.decode("utf-8", "ignore")
    parts = {"=" + w} | {"^" + w[:k] for k in (3, 4, 5, 6) if len(w) >= k} | {w[-k:] + "$" for k in (4, 5) if len(w) >= k}
    return tuple(zlib.crc32(p.encode()) for p in parts)


class Featurizer:
    """Distinct feature ids of a text, those in ``wanted`` if given."""

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted, self.cache = wanted, {}

    def __call__(self, text: str | None) -> set[int]:
        found: set[int] = set()
        for word in set(letter_runs(text)):
            ids = self.cache.get(word)
            if ids is None:
                ids = word_features(word)
                if self.wanted is not None:
                    ids = tuple(self.wanted[i] for i in ids if i in self.wanted)
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[word] = ids
            if ids:
                found.update(ids)
        return found


@dataclass
class Model:
    index: dict[int, int]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, features: set[int]) -> float:
        return self.bias + float(self.weights[list(features)].sum()) if features else self.bias

    def score(self, margin) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.asarray(margin) + self.shift, -500, 500)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``ROWS`` rows: a batch may hold all texts of a task, and a worker keeps what it once took."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def fit_nnpu(positive: list, unlabelled: list, size: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam on the whole sample.

    risk = prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]). Where the second part falls below ``-beta`` the step
    goes up its gradient instead, so the classifier cannot gain by driving it negative.
    """
    rows = [np.fromiter(x, np.int64, len(x)) for x in [*positive, *unlabelled]]
    n_pos, n_all = len(positive), len(rows)
    columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n_all), [len(r) for r in rows])
    is_pos = np.arange(n_all) < n_pos
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, steps + 1):
        f = b + np.bincount(owner, weights=w[columns], minlength=n_all)
        s = sigmoid(f)
        soft = np.logaddexp(0.0, f)
        unl = soft[n_pos:].mean() if n_all > n_pos else 0.0
        negative = unl - prior * (soft[:n_pos].mean() if n_pos else 0.0)
        up = np.where(is_pos, -(1 - s) / max(n_pos, 1) * prior, 0.0)
        down = np.where(is_pos, -prior * s / max(n_pos, 1), s / max(n_all - n_pos, 1))
        g = up + down if negative >= -beta else -down
        grad = np.append(np.bincount(columns, weights=g[owner], minlength=size) + decay * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def calibrate(margins: np.ndarray, labels: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), by damped Newton steps; identity without both labels."""
    if len(labels) == 0 or labels.min() == labels.max():
        return 1.0, 0.0
    a = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], 1)
    target = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / (len(labels) - labels.sum() + 2))
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ a, -500, 500)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (p - target))
        a = a - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return float(max(a[0], 1e-6)), float(a[1])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 8000, max_negative: int = 4000, max_features: int = 20_000, evidence: float = 8.0, seed: int = 7) -> Model:
    """Fit on bounded, hash-chosen samples of rows outside the held-out quarter.

    Positives are documents labelled toxic; unlabelled text comes from documents without a label (from all, if every one
    has one). Features are those more common in positives by a likelihood ratio above ``evidence``, so few positives mean few features. The class prior is the share of toxic labels. Labelled rows, positive and negative, also fix the calibration curve.
    """
    # a label for a document: repeated rows that disagree count as toxic; null labels are none
    marked = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = marked.agg(F.avg("toxic")).first()[0]
    prior = min(max(prior if prior is not None else 0.1, 1e-3), 0.9)
    known = docs.select("doc_id").where("doc_id is not null").distinct()
    free = known.where(~held_out()).join(marked, "doc_id", "left_anti")
    if not free.limit(1).count():
        free = known.where(~held_out())
    picked = bounded(known.join(marked.where("toxic = 1"), "doc_id"), max_positive, seed).select("doc_id", F.lit(1).alias("part"))
    picked = picked.union(bounded(known.join(marked.where("toxic = 0"), "doc_id"), max_negative, seed).select("doc_id", F.lit(2).alias("part")))
    picked = picked.union(bounded(free, max_unlabelled, seed).select("doc_id", F.lit(0).alias("part")))
    chosen = {(r[0], r[1]) for r in picked.collect()}
    pairs = sorted(chosen)
    # from Arrow: rows from a list pass through Python workers of another kind, which stay beside those of the text
    table = pa.table({"doc_id": pa.array([p[0] for p in pairs], pa.int64()), "part": pa.array([p[1] for p in pairs], pa.int32())})
    parts = docs.sparkSession.createDataFrame(table, "doc_id long, part int")
    texts = docs.join(F.broadcast(parts), "doc_id").select("part", "text")  # bounded by the sample sizes

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer()
        for batch in _parts(batches):
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = make(text)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), part, np.int32)), pa.array(np.fromiter(found, np.int64, len(found)))], ["part", "feature"])

    sizes = {r[0]: r[1] for r in parts.groupBy("part").count().collect()}
    n_pos, n_unl = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    share_p, share_u = (F.col("p") + 0.5) / (n_pos + 1.0), (F.col("u") + 0.5) / (n_unl + 1.0)
    gain = share_p * F.log(share_p / share_u) + (1 - share_p) * F.log((1 - share_p) / (1 - share_u))
    counted = texts.where("part < 2").mapInArrow(grams, "part int, feature long").groupBy("feature").agg(
        F.sum(F.expr("int(part = 1)")).alias("p"), F.sum(F.expr("int(part = 0)")).alias("u")
    ).where("p + u >= 3")
    features = [r[0] for r in counted.where((gain * n_pos > evidence) & (share_p > share_u)).orderBy(F.desc(gain), "feature").limit(max_features).select("feature").collect()]
    index = {f: k for k, f in enumerate(features)}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(shared.value)
        for batch in _parts(batches):
            ids = [np.array(sorted(make(t)), np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["part", "ids"])

    rows = texts.mapInArrow(encode, "part int, ids binary").collect()
    of = lambda part: [np.frombuffer(r[1], np.int32) for r in rows if r[0] == part]
    positive, negative = of(1), of(2)
    weights, bias = fit_nnpu(positive, of(0), len(index), prior) if positive else (np.zeros(len(index)), -3.0)
    model = Model(index, weights, bias)
    if positive and negative:
        margins = np.array([model.margin(set(x.tolist())) for x in [*positive, *negative]])
        marks = np.r_[np.ones(len(positive)), np.zeros(len(negative))]
        model.slope, model.shift = calibrate(margins, marks)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``).

    Inputs of a score are the words of the whole text alone. Null and empty texts have no features and get the score of the bias.
    Without toxic labels every score is the same low number. Repeated rows get equal scores; a null id is scored, never learned from.
    Label rows of unknown documents are ignored. Other columns of either table are ignored. An empty table gives an empty table.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(source, labels.select("doc_id", "toxic"), **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model.value
        make = Featurizer(use.index)
        for batch in _parts(batches):
            ids, texts, held = batch.columns
            scores = use.score([use.margin(make(t)) for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return source.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged; a filter in one pass without a shuffle."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(source, labels.select("doc_id", "toxic"), **options))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model.value
        make = Featurizer(use.index)
        for batch in _parts(batches):
            scores = use.score([use.margin(make(t)) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
