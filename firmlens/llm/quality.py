"""Quality by co-training: one classifier reads the text, one the metadata, and each teaches the other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.sampling import bounded, held_out
from firmlens.llm.toxicity import calibrate

TEXT_BUCKETS = 512
META_BUCKETS = 64
CHUNK = 1 << 16  # characters of a text whose counts are added up at a time


def text_view(text: str | None) -> np.ndarray:
    """Shares of character classes, shapes of words, repetition of lines and hashed character pairs, over the whole text."""
    text = text or ""
    hashed = np.zeros(TEXT_BUCKETS)
    upper = lower = digit = space = other = bang = 0
    for lo in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[lo : lo + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        u, lw = int(((codes >= 65) & (codes <= 90)).sum()), int(((codes >= 97) & (codes <= 122)).sum())
        d, sp = int(((codes >= 48) & (codes <= 57)).sum()), int(((codes == 32) | ((codes >= 9) & (codes <= 13))).sum())
        upper, lower, digit, space = upper + u, lower + lw, digit + d, space + sp
        other += int((codes < 128).sum()) - u - lw - d - sp
        bang += int((codes == 33).sum())
        if len(codes) > 1:
            pairs = (codes[:-1].astype(np.uint64) * np.uint64(1_000_003) + codes[1:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            hashed += np.bincount((pairs >> np.uint64(55)).astype(np.int64), minlength=TEXT_BUCKETS)
    n = max(len(text), 1)
    lines = text.split("\n")
    words = text.split()
    n_words = max(len(words), 1)
    shape = [
        upper / n, lower / n, digit / n, space / n, other / n, bang / n, np.log1p(len(text)) / 10, len(set(lines)) / len(lines), len(set(words)) / n_words, np.log1p(len(words) / len(lines)) / 5,
        sum(w in ("|", "-", "*", "•") for w in words) / n_words, sum(not w[-1].isalnum() for w in words) / n_words, np.log1p(n / n_words) / 5,
    ]
    return np.concatenate([shape, np.sqrt(hashed / n)])


def meta_view(lang: str | None, source: str | None, n_chars) -> np.ndarray:
    """Hashed language and source, and the recorded length in steps; nothing of the text itself."""
    x = np.zeros(META_BUCKETS + 24)
    for name, value in (("lang", lang), ("source", source)):
        x[zlib.crc32(f"{name}={value}".encode()) % META_BUCKETS] = 1.0
    size = np.log2(1.0 + max(float(n_chars), 0.0)) if n_chars is not None and n_chars == n_chars else 0.0
    x[META_BUCKETS + min(int(size), 22)] = 1.0
    x[-1] = size / 20
    return x


@dataclass
class View:
    """Regularised logistic regression on standardised features, with a calibration curve."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0

    def _blocks(self, x: np.ndarray, rows: int = 1024) -> Iterator[tuple[slice, np.ndarray]]:
        """Standardised features with a column of ones, some rows at a time."""
        for lo in range(0, len(x), rows):
            part = x[lo : lo + rows].astype(float)
            yield slice(lo, lo + len(part)), np.c_[np.clip((part - self.mean) / self.scale, -8, 8), np.ones(len(part))]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 3.0, rounds: int = 12) -> View:
        self.mean, self.scale = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-6
        w = np.zeros(x.shape[1] + 1)
        ridge = np.full(len(w), decay)
        ridge[-1] = 1e-6
        for _ in range(rounds):
            h, slope = np.diag(ridge), ridge * w
            for at, z in self._blocks(x):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                h = h + (z * (weight[at] * p * (1 - p) + 1e-9)[:, None]).T @ z
                slope = slope + z.T @ (weight[at] * (p - y[at]))
            move = np.linalg.solve(h, slope)
            w -= move
            if np.abs(move).max() < 1e-6:
                break
        self.weights = w
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return np.concatenate([z @ self.weights for _, z in self._blocks(x)]) if len(x) else np.zeros(0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(x) + self.shift, -30, 30)


def co_train(
    text_x: np.ndarray, meta_x: np.ndarray, y: np.ndarray, rounds: int = 4, confident: float = 0.95, grow: int = 400, pseudo_weight: float = 0.3, seed: int = 5,
) -> tuple[View, View, float, float, float]:
    """Two calibrated views and the weights that join them: (text, metadata, weight of text, weight of metadata, shift).

    ``y`` is 0 or 1, or -1 where unlabelled. A fifth of the labelled rows is set aside for calibration. In every round each view labels the
    unlabelled rows it is surest of (at most ``grow``, at probability ``confident`` or more) for the other view.
    """
    rng = np.random.default_rng(seed)
    known = np.flatnonzero(y >= 0)
    views = (View(), View())
    if len(known) == 0 or len(set(y[known])) < 2:
        return *views, 0.0, 0.0, float(y[known[0]] * 4 - 2) if len(known) else 0.0
    aside = known[rng.permutation(len(known))[: len(known) // 5]]
    if len(set(y[aside])) < 2:
        aside = known
    base = np.setdiff1d(known, aside) if len(aside) < len(known) else known
    if len(set(y[base])) < 2:
        base = known
    data = (text_x, meta_x)
    given: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in range(rounds + 1):
        for v in (0, 1):
            extra = np.array(list(given[v]), int)
            rows = np.concatenate([base, extra]).astype(int)
            target = np.concatenate([y[base], [given[v][i] for i in extra]]).astype(float)
            weight = np.concatenate([np.ones(len(base)), np.full(len(extra), pseudo_weight)])
            views[v].fit(data[v][rows], target, weight)
            views[v].slope, views[v].shift = calibrate(views[v].margin(data[v][aside]), y[aside].astype(float))
        if r == rounds:
            break
        for v in (0, 1):
            open_rows = np.array([i for i in np.flatnonzero(y < 0) if i not in given[1 - v]], int)
            if not len(open_rows):
                continue
            p = 1 / (1 + np.exp(-views[v].logit(data[v][open_rows])))
            sure = np.maximum(p, 1 - p)
            best = np.argsort(-sure, kind="stable")[:grow]
            best = best[sure[best] >= confident]
            given[1 - v].update({int(open_rows[i]): int(p[i] >= 0.5) for i in best})
    joint = np.c_[views[0].logit(text_x[aside]), views[1].logit(meta_x[aside]), np.ones(len(aside))]
    w = np.array([1.0, 0.5, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(joint @ w, -30, 30)))
        h = (joint * (p * (1 - p))[:, None]).T @ joint + 0.1 * np.eye(3)
        w = w - np.clip(np.linalg.solve(h, joint.T @ (p - y[aside]) + 0.1 * (w - np.array([1.0, 0.5, 0.0]))), -1, 1)
    return *views, float(w[0]), float(w[1]), float(w[2])


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_labelled: int = 6000, max_unlabelled: int = 6000, threshold: float = 0.5, seed: int = 17, **options,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``text_score``, ``meta_score``, ``score`` (probability of good quality), ``predicted``.

    Views are trained on at most ``max_labelled`` labelled and ``max_unlabelled`` unlabelled documents, chosen by hash outside the held-out
    quarter. ``docs`` needs ``text``, ``lang``, ``source`` and ``n_chars``; the text view sees the text alone, the metadata view the rest alone.

    Null and empty texts score by the views' values for empty input; nulls in metadata are values of their own. Without labels of both kinds every
    document gets one score. Labels that disagree on a repeated id count as good; null labels are ignored, as are a null id's.
    Repeated rows get equal scores. Other columns are ignored. An empty table gives an empty table.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"),
    )
    marked = labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    known = source.select("doc_id").where("doc_id is not null").distinct()
    picked = bounded(known.join(marked, "doc_id"), max_labelled, seed)
    free = bounded(known.where(~held_out()).join(marked, "doc_id", "left_anti"), max_unlabelled, seed).withColumn("y", F.lit(-1))
    ids = docs.sparkSession.createDataFrame(sorted((r[0], r[1]) for r in picked.union(free).collect()), "doc_id long, y int")

    def views(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({
                "y": f["y"], "t": [text_view(x).astype("float32").tobytes() for x in f["text"]],
                "m": [meta_view(*x).astype("float32").tobytes() for x in zip(f["lang"], f["source"], f["n_chars"], strict=True)],
            })

    # Packed features of the sample: about 2.5 KB a row, 30 MB with the default sizes.
    rows = source.join(F.broadcast(ids), "doc_id").mapInPandas(views, "y int, t binary, m binary").toPandas()
    matrix = lambda c: np.frombuffer(b"".join(rows[c]), np.float32).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.float32)
    text_x, meta_x, y = matrix("t"), matrix("m"), rows["y"].to_numpy().astype(int)
    del rows
    order = np.lexsort((text_x[:, 0], text_x[:, 6], text_x[:, 8])) if len(y) else np.zeros(0, int)
    trained = docs.sparkSession.sparkContext.broadcast(co_train(text_x[order], meta_x[order], y[order], **options))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, meta, a, b, c = trained.value
        for f in frames:
            out = f[["doc_id", "held_out"]].copy()
            t, m = np.zeros(len(f)), np.zeros(len(f))
            for lo in range(0, len(f), 512):
                part = f.iloc[lo : lo + 512]
                t[lo : lo + 512] = text.logit(np.array([text_view(x) for x in part["text"]]))
                m[lo : lo + 512] = meta.logit(np.array([meta_view(*x) for x in zip(part["lang"], part["source"], part["n_chars"], strict=True)]))
            squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            out["text_score"], out["meta_score"], out["score"] = squash(t), squash(m), squash(a * t + b * m + c)
            out["predicted"] = (out["score"] >= threshold).astype("int32")
            yield out

    return source.withColumn("held_out", held_out()).mapInPandas(run, "doc_id long, held_out boolean, text_score double, meta_score double, score double, predicted int")
