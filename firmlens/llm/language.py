"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.sampling import bounded, held_out
from firmlens.llm.text import letter_runs

PIECE = 24  # bytes of one sequence; a longer run of letters is several sequences
EDGE = 32  # the byte on both sides of a sequence
CACHE = 400_000  # sequences whose label sums a task remembers
LOGITS = 50  # positions after which more text no longer raises the score


def sequences(text: str | None) -> list[bytes]:
    out: list[bytes] = []
    for run in letter_runs(text):
        if len(run) <= PIECE:
            out.append(run)
        else:
            out += [run[i : i + PIECE] for i in range(0, len(run), PIECE)]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


@dataclass
class BiGru:
    """Embedding, one gated recurrent layer in each direction, and a linear layer that labels every position."""

    n_labels: int
    hidden: int = 24
    embed: int = 12
    seed: int = 9
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        h, e = self.hidden, self.embed
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": (0.3 * r.standard_normal((256, e))).astype(np.float32), "O": scale(2 * h, self.n_labels), "o": np.zeros(self.n_labels, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": scale(e, 3 * h), f"U{d}": scale(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}

    def _layer(self, d: str, x: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (T, N, H) for inputs (T, N, E); ``keep`` gets what the backward pass needs."""
        h, n = self.hidden, x.shape[1]
        steps = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        u = self.p[f"U{d}"]
        state = np.zeros((n, h), np.float32)
        out = np.empty((len(x), n, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = state @ u[:, : 2 * h]
            gates = _sigmoid(steps[t, :, : 2 * h] + a)
            z, r = gates[:, :h], gates[:, h:]
            part = state @ u[:, 2 * h :]
            new = np.tanh(steps[t, :, 2 * h :] + r * part)
            if keep is not None:
                keep.append((t, state, z, r, part, new))
            state = z * state + (1 - z) * new
            out[t] = state
        return out

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """(T, N) bytes -> (T, N, labels) log probabilities."""
        x = self.p["E"][codes]
        s = np.concatenate([self._layer("f", x, None), self._layer("b", x, None)], 2) @ self.p["O"] + self.p["o"]
        s -= s.max(2, keepdims=True)
        return s - np.log(np.exp(s).sum(2, keepdims=True))

    def gradients(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by backpropagation through time; every position of sequence n has the label distribution ``target[n]``."""
        h, p = self.hidden, self.p
        x = p["E"][codes]
        kept: dict[str, list] = {"f": [], "b": []}
        states = [self._layer(d, x, kept[d]) for d in "fb"]
        both = np.concatenate(states, 2)
        s = both @ p["O"] + p["o"]
        s -= s.max(2, keepdims=True)
        q = np.exp(s)
        q /= q.sum(2, keepdims=True)
        w = (weight / (weight.sum() * len(codes))).astype(np.float32)[None, :, None]
        loss = float(-(w * target[None] * np.log(q + 1e-9)).sum())
        ds = w * (q - target[None]) * target.sum(1)[None, :, None]
        g = {"O": np.einsum("tnh,tnl->hl", both, ds), "o": ds.sum((0, 1))}
        dx = np.zeros_like(x)
        d_both = ds @ p["O"].T
        for d, part_of in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            u, w_in = p[f"U{d}"], p[f"W{d}"]
            du, later = np.zeros_like(u), np.zeros((x.shape[1], h), np.float32)
            d_steps = np.zeros((len(x), x.shape[1], 3 * h), np.float32)
            for t, state, z, r, part, new in reversed(kept[d]):
                dh = part_of[t] + later
                d_new = dh * (1 - z) * (1 - new * new)
                dz = dh * (state - new) * z * (1 - z)
                dr = d_new * part * r * (1 - r)
                gates = np.concatenate([dz, dr], 1)
                d_steps[t, :, : 2 * h], d_steps[t, :, 2 * h :] = gates, d_new
                d_part = d_new * r
                du[:, : 2 * h] += state.T @ gates
                du[:, 2 * h :] += state.T @ d_part
                later = dh * z + gates @ u[:, : 2 * h].T + d_part @ u[:, 2 * h :].T
            g |= {f"U{d}": du, f"W{d}": np.einsum("tne,tnh->eh", x, d_steps), f"c{d}": d_steps.sum((0, 1))}
            dx += d_steps @ w_in.T
        ge = np.zeros_like(p["E"])
        np.add.at(ge, codes.ravel(), dx.reshape(-1, dx.shape[2]))
        return loss, g | {"E": ge}

    def fit(self, pieces: list[bytes], target: np.ndarray, weight: np.ndarray, steps: int = 900, batch: int = 256, rate: float = 0.01) -> BiGru:
        r = np.random.default_rng(self.seed)
        lengths = np.array([len(x) for x in pieces])
        by_length = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths)}
        chance = np.array([weight[i].sum() * n for n, i in by_length.items()])
        sizes = list(by_length)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for t in range(1, steps + 1):
            own = by_length[sizes[r.choice(len(sizes), p=chance / chance.sum())]]
            at = own[r.choice(len(own), size=min(batch, len(own)), replace=False)]
            _, g = self.gradients(padded([pieces[i] for i in at]), target[at].astype(np.float32), weight[at])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            slow = rate * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, x in g.items():
                x = x * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - slow * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def label_sums(self, pieces: list[bytes]) -> np.ndarray:
        """Sum over the positions of each sequence of the log probabilities of the labels."""
        out = np.zeros((len(pieces), self.n_labels), np.float32)
        lengths = np.array([len(x) for x in pieces])
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            for lo in range(0, len(own), 4096):
                at = own[lo : lo + 4096]
                out[at] = self.log_probs(padded([pieces[i] for i in at])).sum(0)
        return out


def padded(pieces: list[bytes]) -> np.ndarray:
    """(length + 2, N) bytes of sequences of one length, with an edge on both sides."""
    body = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)
    edge = np.full((len(pieces), 1), EDGE, np.uint8)
    return np.concatenate([edge, body, edge], 1).T


def train(docs: DataFrame, max_docs: int = 3000, max_pieces: int = 60_000, seed: int = 13) -> tuple[list[str], BiGru | None]:
    """Languages and network, from at most ``max_docs`` documents outside the held-out quarter and ``max_pieces`` of their distinct sequences.

    A sequence's target is the share of each language among its occurrences, with languages weighted alike.
    """
    chosen = bounded(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id"), max_docs, seed).distinct()
    ids = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long")
    texts = docs.join(F.broadcast(ids), "doc_id").where("lang is not null").select("lang", "text")  # at most max_docs ids

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                yield pd.DataFrame({"lang": lang, "piece": sequences(text)}, columns=["lang", "piece"]).astype({"piece": object})

    counted = texts.mapInPandas(cut, "lang string, piece binary").groupBy("lang", "piece").count()
    langs = sorted(r[0] for r in texts.select("lang").distinct().collect())
    if not langs:
        return [], None
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("count")).collect()}
    scaled = F.map_from_arrays(F.array(*[F.lit(x) for x in langs]), F.array(*[F.lit(1.0 / totals.get(x, 1)) for x in langs]))
    table = counted.groupBy("piece").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.col("count") * scaled[F.col("lang")]))).alias("share"), F.sum("count").alias("n"))
    rows = table.orderBy(F.xxhash64("piece"), "piece").limit(max_pieces).collect()
    if not rows:
        return langs, None
    at = {x: i for i, x in enumerate(langs)}
    target = np.zeros((len(rows), len(langs)))
    for i, row in enumerate(rows):
        for lang, share in row["share"].items():
            target[i, at[lang]] = share
    target /= target.sum(1, keepdims=True)
    weight = np.log1p(np.array([r["n"] for r in rows], float))
    return langs, BiGru(len(langs)).fit([bytes(r["piece"]) for r in rows], target, weight)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (the pooled probability of that language).

    Every position of every run of letters in the whole text is labelled; the state starts anew at each run, so equal runs have equal
    labels and a task labels a run once. The document's probabilities pool the positions' log probabilities: their mean times
    min(positions, ``LOGITS``), normalised.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing could be learned. Ties go to the language first
    in alphabetical order. Repeated rows get equal answers. A null id is answered, never learned from. An empty table gives an empty table. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(train(source, **options))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, net = shared.value
        known: dict[bytes, int] = {}
        table, sizes = np.zeros((0, len(langs)), np.float32), np.zeros(0)
        for frame in frames:
            names, scores = [], []
            for lo in range(0, len(frame), 256):
                cut = [sequences(t) if t and net is not None and any(map(str.isalpha, t)) else [] for t in frame["text"].iloc[lo : lo + 256]]
                fresh = list(set().union(*cut) - known.keys())
                if len(known) + len(fresh) > CACHE:
                    known, table, sizes = {}, table[:0], sizes[:0]
                    fresh = list(set().union(*cut))
                if fresh:
                    known.update(zip(fresh, range(len(table), len(table) + len(fresh)), strict=True))
                    table = np.concatenate([table, net.label_sums(fresh)])
                    sizes = np.concatenate([sizes, [len(x) + 2 for x in fresh]])
                for pieces in cut:
                    if not pieces:
                        names.append("und"), scores.append(0.0)
                        continue
                    at = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
                    n = sizes[at].sum()
                    mean = table[at].sum(0, dtype=np.float64) / n * min(n, LOGITS)
                    prob = np.exp(mean - mean.max())
                    best = int(prob.argmax())
                    names.append(langs[best]), scores.append(float(prob[best] / prob.sum()))
            yield frame[["doc_id", "held_out"]].assign(lang_pred=names, score=scores)

    return source.withColumn("held_out", held_out()).select("doc_id", "held_out", "text").mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
