"""Nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from firmlens.llm.sampling import bounded
from firmlens.session import materialise


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, one of them not 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """At most ``k`` centroids; farther points are likelier to start one."""
    rng = np.random.default_rng(seed)
    centres = points[rng.integers(len(points))][None]
    near = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k and near.max() > 0:
        centres = np.vstack([centres, points[rng.choice(len(points), p=near / near.sum())]])
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = assign(points, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def assign(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2.0 * points @ centres.T).argmin(1)


def cells_in_order(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Non-empty cells by summed half distances until they hold ``enough`` entries: the multi-sequence walk over two sorted lists."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def search(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
    centroids: int = 64, share: float = 0.5, at_least: int = 2000, sample: int = 20_000, block: int = 2048, query_block: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where ``queries`` holds, the ``k`` nearest other rows found, by Euclidean distance.

    Both halves of the vectors have ``centroids`` centroids, fitted on at most ``sample`` hash-chosen rows; every distinct vector is an
    entry of one cell. A query walks cells by summed half distance until they hold ``share`` of all entries, and ``at_least`` so many, and is compared
    with every entry there. Equal vectors are one entry with their k + 1 smallest ids, which no answer can exceed. Neighbouring cells form blocks of
    about ``block`` entries, a crowded cell fills several, and queries come in blocks of about ``query_block``, so a task holds one block of each.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a null id take no part; vectors of another
    length than most of the sample's raise an error. Ties go to the smaller id. A repeated id keeps each of its vectors. Fewer than ``k``
    other rows give fewer answers; an empty table gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), queries.alias("asks"))
    fitted = [r[0] for r in bounded(rows.select("vec_id", "v"), sample, 5, "vec_id").select("v").collect()]
    schema = "query_id long, rank int, vec_id long, score double"
    if not fitted:
        return spark.createDataFrame([], schema)
    width = int(np.bincount([len(x) for x in fitted]).argmax())
    points = np.array([x for x in fitted if len(x) == width])
    half = width // 2
    left = k_means(points[:, :half], centroids) if half else np.zeros((1, 0))
    right = k_means(points[:, half:], centroids)

    def to_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.array(frame["v"].tolist())
                yield frame.assign(cell=(assign(x[:, :half], left) * len(right) + assign(x[:, half:], right)).astype("int32"))

    first = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    same = rows.select("vec_id", "v", first.alias("first")).where(F.col("first") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    checked = F.assert_true(F.size("v") == width, F.lit("vectors differ in length")).isNull()
    entries = materialise(same.where(checked).mapInPandas(to_cells, "v array<double>, ids array<long>, cell int"), "entries")
    counts = np.zeros(len(left) * len(right), np.int64)
    for cell, n in entries.groupBy("cell").count().collect():  # at most centroids squared rows
        counts[cell] = n
    enough = max(int(np.ceil(share * counts.sum())), at_least)
    # a cell's entries fill blocks first .. first + parts - 1; small neighbouring cells share one
    begin = np.concatenate(([0], np.cumsum(counts)[:-1])) // block
    parts = np.maximum(1, -(-counts // block))
    table = spark.createDataFrame([(int(c), int(begin[c]), int(parts[c])) for c in np.flatnonzero(counts)], "cell int, begin int, parts int")
    n_asked = rows.where("asks").count()
    q_blocks = max(1, -(-n_asked // query_block))
    placed = entries.join(F.broadcast(table), "cell").select(
        (F.col("begin") + F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"), "cell", "v", "ids",
    )

    def to_probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for query_id, q_block, q in zip(frame["query_id"], frame["q_block"], frame["v"], strict=True):
                x = np.asarray(q)
                walk = np.array(cells_in_order(((left - x[:half]) ** 2).sum(1), ((right - x[half:]) ** 2).sum(1), counts, enough), np.int32)
                by_block: dict[int, list[int]] = {}
                for c in walk:
                    for b in range(begin[c], begin[c] + parts[c]):
                        by_block.setdefault(b, []).append(c)
                yield pd.DataFrame({
                    "block": np.array(list(by_block), np.int32), "q_block": np.int32(q_block), "query_id": np.int64(query_id), "v": [q] * len(by_block), "cells": list(by_block.values()),
                })

    def compare(entry: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entry) and len(asked):
            x, cells = np.array(entry["v"].tolist()), entry["cell"].to_numpy()
            ids = entry["ids"].tolist()
            for query_id, q, walk in zip(asked["query_id"], asked["v"], asked["cells"], strict=True):
                at = np.flatnonzero(np.isin(cells, walk))
                score = np.sqrt(((x[at] - np.asarray(q)) ** 2).sum(1))
                cut = np.sort(score)[min(k, len(score) - 1)] if len(score) else 0.0  # one entry may be the query's own
                near = [(score[i], vec, query_id) for i in np.flatnonzero(score <= cut) for vec in ids[at[i]] if vec != query_id]
                out += sorted(near)[:k]
        return pd.DataFrame({"query_id": [o[2] for o in out], "vec_id": [o[1] for o in out], "score": [o[0] for o in out]}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("q_block"), "v")
    probes = asked.mapInPandas(to_probes, "block int, q_block int, query_id long, v array<double>, cells array<int>")
    keys = ["block", "q_block"]
    found = placed.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
