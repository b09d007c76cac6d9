"""Importance resampling towards a target distribution: hashed n-gram features, log-ratio weights, Gumbel top-k draw.

Words come out of UTF-8 bytes by one table and ``bytes.split``; the checksum of a run of words is the checksum of its head,
chained on by one word, so no run is ever put together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.sides import keyed, let
from firmlens.llm.text import byte_views
from firmlens.operators.ordered import rank_rows
from firmlens.session import materialise

#: Lower-cases A-Z and blanks every ASCII byte that is neither digit nor letter; bytes of other characters stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at once; a long text is worked through in such blocks.
BLOCK = 1 << 20


def word_blocks(data: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time. A word longer than a block stays whole."""
    at, n = 0, len(data)
    while at < n:
        end = at + block
        if end < n:
            space = data.find(b" ", end)
            end = n if space < 0 else space
        words = data[at:end].split()
        at = end
        if words:
            yield words


def hashed_runs(words: list[bytes], tail: list[bytes], width: int) -> Iterator[int]:
    """crc32 of every run of 1 to ``width`` words, joined by one space, that ends in ``words``; ``tail`` are the words before them."""
    every = tail + words
    level = list(map(crc32, every))
    yield from level[len(tail):]
    spaced = [b" " + w for w in every]
    for k in range(2, width + 1):
        level = list(map(crc32, spaced[k - 1:], level))
        yield from level[max(len(tail) - k + 1, 0):]


def features(data: bytes, buckets: int, width: int) -> Iterator[tuple[int, list[int]]]:
    """(number of words, buckets of the features that end in them), block by block, of a text in UTF-8."""
    tail: list[bytes] = []
    for words in word_blocks(data.translate(TABLE)):
        yield len(words), [h % buckets for h in hashed_runs(words, tail, width)]
        tail = (tail + words)[-(width - 1):] if width > 1 else []


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    raw, at = byte_views(batch.column(name))
    for row in range(batch.num_rows):
        yield raw[at[row]:at[row + 1]].tobytes()


def bucket_counts(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket; each task sends at most ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for data in _texts(batch, "text"):
                for _, found in features(data, buckets, width):
                    counts.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln of the ratio of smoothed shares, target over corpus) of each bucket."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def _weigh(gains: list[int], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.__getitem__
        for batch in batches:
            words, runs, weights = [], [], []
            for data in _texts(batch, "text"):
                n = m = total = 0
                for count, found in features(data, len(gains), width):
                    n, m, total = n + count, m + len(found), total + sum(map(gain, found))
                words.append(n)
                runs.append(m)
                weights.append(total // m if m else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(x, pa.int64()) for x in (words, runs, weights))], [*batch.schema.names[:-1], "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, target: DataFrame, buckets: int = 10_000, width: int = 2, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, kept columns, n_words, n_features, weight) of every row of ``docs``.

    Features are runs of 1 to ``width`` words in crc32 buckets, repeats counted. A bucket's gain compares its share in all of ``target`` with its
    share in all of ``docs``; ``weight`` is the floored mean gain of a document's features. Both counts cover every row; of size
    ``buckets``, they are all that reaches the driver. The texts are read twice and never shuffled.

    Null and empty texts, and texts without words, have no features and weight 0. An empty target makes all shares of it equal.
    """
    keep = keep or []
    text = F.col(text_col).cast("string").alias("text")
    corpus = {r.bucket: r.n for r in bucket_counts(docs.select(text), buckets, width).collect()}
    wanted = {r.bucket: r.n for r in bucket_counts(target.select(F.col(target_text).cast("string").alias("text")), buckets, width).collect()}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in keep], text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_weigh(bucket_gains(corpus, wanted, buckets), width), f"{fields}, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``weighed`` with ``score`` and ``rank``: weight plus Gumbel noise hashed from seed and id, and the place among the drawn.

    Of the documents with at least ``least_words`` words, floor(percent / 100 of them) with the highest scores are drawn, without replacement, ties to
    the smaller id (null last); the rank of others is null. A null id is hashed like an empty one. Ranks come from one range-partitioned sort
    of narrow rows and the sizes of its parts; no task holds all rows, and equal scores or ids do not gather in one.
    """
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    noise = let((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0), lambda u: F.floor(F.lit(-1000.0) * F.log(-F.log(u))))
    # The row number breaks ties of equal ids, so that the sort can split them over tasks; which of two equal rows comes first makes no difference.
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise).withColumn("_tie", F.monotonically_increasing_id()), "weighed")
    able = F.col("n_words") >= least_words
    quota = scored.where(able).count() * percent // 100
    placed = rank_rows(scored.withColumn("_short", (~able).cast("int")), [], [F.asc("_short"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_tie")])
    return placed.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))).drop("_short", "_tie")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, to look like ``target``; see :func:`weigh` and :func:`draw`.

    Repeated rows are drawn one by one and share their noise, so equal rows are drawn together as far as the quota goes. An empty table gives an empty table.
    """
    rows, key = keyed(docs, "resample")
    drawn = draw(weigh(rows, target, id_col=id_col, text_col=text_col, keep=[key], **options), percent, least_words, seed).where("rank IS NOT NULL")
    return rows.join(drawn.select(key), key, "left_semi").select(*docs.columns)
