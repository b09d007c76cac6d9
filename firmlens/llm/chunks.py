"""Substring deduplication by content-defined chunks of a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from firmlens.llm.sides import free
from firmlens.llm.text import BASE, INVERSE, _powers, byte_views, mix, pieces
from firmlens.session import materialise

GEAR = mix(np.arange(1000, 1256, dtype=np.uint64))
#: Bytes that decide a cut. The gear hash shifts by one bit a byte, so bit b depends on b + 1 bytes.
WINDOW = 16


def cut_places(data: np.ndarray, mask_bits: int) -> np.ndarray:
    """Whether the gear hash of the bytes up to each place asks for a cut after it.

    h[i] = 2 h[i-1] + gear[byte i]; its bits below ``WINDOW`` follow from the last ``WINDOW`` bytes alone and are computed by doubling.
    """
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        later = h.copy()
        later[step:] += h[:-step] << np.uint64(step)
        h = later
        step *= 2
    top = np.uint64(((1 << mask_bits) - 1) << (WINDOW - mask_bits))
    return (h & top) == 0


def chunk_ends(wanted: np.ndarray, starts_char: np.ndarray, length: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of one text: wanted cuts at least ``least`` bytes apart, forced after ``most`` bytes, between characters."""
    ends: list[int] = []
    begin, i = 0, 0
    while begin < length:
        while i < len(wanted) and wanted[i] - begin < least:
            i += 1
        end = int(wanted[i]) if i < len(wanted) else length
        if end - begin > most:
            end = begin + most
            while end < length and not starts_char[end]:
                end += 1
        ends.append(min(end, length))
        begin = ends[-1]
    return ends


def _chunks(mask_bits: int, least: int, most: int):
    names = ["doc_id", "n", "start", "end", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = byte_views(batch.column(1))
            ids = batch.column(0)
            for lo, hi in pieces(at):
                first = at[lo]
                data = raw[first : at[hi]]
                if not len(data):
                    continue
                heads = (data & 0xC0) != 0x80
                chars = np.concatenate(([0], np.cumsum(heads)))
                code = mix(np.arange(1, 257, dtype=np.uint64))[data]
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(code * _powers("base", BASE, len(data)), out=sums[1:])
                back = _powers("inverse", INVERSE, len(data))
                rows, numbers, begins, ends = [], [], [], []
                for row in range(lo, hi):
                    a, b = int(at[row] - first), int(at[row + 1] - first)
                    if a == b:
                        continue
                    places = np.flatnonzero(cut_places(data[a:b], mask_bits)) + 1
                    places = places[places < b - a]
                    own = heads[a:b]
                    places = places[own[places]]
                    found = chunk_ends(places, own, b - a, least, most)
                    rows += [row] * len(found)
                    numbers += range(len(found))
                    begins += [a] + [a + e for e in found[:-1]]
                    ends += [a + e for e in found]
                if not rows:
                    continue
                r, s, e = np.array(rows), np.array(begins), np.array(ends)
                value = (sums[e] - sums[s]) * back[s]
                size = (e - s).astype(np.uint64)
                origin = chars[(at[r] - first).astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(r)), pa.array(np.array(numbers, np.int32)), pa.array((chars[s] - origin).astype(np.int32)), pa.array((chars[e] - origin).astype(np.int32)),
                        pa.array(mix(value + size).view(np.int64)), pa.array(mix(value * np.uint64(0xD6E8FEB86659FD93) ^ size).view(np.int64)),
                    ], names,
                )

    return run


def text_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask_bits: int = 5, least: int = 24, most: int = 256) -> DataFrame:
    """(doc_id, n, start, end, h1, h2): the chunks of every text in order; positions in code points, digest of 128 bits.

    Cuts depend on the ``WINDOW`` bytes before them, so an insertion changes the chunks around it and no others.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_chunks(mask_bits, least, most), "doc_id long, n int, start int, end int, h1 long, h2 long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 80, **chunking) -> DataFrame:
    """Passages that occur more than once: (doc_id, start, end, n_chunks, first_doc_id, first_start, kept).

    A passage is a run of neighbouring chunks whose digests occur elsewhere too, at least ``min_chars`` code points long; it is one row, or several
    where first occurrences and later ones alternate in it. ``first_doc_id`` and ``first_start`` are the smallest (doc_id, start) with the digest of the
    row's first chunk. ``kept`` marks rows made up of first occurrences; deduplication removes the others.

    Null and empty texts have no chunks. Ties go to the smallest document, then the smallest start. Repeated rows are repeats like
    others; rows with a null id are ignored. An empty table gives an empty table. Other columns are ignored.
    """
    chunks = materialise(text_chunks(docs.where(F.col(id_col).isNotNull()), id_col, text_col, **chunking), "chunks")
    seen = chunks.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "start")).alias("first")).where("times > 1")
    seen = materialise(seen.select("h1", "h2", "first"), "repeats")
    again = chunks.join(seen, ["h1", "h2"]).select(
        "doc_id", "n", "start", "end", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"),
    ).withColumn("kept", (F.col("doc_id") == F.col("first_doc_id")) & (F.col("start") == F.col("first_start")))
    order = W.partitionBy("doc_id").orderBy("start", "end")
    gap = F.coalesce(F.col("start") != F.lag("end", 1).over(order), F.lit(True))
    turn = gap | (F.col("kept") != F.lag("kept", 1).over(order))
    runs = again.withColumn("passage", F.sum(gap.cast("int")).over(order)).withColumn("run", F.sum(turn.cast("int")).over(order))
    whole = W.partitionBy("doc_id", "passage")
    runs = runs.withColumn("chars", F.max("end").over(whole) - F.min("start").over(whole)).where(F.col("chars") >= min_chars)
    return runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"),
        F.min_by("first_doc_id", "start").alias("first_doc_id"), F.min_by("first_start", "start").alias("first_start"), F.first("kept").alias("kept"),
    ).drop("run")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the repeated passages that are not first occurrences; all columns are kept. Ids must be unique; null ids are left alone."""
    name = free("_cut", docs.columns)
    cut = repeated_passages(docs, id_col, text_col, **options).where("not kept")
    spans = cut.groupBy(F.col("doc_id").alias(id_col)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(x["end"].alias("at"), F.concat(s["done"], F.substring(F.col(text_col), s["at"] + 1, x["start"] - s["at"])).alias("done"))

    folded = F.aggregate(name, start, step)
    left = F.concat(folded["done"], F.substring(F.col(text_col), folded["at"] + 1, F.length(text_col)))
    return docs.join(spans, id_col, "left").withColumn(text_col, F.when(F.col(name).isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
