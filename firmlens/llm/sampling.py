"""Bounded training samples and the split that keeps a quarter of the documents out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2  # remainder of crc32(doc_id as text) modulo 4


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def bounded(df: DataFrame, n: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``n`` rows, chosen by the hash of their id, so the same rows on every run."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)
