"""Column and join helpers: a value bound once, and sides of a join that are broadcast below a checked number of rows, else shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.session import materialise

ROWS = 2_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once: inside a lambda function a plain expression is computed anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sized(df: DataFrame, label: str, rows: int = ROWS) -> DataFrame:
    """``df``, written once, with a broadcast hint if it has at most ``rows`` rows."""
    kept = materialise(df, label)
    return F.broadcast(kept) if kept.count() <= rows else kept


def free(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs``, written once with a long key of its own for each row, and the name of that column. Ids may repeat or be null; keys do neither."""
    key = free("_row", docs.columns)
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), label), key
