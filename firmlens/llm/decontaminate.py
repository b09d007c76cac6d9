"""Benchmark decontamination: MinHash containment search for short items inside long documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.sides import keyed, let, sized
from firmlens.session import materialise

WHITE = " \t\n\x0b\x0c\r"


def shingle_hashes(text: Column, width: int) -> Column:
    """Distinct 64-bit hashes of the ``width``-word shingles of the lower-cased text; fewer words make one shingle."""
    none = F.array().cast("array<long>")

    def of(words: Column) -> Column:
        n = F.size(words)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, width)))
        return F.when(n < width, F.array(F.xxhash64(words))).otherwise(F.array_distinct(every))

    plain = F.trim(F.lower(text), F.lit(WHITE))
    return F.when(text.isNull() | (F.trim(text, F.lit(WHITE)) == ""), none).otherwise(let(F.split(plain, "[\\x20\\x09-\\x0D]+"), of))


def item_index(items: DataFrame, item_col: str, text_col: str, percent: int, width: int) -> DataFrame:
    """(item_id, n_item, hash, signature, least): one row per shingle of an item.

    ``signature`` marks the item's n - ceil(percent * n / 100) + 1 smallest hashes: a document with
    ``percent`` of the item's shingles lacks too few of them to miss all of these, so searching for them is complete. ``least`` is the
    smallest document, in shingles, that can hold enough of the item; it is the size partition of a document that decides which items it is searched for.
    """
    one = items.select(F.col(item_col).cast("long").alias("item_id"), shingle_hashes(F.col(text_col), width).alias("hashes")).where("item_id is not null")
    sets = one.select("item_id", F.explode("hashes").alias("hash")).groupBy("item_id").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
    n = F.size("hashes")
    need = F.ceil(n * percent / 100).cast("int")
    return sets.select("item_id", n.cast("long").alias("n_item"), need.alias("least"), (n - need + 1).alias("_k"), F.posexplode("hashes").alias("_at", "hash")).select(
        "item_id", "n_item", "hash", (F.col("_at") < F.col("_k")).alias("signature"), "least"
    )


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    percent: int = 75, width: int = 5, broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_common): the document holds at least ``percent`` % of the item's distinct shingles.

    Documents keep the MinHash sketch of their hashes up to the largest signature value and probe the signatures of the items
    that fit in their size; only documents found so are read again, and the exact number of common shingles decides.

    Null or blank texts have no shingles and match nothing; a text shorter than ``width`` words is one shingle of all its
    words, so it matches only texts of the same words. Repeated item or document ids are one item (their shingles joined) or document.
    Null ids are dropped; other columns are ignored. The items' index is broadcast up to ``broadcast_rows`` rows, as are
    the ids of candidate documents; beyond it both are joined by shuffling, and adaptive execution splits frequent shingles.
    """
    index = materialise(item_index(items, item_col, item_text_col, percent, width), "items")
    rows, top = index.agg(F.count("*"), F.max(F.when(F.col("signature"), F.col("hash")))).first()
    small = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    hashes = shingle_hashes(F.col("text"), width)  # exploded with ``explode_outer``: the plain one adds filters that compute the hashes again
    sketched = docs.select("doc_id", hashes.alias("hashes")).select("doc_id", F.size("hashes").alias("n_doc"), F.explode_outer("hashes").alias("hash"))
    probes = sketched.where(F.col("hash") <= F.lit(top if top is not None else -(1 << 63)))
    signatures = index.where("signature").select("hash", "item_id", "least")
    found = materialise(probes.join(small(signatures, rows), "hash").where("n_doc >= least").select("doc_id", "item_id").distinct(), "candidates")
    ids = found.select("doc_id").distinct()
    again = docs.join(small(ids, ids.count()), "doc_id", "left_semi").select("doc_id", hashes.alias("hashes"))
    shared = (
        again.select("doc_id", F.explode_outer("hashes").alias("hash"), F.size("hashes").alias("n_doc"))
        .join(small(index.select("hash", "item_id", "n_item", "least"), rows), "hash").where("n_doc >= least")
        .groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.count_distinct("hash").alias("n_common"))
        .where(100 * F.col("n_common") >= percent * F.col("n_item"))
    )
    return shared.join(found, ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "n_item", "n_common")


def without_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows whose own text holds no item; all columns of ``docs`` are kept.

    Rows are searched and dropped by a written key: ``id_col`` is not read, so rows with a repeated or null id are judged like others.
    """
    rows, key = keyed(docs, "searched")
    held = contaminated(rows, items, key, **options).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(sized(held, "dropped"), key, "left_anti").select(*docs.columns)
