"""Near-duplicate join by parity sketches.

Every distinct shingle flips one bit of a very wide bit sketch, so the Hamming distance of two sketches never
exceeds the symmetric difference of the two shingle sets. For Jaccard similarity >= t that difference is at most
(1 - t) / (1 + t) of the sum of the set sizes. Documents are compared inside size classes; in a class the sketch is cut
into more bands than a document of that class has shingles. Bands hold few set bits, so a band is kept as the XOR of the
codes of its set bits. Two similar documents differ in at most d bands, hence (pigeonhole) among any d + 1 set bands
of one of them, taken in an order that both follow, one is shared. Only these d + 1 keys are shuffled.

Shingles that many documents share get coarse bands of their own. They are found on a bounded sample of documents, which
steers cost only: any split gives the same links. Candidates are compared with a 1024-bit sketch first, then with whole sets.

Keys with the same sets under them count as one. Groups under one key are merged in rounds. In a round each key elects one of its sets, and each set is compared with the one that
most of its keys elected, so a round compares no more pairs than there are sets. Keys whose sets are all in one component
are done. What the rounds leave open is joined key by key, across components only, under bounds on sizes and sketches; a pair that
shares many keys is kept under the first, and again only where neither side's smallest keys show that they have met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from firmlens.llm.graph import components
from firmlens.llm.sides import keyed, sized
from firmlens.llm.text import byte_views, mix, shingle_sets
from firmlens.session import arrow_batches, materialise, scratch

SMALL = 64  # smaller sets give each shingle a band of its own
SKETCH_BITS = 1024
ROUNDS = 3  # elections before the closing join; their number steers cost only
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20  # a Python worker holds several copies of a batch: of its texts, or of pairs of whole sets
EARLIER = 12  # smallest keys that a row of the closing join carries; their number steers cost only
SEEN_SETS = 1 << 20  # sets a task remembers so that copies emit no second set of keys


def size_class(n: int) -> int:
    return 0 if n < SMALL else n.bit_length() - 1


def next_class(c: int) -> int:
    return SMALL.bit_length() - 1 if c == 0 else c + 1


def difference_bound(n: int, m: int, percent: int) -> int:
    """Largest symmetric difference of sets of n and m members with 100 * |both| >= percent * |either|."""
    return (n + m) * (100 - percent) // (100 + percent)


def band_keys(u: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Keys of the set bands of the sketch of ``u`` (sorted hashes) cut into 2**bits bands; 64 bits: one band per shingle."""
    salt = np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    if bits >= 64 or not len(u):
        return mix(u ^ salt)
    band = u >> np.uint64(64 - bits) if bits else np.zeros(len(u), np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
    parity = np.bitwise_xor.reduceat(mix(u + salt), starts)
    return mix(parity + band[starts] * np.uint64(0xC2B2AE3D27D4EB4F) + salt)[parity != 0]


def needed_keys(u: np.ndarray, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set meets every similar one: of bands of rare shingles, and of bands of frequent ones.

    Rare shingles fall in fine bands. With more than d of them set, the d + 1 smallest keys suffice. Otherwise all are
    needed, and frequent shingles, in bands as coarse as the pigeonhole allows, supply the rest. Coarser cuts are added, so that the
    partner that needs fewer bands finds its cut at the other. Coarse bands hold several shingles each, so texts that merely share a passage rarely agree in one.
    """
    n = len(u)
    c = size_class(n)
    most, above = n * 100 // percent, SMALL if c == 0 else 1 << (c + 1)
    often = u[:0]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)
        common = frequent[at] == u
        often, u = u[common], u[~common]
    rare, lacking = [], 0
    for k, partner in ((c, min(most, above - 1)), (next_class(c), most)):
        if k != c and most < above:
            continue
        keys = band_keys(u, 64 if k == 0 else k + 1, k + 1)
        want = difference_bound(n, partner, percent) + 1
        if len(keys) > want:
            keys = np.partition(keys, want - 1)[:want]
        lacking = max(lacking, want - len(keys))
        rare.append(keys)
    hot = []
    for bits in range(65) if lacking > 0 else ():
        hot.append(band_keys(often, bits, 500 + bits))
        if len(hot[-1]) >= lacking:
            break
        if bits == 64:  # too few bands even with one per shingle: such sets meet under one key
            hot.append(mix(np.array([1], dtype=np.uint64)))
    return np.concatenate(rare), np.concatenate(hot) if hot else u[:0]


def sketch(u: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the members at each of ``size`` places, packed; XOR of the halves of a sketch is the sketch of half the size."""
    bits = np.bincount((mix(u ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(u: np.ndarray) -> bytes | None:
    """A sketch of about four places per member, for sets that ``SKETCH_BITS`` places cannot tell apart."""
    size = 1 << (4 * len(u) - 1).bit_length()
    return sketch(u, size).tobytes() if size > 2 * SKETCH_BITS else None


def wide_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two wide sketches, the larger folded to the size of the smaller."""
    x, y = (np.frombuffer(z, dtype=np.uint64) for z in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def set_id(u: np.ndarray) -> tuple[int, int]:
    """Identity of a set and an independent check value."""
    a = mix(np.array([(mix(u) * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64) + np.uint64(len(u))], dtype=np.uint64))
    return int(a.view(np.int64)[0]), int(np.bitwise_xor.reduce(mix(u + np.uint64(77))).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _describe(width: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = frequent.value, set()
        for batch in batches:
            raw, at = byte_views(batch.column(1))
            ids, checks, sizes, sketches, wide, rare, hot = [], [], [], [], [], [], []
            none = np.zeros(0, np.uint64)
            for u in shingle_sets(raw, at, width):
                sizes.append(len(u))
                if not len(u):
                    ids.append(0), checks.append(0), wide.append(None), sketches.append(none.view(np.int64)), rare.append(none), hot.append(none)
                    continue
                i, check = set_id(u)
                ids.append(i), checks.append(check)
                if i in seen:
                    wide.append(None), sketches.append(none.view(np.int64)), rare.append(none), hot.append(none)
                    continue
                if len(seen) < SEEN_SETS:
                    seen.add(i)
                sketches.append(sketch(u)), wide.append(wide_sketch(u))
                few, many = needed_keys(u, percent, often)
                rare.append(few), hot.append(many)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(checks, pa.int64()), _lists(sketches), pa.array(wide, pa.binary()), _lists(rare), _lists(hot)],
                ["doc_id", "n_shingles", "set_id", "check", "bits", "wide", "rare", "hot"],
            )

    return run


_DESCRIBED = "doc_id long, n_shingles long, set_id long, check long, bits array<long>, wide binary, rare array<long>, hot array<long>"


def _all_shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = byte_views(batch.column(1))
            for u in shingle_sets(raw, at, width):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64))], ["shingle"])

    return run


def frequent_shingles(docs: DataFrame, width: int, sample_docs: int, least: int) -> np.ndarray:
    """Shingle hashes that at least ``least`` of about ``sample_docs`` hash-chosen documents hold, sorted.

    The sample is bounded, so the list is too. It only steers which bands are fine and which are coarse.
    """
    total = docs.count()
    chosen = docs if total <= sample_docs else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < F.lit(int(sample_docs / total * (1 << 30))))
    held = chosen.mapInArrow(_all_shingles(width), "shingle long").groupBy("shingle").count().where(F.col("count") >= least)
    found = np.array([r[0] for r in held.select("shingle").collect()], dtype=np.int64)
    return np.sort(found.view(np.uint64))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = byte_views(batch.column(0))
            held = [u for u in shingle_sets(raw, at, width) if len(u)]
            for lo in range(0, len(held), 256):
                part = held[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(u)[0] for u in part], pa.int64()), pa.array([u.tobytes() for u in part], pa.binary())], ["set_id", "members"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            keep = []
            for x, y in zip(left, right, strict=True):
                u, v = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int((v[at] == u).sum())
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep, pa.bool_())), b.filter(pa.array(keep, pa.bool_()))], ["x", "y"])

    return run


def _hamming(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _within():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, most, x, y = (batch.column(k) for k in range(5))
            keep = [u.as_py() is None or v.as_py() is None or wide_distance(u.as_py(), v.as_py()) <= m.as_py() for m, u, v in zip(most, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep, pa.bool_())), b.filter(pa.array(keep, pa.bool_()))], ["x", "y"])

    return run


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of set ids that sizes and sketches do not rule out."""
    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("n_shingles").alias(f"s{c}"), F.col("bits").alias(f"b{c}"))
    bound = F.floor((F.col("sx") + F.col("sy")) * (100 - percent) / (100 + percent)).cast("long")
    small, large = F.least("sx", "sy"), F.greatest("sx", "sy")
    near = pairs.join(side("x"), "x").join(side("y"), "y").where((100 * small >= percent * large) & (_hamming("bx", "by") <= bound)).select("x", "y", bound.alias("most"))
    wide = lambda c: sets.where("wide is not null").select(F.col("set_id").alias(c), F.col("wide").alias(f"w{c}"))
    full = near.join(wide("x"), "x", "left").join(wide("y"), "y", "left").select("x", "y", "most", "wx", "wy")
    return full.mapInArrow(_within(), "x long, y long")


def _linked(docs: DataFrame, pairs: DataFrame, sets: DataFrame, width: int, percent: int, broadcast_ids: int) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough, written. Texts of documents in no pair are not shuffled."""
    with scratch(docs.sparkSession):
        possible = materialise(_possible(pairs, sets, percent), "possible")
        if not possible.limit(1).count():
            return docs.sparkSession.range(0).select(F.col("id").alias("x"), F.col("id").alias("y"))  # createDataFrame would start Python workers of another kind
        wanted = possible.select(F.col("x").alias("set_id")).union(possible.select("y")).distinct()
        ids = materialise(wanted.join(sets.select("set_id", F.col("node").alias("doc_id")), "set_id").select("doc_id").distinct(), "wanted")
        few = ids.count() <= broadcast_ids
        texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")
        members = materialise(texts.mapInArrow(_sets(width), "set_id long, members binary"), "members")
        side = lambda c, m: members.select(F.col("set_id").alias(c), F.col("members").alias(m))
        joined = possible.join(side("x", "left"), "x").join(side("y", "right"), "y").select("x", "y", "left", "right")
        return materialise(joined.mapInArrow(_verify(percent), "x long, y long").distinct(), "verified", outer=True)


def _labelled(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the links as (set_id, comp), written, and ``rows`` (key, set_id, keys) with the component of each set."""
    joined = materialise(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "set_id"), "joined")
    return joined, rows.select("key", "set_id", "keys").join(joined, "set_id", "left").select("key", "set_id", "keys", F.coalesce("comp", "set_id").alias("comp"))


def _first() -> Column:
    """The set that a key elects before any links are known."""
    return F.min(F.struct(F.xxhash64("set_id", F.lit(0)), "set_id"))


def _members(over: Callable[[Column], Column] = lambda c: c) -> Column:
    """A key's name from the distinct sets under it. Keys with equal sets get one name, so like texts that share many keys meet once.

    Two keys whose names clash are merged, which adds candidates and loses none.
    """
    total = lambda seed: over(F.sum(F.shiftright(F.xxhash64("set_id", F.lit(seed)), 24)))  # noqa: E731  40 bits, so that sums do not overflow
    return F.xxhash64(total(1), total(2), over(F.count("*")))


def _split(hot: DataFrame) -> DataFrame:
    """The distinct rows (key, set_id) of keys with several sets: name of the key, set, and the set that the key elects."""
    found = hot.groupBy("key").agg(_first()["set_id"].alias("rep"), _members().alias("name"), F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo <> hi")
    return hot.join(found, "key").select(F.col("name").alias("key"), "set_id", "rep")


def _elected(rows: DataFrame, number: int) -> DataFrame:
    """``rows`` (key, set_id, keys, comp) of keys with several components, with the set that the key elects in this round.

    Counts and minima are combined before the shuffle; a frequent key is split by adaptive execution when it is joined back.
    """
    top = F.min(F.struct(F.xxhash64("set_id", F.lit(number)).alias("h"), "set_id", "comp"))
    tops = rows.groupBy("key").agg(top.alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return rows.join(tops.select("key", F.col("top.set_id").alias("rep"), F.col("top.comp").alias("rep_comp")), "key")


def _chosen(rows: DataFrame) -> DataFrame:
    """For each set the pair (x, y) with the set elected by most of its keys."""
    votes = rows.groupBy("set_id", "rep").agg(F.sum("keys").alias("votes"))
    best = votes.groupBy("set_id").agg(F.max(F.struct("votes", "rep"))["rep"].alias("rep"))
    return best.select(F.least("set_id", "rep").alias("x"), F.greatest("set_id", "rep").alias("y")).distinct()


def _closing(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of sets that share a key of ``rows`` (key, set_id, comp) but no component, if sizes and sketches allow a link.

    Like texts share many keys. A pair is kept under the first of them, and not again where both sets know from their ``EARLIER``
    smallest keys that they have met. Pairs may still repeat; none is lost.
    """
    words = range(SKETCH_BITS // 64)
    earlier = rows.groupBy("set_id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, EARLIER).alias("earlier"))
    facts = sets.select("set_id", F.col("n_shingles").alias("n"), *[F.get("bits", F.lit(i)).alias(f"f{i}") for i in words]).join(earlier, "set_id")
    rest = rows.select("key", "set_id", "comp").join(facts, "set_id").withColumn("earlier", F.filter("earlier", lambda k: k < F.col("key")))
    rest = materialise(rest, "rest")
    side = lambda c: rest.select("key", *[F.col(x).alias(c + x) for x in rest.columns if x != "key"])
    distance = sum((F.bit_count(F.col(f"xf{i}").bitwiseXOR(F.col(f"yf{i}"))) for i in words), F.lit(0))
    x, y = side("x"), side("y")
    allowed = (
        (x["key"] == y["key"]) & (x["xcomp"] < y["ycomp"])
        & (100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")) & (distance * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent))
        & ~F.arrays_overlap("xearlier", "yearlier")
    )
    return x.join(y, allowed).select(F.least("xset_id", "yset_id").alias("x"), F.greatest("xset_id", "yset_id").alias("y"))


def _classes(docs: DataFrame, percent: int, width: int, sample_docs: int, frequent_at: int, broadcast_ids: int) -> DataFrame:
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, width, sample_docs, frequent_at))
    described = materialise(docs.mapInArrow(_describe(width, percent, frequent), _DESCRIBED), "described")
    held = described.where("n_shingles > 0")
    sets = materialise(
        held.groupBy("set_id").agg(
            F.min("doc_id").alias("node"), F.max("n_shingles").alias("n_shingles"), F.max("bits").alias("bits"), F.max("wide").alias("wide"), F.count("*").alias("copies"),
            F.assert_true(F.min("check") == F.max("check"), F.lit("two shingle sets have one identity")).alias("ok"),
        ).drop("ok"), "sets",
    )
    # keys of rare bands come in small groups: a group is told apart, and elects, where its key is shuffled to
    group = W.partitionBy("key")
    rare = held.select("set_id", F.explode("rare").alias("key")).repartition("key")
    rare = rare.select("key", "set_id", _first().over(group)["set_id"].alias("rep"), F.max("set_id").over(group).alias("hi"), F.min("set_id").over(group).alias("lo"))
    rare = rare.where("lo <> hi").select("key", "set_id", "rep").distinct()
    rare = materialise(rare.select(_members(lambda c: c.over(group)).alias("key"), "set_id", "rep"), "rare")
    hot = materialise(held.select(F.explode("hot").alias("key"), "set_id").distinct(), "hot")
    rows = materialise(rare.union(_split(hot)).groupBy("key", "set_id").agg(F.min("rep").alias("rep"), F.count("*").alias("keys")), "groups")

    twice = held.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y").select("doc_id", "x")
    links = materialise(held.join(twice, "doc_id").select("x", F.col("set_id").alias("y")).where("x <> y").distinct(), "same_id")
    tried = materialise(_chosen(rows.where("rep <> set_id")), "pairs")
    links = links.union(_linked(docs, tried, sets, width, percent, broadcast_ids))
    joined, rows = _labelled(rows, links)
    for number in range(1, ROUNDS + 1):
        rows = materialise(_elected(materialise(rows, "labelled"), number), "open")
        if number == ROUNDS:
            break
        pairs = materialise(_chosen(rows.where("comp <> rep_comp")).join(tried, ["x", "y"], "left_anti"), "pairs")
        new, tried = _linked(docs, pairs, sets, width, percent, broadcast_ids), tried.union(pairs)
        if not new.limit(1).count():
            break
        links = links.union(new)
        joined, rows = _labelled(rows, links)

    # what the rounds leave open: sets that share a key but are in different components
    cross = _closing(rows, sets, percent).distinct()
    cross = materialise(cross.join(tried, ["x", "y"], "left_anti"), "pairs")
    more = _linked(docs, cross, sets, width, percent, broadcast_ids)
    links = links.union(more)
    if more.limit(1).count():
        joined, _ = _labelled(rows, links)
    degree = links.select(F.col("x").alias("set_id")).union(links.select("y")).groupBy("set_id").agg(F.count("*").alias("found"))
    nodes = sets.join(joined, "set_id", "left").join(degree, "set_id", "left").select(
        "set_id", "node", F.coalesce("comp", "set_id").alias("comp"), (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_witnesses")
    )
    nodes = materialise(nodes, "nodes")
    least = nodes.groupBy("comp").agg(F.min("node").alias("component_id"))
    nodes = nodes.join(least, "comp").select("set_id", "component_id", "n_witnesses")
    out = described.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id")).join(nodes, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_witnesses", F.lit(0)).alias("n_witnesses"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5,
    sample_docs: int = 4_000, frequent_at: int = 3, broadcast_ids: int = 2_000_000,
) -> DataFrame:
    """One row per document, written: ``doc_id``, ``n_shingles``, ``component_id``, ``n_witnesses``.

    ``component_id`` is the smallest document id reachable over links, the document itself included; a link joins two
    documents with 100 * |common shingles| >= percent * |all shingles|. ``n_witnesses`` counts the links that were verified to find the
    components, from the document's set, plus its exact copies: not all of its links, but 0 only if it has none.

    Null and empty texts have 0 shingles and are linked with nothing. Texts shorter than ``width`` words are one shingle.
    Repeated texts share a class and are compared once. Other columns are ignored; rows with a null id are dropped.
    Repeated ids count as one document whose rows are linked by that id. ``sample_docs`` and ``frequent_at`` bound the list of frequent shingles and
    steer cost only; below ``broadcast_ids`` the ids to fetch again are broadcast (16 bytes each), else joined.
    All other intermediate tables are removed.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    with scratch(docs.sparkSession), arrow_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        return materialise(_classes(docs, percent, width, sample_docs, frequent_at, broadcast_ids), "classes", outer=True)


def one_per_group(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row of each component, a row with the smallest id; all columns of ``docs`` are kept.

    Rows are linked by their texts alone and dropped by a written key: each row with a repeated or null id is a document of its own. Null ids come
    after all others; of rows with equal ids the smallest key stays. Rows without words are in no group and stay.
    """
    rows, key = keyed(docs, "grouped")
    found = near_duplicates(rows, key, **options)
    comp = materialise(found.where("n_witnesses > 0").select(F.col("doc_id").alias(key), F.col("component_id").alias("_comp")), "grouped")
    ids = rows.select(key, F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("_id"))
    first = F.min(F.struct("_none", "_id", key))
    member = comp.join(ids, key)
    kept = member.groupBy("_comp").agg(first[key].alias(key))
    extra = comp.select(key).join(kept.select(key), key, "left_anti")
    return rows.join(sized(extra, "dropped"), key, "left_anti").select(*docs.columns)
