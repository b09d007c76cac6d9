"""Web archives: a deterministic sharded writer of WARC 1.1 files, and their reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm.sides import sized
from firmlens.operators.ordered import running
from firmlens.session import materialise, shared_root

LEAST_REVISIT = 1000  # payloads below this many bytes are stored again rather than referred to
MOST_SHARDS = 100_000  # bounds the cut points that are sent to all tasks
SALTS = 16
NO_ID = -(1 << 63)  # where rows without an id are sorted
RECORD_NAMES = uuid.UUID("6b1f0c1e-3f62-5d0a-9b0e-2f6f7a6c1d55")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, part int, temporary string, path string, n_records long, n_bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, path string"


def describe(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, sha1, same): every row's payload in UTF-8 (null: empty) and what identifies it.

    ``same`` is a digest of 256 bits and decides equality; the SHA-1 is the one written to the headers.
    """
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "same": F.unhex(F.sha2("payload", 256))})


def repeated(rows: DataFrame) -> DataFrame:
    """(_same, top, _salt): payloads of at least ``LEAST_REVISIT`` bytes under two ids or more and their largest id, once per salt."""
    ids = F.coalesce(F.col("page_id"), F.lit(NO_ID))  # null ids are one id below all others
    large = rows.where(F.col("payload_bytes") >= LEAST_REVISIT)
    groups = large.groupBy("same").agg(F.max("page_id").alias("top"), F.min(ids).alias("low")).where("low < top")
    return groups.select(F.col("same").alias("_same"), "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))


def decide(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``record_type`` and ``refers_to``; revisits lose their payload, so it is neither shuffled nor stored.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the row with the largest page_id is the response; rows that share that id are all
    responses, as are rows of a group without any id. ``groups`` is broadcast below a checked number of rows, else every payload is dealt over ``SALTS`` parts.
    """
    deal = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    on = (F.col("same") == F.col("_same")) & (deal == F.col("_salt")) & (F.col("payload_bytes") >= LEAST_REVISIT)
    joined = rows.join(groups, on, "left")
    again = F.col("top").isNotNull() & (F.coalesce(F.col("page_id"), F.lit(NO_ID)) < F.col("top"))
    return joined.select(
        "page_id", "url", "payload_bytes", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("top")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def shard_starts(decided: DataFrame, shard_bytes: int) -> list[int]:
    """The first id of every shard but the first, from exact running totals of stored bytes in id order, so equal tables get equal shards.

    At most ``MOST_SHARDS`` numbers reach the driver: shards grow beyond ``shard_bytes`` where there would be more. An id with more bytes than
    a shard starts several.
    """
    stored = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0)) + F.lit(512)
    by_id = materialise(decided.groupBy(F.coalesce("page_id", F.lit(NO_ID)).alias("id")).agg(F.sum(stored).alias("bytes")), "sizes")
    step = max(shard_bytes, -(-(by_id.agg(F.sum("bytes")).first()[0] or 0) // MOST_SHARDS))
    placed = running(by_id, [], [F.asc("id")], {"before": ("sum_before", "bytes")})
    first, last = F.greatest(F.ceil(F.col("before") / step), F.lit(1)).cast("long"), F.floor((F.col("before") + F.col("bytes") - 1) / step).cast("long")
    starts = placed.where(first <= last).select("id", F.explode(F.sequence(first, last)).alias("shard"))
    return [r.id for r in starts.orderBy("shard").collect()]


def _assign(starts: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    cuts = np.array(starts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("page_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            # The first shard of an id may begin before it; an id that starts several shards is dealt by row number.
            low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
            low = np.where(high - low > 1, low + 1, high)
            deal = batch.column("deal").to_numpy(zero_copy_only=False) % np.maximum(high - low + 1, 1)
            yield pa.RecordBatch.from_arrays([pa.array(low + deal), *batch.columns[:-1]], ["shard", *batch.schema.names[:-1]])

    return run


def record_name(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_NAMES, f'{page_id}:{sha1}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own; nothing in it depends on the time of writing."""
    headers = [*headers, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, size: int, sha1: str, refers_to: int | None, payload: bytes | None, date: str) -> bytes:
    """A response or revisit record. A revisit keeps the HTTP head, which tells the size of the payload it refers to."""
    uri = "".join(c if "\x21" <= c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "about:blank"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_name(page_id, sha1)), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("Content-Type", "application/http; msgtype=response"),
    ]
    headers += [("X-Page-Id", str(page_id))] if page_id is not None else []
    headers += [] if url is None else [("X-Page-Url", base64.b64encode(url.encode()).decode())]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(refers_to, sha1)), ("X-Refers-To-Page-Id", str(refers_to))]
    return _member(headers, head + (payload or b"" if refers_to is None else b""))


class _Files:
    """The files of one shard: written under temporary names, a new one where the next record would pass ``most`` compressed bytes."""

    def __init__(self, root: str, shard: int, most: int, date: str) -> None:
        self.disk, self.base = fs.FileSystem.from_uri(root)
        self.shard, self.most, self.date, self.part, self.out, self.done = shard, most, date, 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is not None and self.size + len(member) > self.most:
            self.close()
        if self.out is None:
            name = f"shard-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.names = f"_temporary/{uuid.uuid4().hex}-{name}", name
            self.out, self.size, self.records, self.digest = self.disk.open_output_stream(f"{self.base}/{self.names[0]}", compression=None), 0, 0, hashlib.sha256()
            info = f"software: firmlens\r\nformat: WARC File Format 1.1\r\nisPartOf: shard-{self.shard:06d}\r\n".encode()
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_name(None, name)), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.part, *self.names, self.records, self.size, self.digest.hexdigest()))
            self.out, self.part = None, self.part + 1

    def abandon(self) -> None:
        with suppress(OSError):
            if self.out is not None:
                self.out.close()
            for name in [d[2] for d in self.done] + ([self.names[0]] if self.out is not None else []):
                self.disk.delete_file(f"{self.base}/{name}")


def _write(root: str, most: int, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done = None, []
        try:
            for batch in batches:
                for row in range(batch.num_rows):
                    v = {k: batch.column(k)[row].as_py() for k in batch.schema.names}
                    if files is None or files.shard != v["shard"]:
                        if files is not None:
                            files.close()
                            done += files.done
                        files = _Files(root, v["shard"], most, date)
                    files.add(page_record(v["page_id"], v["url"], v["payload_bytes"], v["sha1"], v["refers_to"], v["payload"], date))
            if files is not None:
                files.close()
                done += files.done
        except BaseException:
            if files is not None:
                files.abandon()
            raise
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)

    return run


def _publish(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Give finished files their names. Done again after a lost task, it finds the file in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for old, new, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "path", "n_bytes"))):
                source, target = f"{base}/{old}", f"{base}/{new}"
                if disk.get_file_info(source).type == fs.FileType.File:
                    disk.move(source, target)
                if disk.get_file_info(target).size != size:
                    raise OSError(f"{target} is not the file that was written")
            yield batch

    return run


def write_archives(pages: DataFrame, root: str | None = None, shard_bytes: int = 64 << 20, file_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Write one record per row of ``pages`` under ``root`` (a new folder of the shared one by default); returns the folder and the manifest.

    Rows are cut into shards at exact running totals of stored bytes in the order of ids and sorted within them; a shard is one task's work and a
    sequence of files of at most ``file_bytes`` compressed bytes (a larger record has a file of its own). Record ids, digests and dates follow from
    the rows alone, so the same table gives the same files. Files are written under temporary names; only those of attempts that Spark
    counted get into the manifest and their final names, and ``_manifest`` is written last: a folder without it is not complete. ``root`` must be an
    absolute path or URI that every executor can write.

    A null html is an empty payload, a null id sorts first and is left out of the record, a null url is ``about:blank``. Repeated rows make
    repeated records; which of several equal responses a revisit means does not matter. Rows of one id that fill several shards are dealt over them. An
    empty table makes an empty manifest. Other columns are ignored.
    """
    spark = pages.sparkSession
    root = (root or f"{shared_root(spark)}/firmlens/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}").rstrip("/")
    disk, base = fs.FileSystem.from_uri(root)
    disk.create_dir(f"{base}/_temporary", recursive=True)
    described = describe(pages, id_col, url_col, html_col)
    groups = sized(repeated(described), "payloads")
    rows = decide(described, groups)
    starts = shard_starts(rows, shard_bytes)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.withColumn("deal", F.monotonically_increasing_id()).mapInArrow(_assign(starts), f"shard long, {fields}")
    ordered = dealt.repartitionById(len(starts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "url", "sha1")
    written = materialise(ordered.mapInArrow(_write(root, file_bytes, date), MANIFEST), "warc")
    named = written.repartition("path").mapInArrow(_publish(root), MANIFEST)
    named.write.parquet(f"{root}/_manifest")
    disk.delete_dir(f"{base}/_temporary")
    return root, spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def records(stream: Callable[[int], bytes], chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file with one gzip member a record; one record is held at a time."""
    rest = b""
    while True:
        pack, parts = zlib.decompressobj(31), []
        while not pack.eof:
            rest = rest or stream(chunk)
            if not rest:
                break
            parts.append(pack.decompress(rest))
            rest = pack.unused_data
        if not parts:
            return
        if not pack.eof:
            raise ValueError("the archive ends inside a record")
        data = b"".join(parts)
        head, _, body = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines)
        block = body[: int(headers["Content-Length"])]
        if version != "WARC/1.1" or body[len(block):] != b"\r\n\r\n" or _sha1(block) != headers["WARC-Block-Digest"]:
            raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
        yield headers, block


def _read(root: str, with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def parse(path: str, headers: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
        told = headers["WARC-Payload-Digest"]
        kind = headers["WARC-Type"]
        if kind == "response" and (len(payload) != size or _sha1(payload) != told):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
        number = lambda k: int(headers[k]) if k in headers else None
        url = base64.b64decode(headers["X-Page-Url"]).decode() if "X-Page-Url" in headers else None
        return number("X-Page-Id"), url, kind, size, base64.b32decode(told[5:]).hex(), number("X-Refers-To-Page-Id"), payload if with_payload and kind == "response" else None, path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with disk.open_input_stream(f"{base}/{path}", compression=None) as f:
                    for headers, block in records(f.read):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(parse(path, headers, block))
                        held += len(block) if with_payload else 200
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, path) of every record in the files that the manifest names.

    Block and payload digests are computed again and compared; a damaged or cut file is an error. The payload of a revisit is null.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest").select("path", "n_bytes")
    n = max(1, min(manifest.count(), 10_000))
    return manifest.repartitionByRange(n, "path").select("path").mapInArrow(_read(root, with_payload), RECORD)
