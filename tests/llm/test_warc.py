"""The archive writer: exact round trips, equal files for equal rows, commits, hot payloads and ids, damaged files."""

from __future__ import annotations

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from firmlens.llm import warc

SCHEMA = "page_id long, url string, html string, shard long, same string, _salt int"


def frame(spark, rows):
    """Pages with columns whose names clash with those of the operator."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def page(seed, n):
    r = random.Random(seed)
    return "<p>" + "".join(r.choice("abc déf😀\n") for _ in range(n)) + "</p>"


def expected(rows):
    tops = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            tops[h] = max(i, tops.get(h, i))
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        top = tops.get(h) if len(data) >= 1000 else None
        again = top is not None and (i is None or i < top)
        out.append((i, u, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None, None if again else data))
    return sorted(out, key=repr)


def got(spark, root):
    return sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(spark, root).collect()), key=repr)


def files(root):
    return {f: hashlib.sha256(open(os.path.join(root, f), "rb").read()).hexdigest() for f in sorted(os.listdir(root)) if f.endswith(".gz")}


def test_round_trip_of_odd_rows_and_copies(spark, tmp_path):
    big, other = page(1, 2000), page(2, 1500)
    rows = [(1, "http://a/é?q=1 2", big), (9, "http://b", big), (4, None, big), (None, "u", big), (2, "u", None), (3, "u", ""), (5, "", "short"), (6, "v", "short"),
            (7, "x", other), (7, "x", other), (3, "y", other), (None, None, None), (None, "z", page(3, 1200)), (8, "w", "x" * 999), (10, "w", "x" * 999), (11, "w", "x" * 1000), (12, "w", "x" * 1000), (13, "nul", "a\x00\r\n\r\nWARC/1.1\r\n")]
    root, manifest = warc.write_archives(frame(spark, rows), str(tmp_path / "a"))
    assert got(spark, root) == expected(rows)
    assert {r.path for r in manifest.collect()} == set(files(root)) and not os.path.exists(f"{root}/_temporary")
    for r in manifest.collect():
        data = open(f"{root}/{r.path}", "rb").read()
        assert len(data) == r.n_bytes and hashlib.sha256(data).hexdigest() == r.sha256 and gzip.decompress(data).count(b"WARC-Record-ID") == r.n_records + 1


def test_equal_rows_make_equal_files_whatever_their_partitions(spark, tmp_path):
    rows = [(k, f"http://h/{k % 7}", page(k % 40, 1100)) for k in range(400)]
    random.Random(5).shuffle(rows)
    roots = []
    for n in (1, 5):
        root, _ = warc.write_archives(frame(spark, rows).repartition(n), str(tmp_path / str(n)), shard_bytes=30_000, file_bytes=9_000)
        roots.append(files(root))
        assert got(spark, root) == expected(rows)
    assert roots[0] == roots[1] and len({f[:12] for f in roots[0]}) > 2 and len(roots[0]) > len({f[:12] for f in roots[0]})
    assert all(os.path.getsize(tmp_path / "1" / f) <= 9_000 for f in roots[0])


def test_hot_id_and_hot_payload_are_dealt_over_shards(spark, tmp_path):
    rows = [(7, "u", page(k, 1000)) for k in range(90)] + [(k, "v", page(1000, 4000)) for k in range(100, 190)] + [(5, "w", "x"), (300, "w", "y")]
    root, manifest = warc.write_archives(frame(spark, rows), str(tmp_path / "hot"), shard_bytes=20_000, file_bytes=1 << 20)
    assert got(spark, root) == expected(rows)
    sizes = [r.n_records for r in manifest.collect()]
    assert len(sizes) > 5 and max(sizes) < 60


def test_empty_table_and_damage(spark, tmp_path):
    root, manifest = warc.write_archives(frame(spark, []), str(tmp_path / "none"))
    assert manifest.count() == 0 and warc.read_archives(spark, root).count() == 0
    root, manifest = warc.write_archives(frame(spark, [(1, "u", page(1, 5000))]), str(tmp_path / "cut"))
    path = f"{root}/{manifest.first().path}"
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-20])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(spark, root).collect()


def test_records_of_an_attempt_that_failed_are_not_published(spark, tmp_path):
    bad = frame(spark, [(k, "u", page(k, 1200)) for k in range(20)]).withColumn("html", F.when(F.col("page_id") == 19, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("html")))
    with pytest.raises(Exception, match="lost"):
        warc.write_archives(bad, str(tmp_path / "bad"))
    assert not files(tmp_path / "bad") and not os.path.exists(tmp_path / "bad" / "_manifest")


def test_a_task_that_is_run_again_leaves_one_file(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"shard": 0, "page_id": 1, "url": "u", "payload_bytes": 1, "sha1": "0" * 40, "record_type": "response", "refers_to": None, "payload": b"x"}])
    os.makedirs(tmp_path / "_temporary")
    first, second = (next(warc._write(str(tmp_path), 100, "d")(iter([batch]))) for _ in range(2))
    assert len(os.listdir(tmp_path / "_temporary")) == 2 and first.column("sha256") == second.column("sha256")
    for _ in range(2):
        list(warc._publish(str(tmp_path))(iter([second])))
    assert list(files(tmp_path)) == ["shard-000000-0000.warc.gz"]
