"""Importance resampling against a plain Python version, on whole tables and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from firmlens.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def runs(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, targets, percent=25, least=20):
    """doc_id -> (n_features, weight, score, rank) of unique ids."""
    made = {i: runs(t) for i, t in docs}
    s, t = (Counter(zlib.crc32(f.encode()) % 10000 for fs in side for f in fs) for side in ([f for _, f in made.values()], [runs(x)[1] for x in targets]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)}
    out = {}
    for i, (n, fs) in made.items():
        w = sum(gain[zlib.crc32(f.encode()) % 10000] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i, (n, _) in made.items() if n >= least), key=lambda i: (-out[i][2], i))
    for k, i in enumerate(able[: percent * len(able) // 100]):
        out[i][3] = k + 1
    return {i: tuple(v) for i, v in out.items()}


def test_whole_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resample.draw(resample.weigh(docs, bench)).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert got == want and sum(v[3] is not None for v in got.values()) > 200


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, " .,\n"), (4, "one"), (5, "É Ünï 😀x a-b A B 12"), (6, "same words " * 30), (7, "other \x00 words " * 40)]
    frame = spark.createDataFrame([(i, t, "x", "y", "z", 3) for i, t in texts], "doc_id long, text string, rank string, weight string, score string, n_words int")
    target = spark.createDataFrame([(1, None), (2, "same words here")], "item_id long, text string")
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resample.draw(resample.weigh(frame, target), 50).collect()}
    assert got == brute(texts, ["same words here"], 50)
    assert [r.doc_id for r in resample.resample(frame, target, 50).collect()] == [6]
    assert resample.resample(frame, target, 50).columns == frame.columns
    assert resample.draw(resample.weigh(frame.limit(0), target)).count() == 0
    assert resample.draw(resample.weigh(frame, target.limit(0))).count() == 7


def test_repeated_and_null_ids_are_ranked_one_by_one(spark):
    rows = [(None, "same words " * 15)] * 5 + [(1, "same words " * 15)] * 6 + [(2, "a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([("same",)], "text string")
    got = resample.draw(resample.weigh(frame, target), 100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 12)) and len(got) == 12
    by_score = [(r.score, r.doc_id) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    assert by_score == sorted(by_score, key=lambda x: (-x[0], x[1] is None, x[1]))
    assert resample.resample(frame, target, 50).count() == 5


@pytest.mark.parametrize("width", [1, 2, 3])
def test_blocks_of_a_long_text_lose_no_run(width):
    text = "alpha Beta ga-mma Ω delta " * 50 + "x" * 40
    w = WORD.findall(text.translate(LOW))
    want = sorted(zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, width + 1) for i in range(len(w) - k + 1))
    data, tail, got = text.encode().translate(resample.TABLE), [], []
    for words in resample.word_blocks(data, 17):
        got += resample.hashed_runs(words, tail, width)
        tail = (tail + words)[-(width - 1) :] if width > 1 else []
    assert sorted(got) == want
