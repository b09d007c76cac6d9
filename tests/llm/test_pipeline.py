"""The pipeline stage by stage on the smallest tables, each stage held against brute force on its own input."""

from __future__ import annotations

import re

import corpus_pipeline
from test_operators import brute_components, word_sets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = word_sets([(r.item_id, r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if name != "mixing":
            assert docs.columns == columns and len({r.doc_id for r in after}) == len(after)
        if name == "toxicity":
            assert 0.8 * len(before) < len(after) < len(before) and all(before[r.doc_id] == r for r in after)
        if name == "near duplicates":
            comp = brute_components(word_sets([(i, r.text) for i, r in before.items()]))
            assert {r.doc_id for r in after} == {i for i, c in comp.items() if i == c}
        if name == "decontamination":
            sets = word_sets([(i, r.text.lower()) for i, r in before.items()])
            held = {i for i, s in sets.items() if any(100 * len(s & q) >= 75 * len(q) for q in items.values())}
            assert held and {r.doc_id for r in after} == set(before) - held
        if name == "secrets":
            key = re.compile(r"token = \"[0-9a-f]{40}\"")
            assert {r.doc_id for r in after} == set(before) and not any(key.search(r.text) for r in after)
            assert all(before[r.doc_id].text == r.text for r in after if not key.search(before[r.doc_id].text) and "[secret]" not in r.text)
        if name == "mixing":
            assert {r.doc_id for r in after} <= set(before) and all(1 <= r.copy_no <= r.n_copies for r in after)
