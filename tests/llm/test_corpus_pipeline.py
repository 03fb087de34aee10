"""The pipeline's stages one after the other, against plain versions of them."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from millrace.llm import bpe


def test_stages_and_run(spark, sf_dir, tmp_path):
    first = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == first.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    rows, kept, unique, masked, mixed, encoded = [r.asDict() for r in first.collect()], *seen
    ids = lambda table: [r["doc_id"] for r in table]
    assert set(ids(kept)) < set(ids(rows)) and set(ids(unique)) <= set(ids(kept))
    assert sorted(ids(masked)) == sorted(ids(unique)) and set(ids(mixed)) <= set(ids(masked))
    assert all(len((r["text"] or "").split()) >= 50 for r in kept)
    path, pattern = bpe._public()
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert sorted(ids(encoded)) == sorted(ids(mixed))
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in encoded)
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, again.collect())) == sorted(map(str, encoded))
