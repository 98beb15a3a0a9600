"""Queries over whole tables, against the library, recomputed places and held-out labels."""

from __future__ import annotations

import zlib

import pytest

from civicspark.llm import queries
from civicspark.llm.common import table
from civicspark.llm.sharding import locate


def test_tokens_of_every_document(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, "/root/testdata/sf0.001").collect()}
    want = {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False))) for i, t in texts.items()}
    assert got == {i: (b, n, n > 1024) for i, (b, n) in want.items()}


def test_place_of_every_document(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op3_feistel_sharding(spark, sf_dir).collect()
    got = {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in rows}
    want = {}
    for number, doc_id in enumerate(sorted(texts)):
        shard, slot = locate(number, len(texts), queries.SHARDS)
        want[doc_id] = (len(texts[doc_id]) + 8, zlib.crc32(texts[doc_id]), "rows", shard, slot, None)
    assert len(rows) == len(texts) and got == want


@pytest.mark.parametrize(
    ("build", "label", "least"), [(queries.op5_quality_classifier, "quality", 0.9), (queries.op8_toxicity, "toxic", 0.9)]
)
def test_held_out_labels(spark, build, label, least):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in table(spark, sf_dir, "labels").collect()}
    rows = build(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert len(unseen) > 30 and sum(p == y for p, y in unseen) >= least * len(unseen)
    assert all(0 <= r.score <= 1 for r in rows)
