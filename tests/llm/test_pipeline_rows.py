"""Pipeline stages decide on rows, also where doc_ids are missing or repeated."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from civicspark.llm.common import table
from civicspark.llm.neardup import near_duplicates

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SAME = "one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def frame(spark):
    return lambda pairs: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA)


def test_near_duplicates_without_ids(spark, frame):
    docs = frame([(None, SAME), (None, SAME.upper()), (None, "alone"), (None, "apart"), (3, "a b"), (3, "c d"), (2, "c d"), (4, SAME.title())])
    got = corpus_pipeline.near_duplicate(spark, docs, SF_DIR)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(4, SAME.title()), (None, "alone"), (None, "apart"), (3, "a b"), (2, "c d")}
    lone = near_duplicates(frame([(None, SAME), (None, SAME.upper()), (None, "alone")])).collect()
    assert Counter((r.n_shingles, r.kept) for r in lone) == {(6, True): 1, (6, False): 1, (1, True): 1}


def test_decontamination_without_ids(spark, frame):
    item = table(spark, SF_DIR, "benchmark").filter("size(split(text, ' ')) > 6").first().text
    docs = frame([(None, f"before {item} after"), (None, "alone"), (5, item), (5, "clean"), (6, "other")])
    got = corpus_pipeline.benchmark(spark, docs, SF_DIR)
    assert {(r.doc_id, r.text) for r in got.collect()} == {(None, "alone"), (5, "clean"), (6, "other")}


def test_mixture_without_ids(spark, frame):
    texts = [f"{i} " + "w " * (i % 7 + 1) for i in range(200)]
    docs = frame([(None, t) for t in texts])
    got = Counter(r.text for r in corpus_pipeline.mixture(spark, docs, SF_DIR).collect())
    words = sum(len(t.split()) for t in texts)
    taken = sum(len(t.split()) * n for t, n in got.items())
    assert set(got.values()) <= {1, 2} and abs(taken - 1.5 * words) <= 8


def test_mixture_of_equal_rows(spark, frame, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "CHUNK", 7)
    same = "one two three four five"
    docs = frame([(1, same)] * 300 + [(i, f"{i} other words") for i in range(2, 60)] + [(None, None), (None, "")])
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixture(spark, docs, SF_DIR).collect())
    words = 300 * 5 + 58 * 3
    assert abs(sum(n * len(t.split()) for (_, t), n in got.items()) - 1.5 * words) <= 8
    assert 300 < got[1, same] <= 600 and all(1 <= n <= 2 for (i, _), n in got.items() if i != 1)
    assert all(t for _, t in got)
