"""Ranked search against scores of all documents."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from civicspark.llm import queries, ranked
from civicspark.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = [
    (1, "The quick brown fox"), (1, "The quick brown fox"), (2, "the QUICK"), (3, None), (4, ""), (5, " .,;\n"),
    (None, "quick quick quick"), (7, "Ünï日本 x_y x-y"), (8, "lazy dog " * 20_000), (9, "fox"), (0, "fox"), (10, "42 is 4 2"),
]
ITEMS = [(1, "quick fox"), (1, "quick fox"), (2, None), (3, "fox FOX fox"), (None, "ünï x"), (4, "absent"), (5, "42"), (6, "dog quick")]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def search(docs, items, k=10):
    """All scores; ties by id, null last."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    n_terms = sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 8 * m))
                for w in terms(text) if w in bag
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in DOCS], "doc_id long, text string, item_id int, terms string, n int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, 5) for r in ITEMS], "item_id long, text string, doc_id long")


@pytest.mark.parametrize("k", [1, 2, 10])
@pytest.mark.parametrize("parts", [1, 5])
def test_fixture(docs, items, k, parts):
    got = ranked.ranked_search(docs.repartition(parts), items, k)
    assert sorted(map(tuple, got.collect()), key=str) == search(DOCS, ITEMS, k)


def test_blocks_of_items(docs, items, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 3)
    got = ranked.ranked_search(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == search(DOCS, ITEMS)


def test_empty_tables(docs, items):
    assert ranked.ranked_search(docs.limit(0), items).count() == 0
    assert ranked.ranked_search(docs, items.limit(0)).count() == 0
    assert ranked.ranked_search(docs.filter("text is null"), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_whole_table(spark):
    rows = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    asked = table(spark, SF_DIR, "benchmark").select("item_id", "text").collect()
    got = queries.op12_ranked_search(spark, SF_DIR).collect()
    assert sorted(map(tuple, got), key=str) == search(rows, asked)


def test_no_accumulators_once_the_rest_is_too_small():
    rare = (np.array([4, 9]), np.array([100, 90]))
    common = (np.arange(20), np.full(20, 10))
    found, scores, makers = ranked.accumulate([rare, common], np.array([100, 10]), 20, 2, 0)
    assert (found.tolist(), scores.tolist(), makers) == ([4, 9], [110, 100], 1)
    # A tie is still possible: all rows get theirs.
    found, _, makers = ranked.accumulate([rare, common], np.array([100, 90]), 20, 2, 0)
    assert len(found) == 20 and makers == 2
    # Other documents have set a threshold that these cannot reach.
    assert ranked.accumulate([common], np.array([10]), 20, 2, 11)[2] == 0
