"""Rows that repeat, share ids or have columns named like the operators' own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from civicspark.llm import toxicity as tox
from civicspark.llm.gam import learning_rows, quality_scores
from civicspark.llm.lines import drop_duplicate_lines
from civicspark.llm.mixing import mix
from civicspark.llm.toxicity import toxicity

CLASHES = "doc_id long, text string, source string, label int, label_id long, _id long, one string, hash long, terms int, x double"


@pytest.fixture(scope="module")
def clashing(spark):
    texts = ["a fine calm text about rivers. Nothing else.", "you idiot fool. Go away.", None, ""]
    rows = [(i % 40, texts[i % 4], "s", 1, 2, 3, "o", 4, 5, 0.5) for i in range(120)]
    return spark.createDataFrame(rows, CLASHES)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(40)], "doc_id long, quality int, toxic int")


def test_learning_takes_one_text_an_id(clashing, labels):
    rows = learning_rows(clashing, labels, "quality", 12).collect()
    assert len(rows) == 12 and {r.label for r in rows} == {0, 1}


def test_columns_named_like_ours(clashing, labels):
    scored = quality_scores(clashing, labels)
    assert scored.columns == [*clashing.columns, "score", "predicted"] and scored.count() == 120
    judged = toxicity(clashing, labels)
    assert judged.columns == [*clashing.columns, "score", "offending"] and judged.count() == 120


def test_terms_sent_to_the_driver_are_bounded(clashing, labels, monkeypatch):
    monkeypatch.setattr(tox, "TRAIN_TERMS", 60)
    assert toxicity(clashing, labels).agg(F.count("score")).first()[0] == 120


def test_equal_rows_are_drawn_one_by_one(spark):
    rows = [(1, "a", "one two three four five six seven eight nine ten")] * 1000 + [(i, "b", "word " * (i % 7)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for share in (0.51, 1.5, 0.3333):
        out = mix(docs, share).groupBy("source").agg(
            F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("longest")
        )
        assert all(abs(r.taken - r.target) <= r.longest for r in out.collect())


def test_lines_are_dropped_row_by_row(spark):
    rows = [(3, "xx\nfirst"), (3, "yy\nfirst"), (None, "alone"), (None, "other\nalone"), (5, None), (6, "yy"), (7, "yy\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, drop_duplicate_lines(docs).collect()), key=str)
    # in the order of id and text: (null, alone), (null, other alone), (3, xx first), (3, yy first), ...
    assert got == sorted([(None, "alone"), (None, "other"), (3, "xx\nfirst"), (3, "yy"), (5, ""), (7, "\n")], key=str)
