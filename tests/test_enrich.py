"""Lookups, patches, fills and as-of joins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from civicspark.operators import enrich

EVENTS = "id INT, k STRING, t BIGINT, x STRING"


def events(seed, n=400):
    rng = random.Random(seed)
    return [
        (i, rng.choice(["hot", "hot", "a", None]), rng.randint(0, 99),
         rng.choice([None, None, f"x{i}"]))
        for i in range(n)
    ]


@pytest.mark.parametrize("width", [None, 1, 10])
def test_locf_is_exact_with_any_bucket(spark, width):
    data = events(1)
    bucket = None if width is None else F.floor(F.col("t") / width)
    df = spark.createDataFrame(data, EVENTS)
    out = enrich.locf(df, ["k"], "t", ["x"], ["id"], bucket)
    got = {r.id: r.x for r in out.collect()}
    for key in {e[1] for e in data}:
        last = None
        for i, _, _, x in sorted((e for e in data if e[1] == key), key=lambda e: (e[2], e[0])):
            last = x if x is not None else last
            assert got[i] == last


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("width", [None, 1, 13, 1000])
def test_asof_against_search(spark, direction, width):
    rng = random.Random(4)
    left = [(i, rng.choice("abc"), rng.choice([None, rng.randint(0, 60)])) for i in range(200)]
    right = [(k, t, f"{k}{t}") for k in "ab" for t in rng.sample(range(70), 12)]
    out = enrich.asof_join(
        spark.createDataFrame(left, "id INT, k STRING, t INT"),
        spark.createDataFrame(right, "k STRING, u INT, name STRING"),
        ["k"], "t", "u", direction, None if width is None else lambda t: F.floor(t / width),
    )
    got = {r.id: (r.u, r.name) for r in out.collect()}
    assert len(got) == len(left)
    for i, key, t in left:
        fits = [
            u for k, u, _ in right
            if k == key and t is not None and (u >= t if direction == "forward" else u <= t)
        ]
        best = (min(fits) if direction == "forward" else max(fits)) if fits else None
        assert got[i] == ((best, f"{key}{best}") if fits else (None, None))


def test_patch_fills_only_nulls(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "z", None)], "id INT, k STRING, v INT")
    lookup = spark.createDataFrame([("a", 9), ("b", 8)], "k STRING, v INT")
    assert rows(enrich.patch_nulls(df, lookup, ["k"], ["v"])) == [
        (1, "a", 9), (2, "a", 5), (3, "z", None)
    ]


def test_update_overwrites_also_with_null(spark, rows):
    df = spark.createDataFrame([(1, "a", 4), (2, "b", 5), (3, "z", 6)], "id INT, k STRING, v INT")
    patch = spark.createDataFrame([("a", 9), ("b", None)], "k STRING, v INT")
    assert rows(enrich.update_rows(df, patch, ["k"], ["v"])) == [
        (1, "a", 9), (2, "b", None), (3, "z", 6)
    ]


def test_recodes(spark):
    df = spark.createDataFrame([("RSC Anderlecht", "X"), ("KV", "Anvers"), ("KV", None)], "home STRING, city STRING")
    rules = [(F.col("home"), "anderlecht", "Anderlecht"), (F.col("city"), "anvers", "Antwerpen")]
    out = df.select(
        enrich.rule_recode(rules, F.col("city")).alias("c"),
        enrich.value_recode(F.col("city"), {"Anvers": "Antwerp"}).alias("v"),
    ).collect()
    assert [tuple(r) for r in out] == [("Anderlecht", "X"), ("Antwerpen", "Antwerp"), (None, None)]


def test_upsert_adds_missing_names_once(spark, rows):
    old = spark.createDataFrame([("a", 1), ("a", 1)], "name STRING, n INT")
    used = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "city STRING")
    missing = enrich.unmatched_keys(used, old, "city", "name")
    assert rows(missing) == [("b",)]
    new = missing.withColumn("n", F.lit(2))
    assert rows(enrich.upsert_dimension(old, new)) == [("a", 1), ("b", 2)]


def test_countdown(spark, rows):
    df = spark.createDataFrame([("x", "2024M01", 10), ("x", "2024M02", 12)], "k STRING, p STRING, v INT")
    assert rows(enrich.countdown(df, ["k"], "p", "v", 20)) == [("x", "2024M02", 8)]
