"""Group-wise operators against plain Python, with hot keys, ties and NULLs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from civicspark.functions.rank import avg_rank, tie_rank
from civicspark.operators import grouping

ROWS = "id BIGINT, k STRING, v BIGINT"


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows on one key, NULL keys and values, many ties."""
    rng = random.Random(2)
    data = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        value = None if rng.random() < 0.1 else rng.choice([7, 7, rng.randint(-50, 50)])
        data.append((i, key, value))
    return data


def groups_of(data):
    groups = {}
    for row in data:
        groups.setdefault(row[1], []).append(row)
    return groups


@pytest.fixture(params=["true", "false"])
def ranges(request, spark):
    """One range for all rows, or as many as there are shuffle partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def ranks_of(data):
    expected = {}
    for rows in groups_of(data).values():
        values = [v for _, _, v in rows if v is not None]
        for i, _, v in rows:
            low, ties = 1 + sum(w > v for w in values) if v is not None else 0, values.count(v)
            dense = 1 + len({w for w in values if v is not None and w > v})
            expected[i] = (low, low + (ties - 1) / 2, dense) if v is not None else (None,) * 3
    return expected


EXTREME = [(i, "k", v) for i, v in enumerate([*range(40), 2**63 - 1, -(2**63), 0, 0, None, None])]


@pytest.mark.parametrize("case", ["skewed", "extreme", "repeated", "empty"])
def test_split_rank_is_exact(spark, skewed, ranges, case):
    data = {"skewed": skewed, "extreme": EXTREME, "repeated": [(i, "k", 5) for i in range(40)], "empty": []}[case]
    out = grouping.split_rank(spark.createDataFrame(data, ROWS), ["k"], "v").collect()
    assert len(out) == len(data)
    assert {r.id: (r.rank_min, r.rank_avg, r.rank_dense) for r in out} == ranks_of(data)


@pytest.mark.parametrize("case", ["skewed", "extreme", "repeated", "empty"])
def test_split_row_number_is_exact(spark, skewed, ranges, case):
    data = {"skewed": skewed, "extreme": EXTREME, "repeated": [(i, "k", 5) for i in range(40)], "empty": []}[case]
    out = grouping.split_row_number(spark.createDataFrame(data, ROWS), ["k"], "v", "id", "n")
    got = {r.id: r.n for r in out.collect()}
    assert len(got) == len(data)
    for rows in groups_of(data).values():
        order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))


def test_group_stats_keep_null_keys(spark, skewed):
    df = spark.createDataFrame(skewed, ROWS)
    out = grouping.with_group_stats(df, ["k"], n=F.count(F.lit(1)), top=F.max("v")).collect()
    groups = groups_of(skewed)
    assert len(out) == len(skewed)
    for r in out:
        values = [v for _, _, v in groups[r.k] if v is not None]
        assert (r.n, r.top) == (len(groups[r.k]), max(values))


def test_group_max_rows_keep_ties(spark, skewed, rows):
    df = spark.createDataFrame(skewed, ROWS)
    expected = []
    for group in groups_of(skewed).values():
        top = max(v for _, _, v in group if v is not None)
        expected += [r for r in group if r[2] == top]
    assert rows(grouping.group_max_rows(df, ["k"], "v"), "id", "k", "v") == sorted(expected, key=repr)


def test_first_and_duplicates(spark, skewed):
    df = spark.createDataFrame(skewed, ROWS)
    first = {r.k: r.id for r in grouping.first_per_key(df, ["k"], ["id"]).collect()}
    assert first == {k: min(r[0] for r in g) for k, g in groups_of(skewed).items()}
    flags = grouping.duplicate_flag(df, ["k"], "id", "again").collect()
    assert {r.id for r in flags if not r.again} == set(first.values())


def test_topk(spark, skewed):
    df = spark.createDataFrame(skewed, ROWS)
    out = grouping.topk_per_group(df, ["k"], "v", 4, ["id"]).collect()
    for key, group in groups_of(skewed).items():
        order = sorted(group, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))[:4]
        assert [r.id for r in sorted(out, key=lambda r: r.rank) if r.k == key] == [r[0] for r in order]


def test_null_safe_join_matches_null(spark):
    left = spark.createDataFrame([(1, None), (2, "a")], "id INT, k STRING")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k STRING, x INT")
    out = {r.id: r.x for r in grouping.null_safe_join(left, right, ["k"]).collect()}
    assert out == {1: 10, 2: None}
    anti = grouping.null_safe_join(left, right, ["k"], "left_anti").collect()
    assert [r.id for r in anti] == [2]


def test_window_ranks(spark):
    df = spark.createDataFrame(
        [(i, "k", v) for i, v in enumerate([30, 20, 20, 10, None])], ROWS
    )
    out = df.select(
        "id",
        avg_rank("v", ["k"]).alias("a"),
        tie_rank("v", ["k"], "dense").alias("d"),
        tie_rank("v", ["k"], "min").alias("m"),
        tie_rank("v", ["k"], "first", ["id"]).alias("f"),
        avg_rank("v", ["k"], ascending=True).alias("up"),
    )
    assert [tuple(r)[1:] for r in out.orderBy("id").collect()] == [
        (1.0, 1, 1, 1, 4.0), (2.5, 2, 2, 2, 2.5), (2.5, 2, 2, 3, 2.5), (4.0, 3, 4, 4, 1.0),
        (None, None, None, None, None),
    ]
    with pytest.raises(ValueError):
        tie_rank("v", ["k"], "random")


def test_average_rank_sorts_once(spark):
    df = spark.createDataFrame([(1, "k", 1)], ROWS)
    plan = df.withColumn("r", avg_rank("v", ["k"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
