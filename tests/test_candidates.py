"""Candidate selection."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from civicspark.operators import candidates as cd

NEEDS = "g INT, position INT, need BIGINT, pool BIGINT"


def test_waterfall_hand_cases(spark):
    df = spark.createDataFrame(
        [(1, 1, 5, 7), (1, 2, 4, 7), (1, 3, 3, 7), (2, 1, 2, 9), (2, 2, 1, 9)], NEEDS
    )
    got = cd.list_waterfall(df, ["g"], "position", "need", "pool").orderBy("g", "position")
    assert [r.allotted for r in got.collect()] == [5, 2, 0, 2, 1]


def test_waterfall_equals_step_by_step(spark):
    rng = random.Random(1)
    lists = {
        g: ([rng.randint(0, 9) for _ in range(rng.randint(1, 8))], rng.randint(0, 30))
        for g in range(80)
    }
    df = spark.createDataFrame(
        [(g, i, n, pool) for g, (needs, pool) in lists.items() for i, n in enumerate(needs)], NEEDS
    )
    got = {
        (r.g, r.position): r.allotted
        for r in cd.list_waterfall(df, ["g"], "position", "need", "pool").collect()
    }
    for g, (needs, pool) in lists.items():
        left = pool
        for i, need in enumerate(needs):
            assert got[(g, i)] == min(need, left)
            left -= min(need, left)
        assert pool - left == min(pool, sum(needs))


def test_ordered_list_quota_then_total(spark):
    df = spark.createDataFrame(
        [(1, 1, 10, 100, 1), (1, 2, 60, 100, 1), (1, 3, 5, 100, 1)],
        "g INT, position INT, personal BIGINT, party_votes BIGINT, seats INT",
    )
    out = cd.ordered_list(df, ["g"], "position", "personal", "party_votes", "seats")
    got = {r.position: (r.quota, r.allotted, r.total, r.elected) for r in out.collect()}
    # quota 51; the pool of 25 goes to the first on the list, the second has the quota
    assert got == {1: (51, 25, 35, False), 2: (51, 0, 60, True), 3: (51, 0, 5, False)}


def test_droop_quota_variants(spark):
    df = spark.createDataFrame([(100, 3), (99, 3)], "v BIGINT, s INT")
    row = df.select(
        cd.droop_quota(F.col("v"), F.col("s")).alias("e"),
        cd.droop_quota(F.col("v"), F.col("s"), "national").alias("n"),
    ).collect()
    assert [(r.e, r.n) for r in row] == [(26, 26), (25, 25)]


LISTS = "g INT, candidate STRING, position INT, votes BIGINT, won INT, total INT"


def test_interleaved_order(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 5, 1, 2), (1, "b", 2, 80, 1, 2), (1, "c", 3, 7, 1, 2), (1, "d", 4, 90, 1, 2)],
        LISTS,
    )
    out = cd.list_order_interleaved(df, ["g"], "position", "votes", "total")
    assert [r.candidate for r in out.orderBy("rank").collect()] == ["b", "a", "d", "c"]


def test_seat_labels(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 90, 1, 3), (1, "b", 2, 80, 1, 3), (1, "c", 3, 70, 1, 3), (1, "d", 4, 60, 1, 3)],
        LISTS,
    ).withColumn("rank", F.col("position").cast("double"))
    labels = {
        r.candidate: (r.constituency_seat, r.levelling_seat, r.substitute_rank)
        for r in cd.seat_labels(df, ["g"], "votes", "won", "total").collect()
    }
    assert labels == {
        "a": ("1K", None, None),
        "b": (None, "2T", None),
        "c": (None, "1T", None),  # the smallest total is the first
        "d": (None, None, 1.0),
    }
    plain = cd.seat_labels(df, ["g"], "votes", "won", "total", reverse_labels=False)
    assert {r.candidate: r.levelling_seat for r in plain.collect()}["b"] == "1T"


def test_tied_open_list_leaves_the_seat(spark):
    df = spark.createDataFrame([(1, "a", 1, 50, 1, 1), (1, "b", 2, 50, 1, 1)], LISTS)
    shared = cd.open_list(df, ["g"], "candidate", "votes", "total", "average").collect()
    first = cd.open_list(df, ["g"], "candidate", "votes", "total").collect()
    assert [r.elected for r in shared] == [False, False]
    assert {r.candidate for r in first if r.elected} == {"a"}


def test_person_gets_the_nth_seat(spark):
    persons = spark.createDataFrame(
        [(1, "A", "x", 1.0), (1, "A", "y", 2.0), (1, "A", "z", 5.0), (1, "B", "w", 1.0)],
        "g INT, party STRING, candidate STRING, elected_rank DOUBLE",
    )
    seats = spark.createDataFrame(
        [(1, "A", 4), (1, "A", 1), (1, "B", 2)], "g INT, party STRING, overall_rank INT"
    )
    got = {
        r.candidate: r.overall_rank
        for r in cd.person_seat_order(persons, seats, ["g"], "party").collect()
    }
    assert got == {"x": 1, "y": 4, "z": None, "w": 2}


def test_list_type_needs_all_votes_on_one_candidate(spark):
    votes = spark.createDataFrame(
        [(1, 10, "A", 30, 30), (1, 10, "A", 30, 0), (1, 11, "A", 20, 5), (1, 11, "A", 20, 15),
         (1, 10, "B", 0, 0), (1, 11, "C", None, 3)],
        "g INT, district INT, party STRING, party_allotted INT, allotted INT",
    )
    tree = spark.createDataFrame([(10, 1), (11, 2)], "district INT, area INT")
    out = cd.list_type(votes, tree, ["g"], "district", "area", "party", "party_allotted", "allotted")
    assert {(r.area, r.party): r.ordered_list for r in out.collect()} == {
        (1, "A"): True, (2, "A"): False, (1, "B"): False, (2, "C"): False,
    }


def test_list_type_is_one_row_a_list(spark):
    from civicspark.operators.candidates import list_type

    rows = [(1, 10, "A", 5, 5), (1, 11, "A", 5, 2), (1, 12, "B", 0, 0)]
    lists = spark.createDataFrame(rows, "e int, district int, party string, whole int, got int")
    places = spark.createDataFrame([(10, 1), (11, 1), (12, 1)], "district int, area int")
    found = list_type(lists, places, ["e"], "district", "area", "party", "whole", "got")
    assert {tuple(r) for r in found.collect()} == {(1, 1, "A", True), (1, 1, "B", False)}


def test_elected_table_keeps_namesakes(spark):
    rows = [
        (1, "A", 10, "Ib", 50, True, "1K", None), (1, "A", 11, "Ib", 70, True, None, "1T"),
        (1, "A", 11, "Bo", 90, True, "1K", None), (1, "A", 11, "Al", 90, True, "2K", None),
        (1, "A", 11, "Eva", 5, False, None, None), (1, "B", 10, "Ub", 4, False, None, None),
    ]
    labelled = spark.createDataFrame(
        rows, "g INT, party STRING, area INT, candidate STRING, votes BIGINT, elected BOOLEAN, "
        "constituency_seat STRING, levelling_seat STRING",
    )
    got = cd.elected_table(labelled, ["g", "party"], "area", "candidate", "votes").collect()
    assert [(r.g, r.party, r.n_elected, [tuple(x) for x in r.elected]) for r in got] == [
        (1, "A", 4, [(10, "Ib", 50, "1K"), (11, "Al", 90, "2K"), (11, "Bo", 90, "1K"), (11, "Ib", 70, "1T")])
    ]


def test_equal_list_positions_go_by_the_tiebreak(spark):
    df = spark.createDataFrame([(1, "b", 6, 5, 1), (1, "a", 6, 5, 1)], "g INT, candidate STRING, pos INT, votes INT, seats INT")
    out = cd.list_order_interleaved(df, ["g"], "pos", "votes", "seats", ["candidate"])
    assert {r.candidate: r["rank"] for r in out.collect()} == {"a": 1.0, "b": 2.0}
