"""Apportionment: hand cases, ties, and brute force over many groups at once."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from civicspark.operators import apportion as ap

VOTES = "g INT, unit STRING, votes BIGINT, seats INT"


def avg_ranks(values):
    """Mean ranks, largest first."""
    return [
        sum(1 for w in values if w > v) + (sum(1 for w in values if w == v) + 1) / 2 for v in values
    ]


def brute_highest(votes, seats, step=1, rounded=False):
    cells = [
        (u, round(v / (1 + step * i)) if rounded else v / (1 + step * i))
        for u, v in votes.items()
        for i in range(max(seats, 1))
    ]
    won = dict.fromkeys(votes, 0)
    for (unit, _), rank in zip(cells, avg_ranks([q for _, q in cells])):
        won[unit] += rank <= seats
    return won


def seats_of(df, ties="average", **options):
    out = ap.highest_averages(df, ["g"], "unit", "votes", "seats", ties=ties, **options)
    return {(r.g, r.unit): r.won for r in out.collect()}


@pytest.mark.parametrize(
    ("votes", "seats", "ties", "expected"),
    [
        ({"A": 100, "B": 80, "C": 30, "D": 20}, 8, "average", [4, 3, 1, 0]),
        ({"A": 10, "B": 10}, 1, "average", [0, 0]),
        ({"A": 10, "B": 10}, 1, "first", [1, 0]),
        ({"A": 10, "B": 10, "C": 10}, 2, "average", [1, 1, 1]),
        ({"A": 7}, 3, "average", [3]),
        ({"A": 7, "B": 0}, 2, "average", [2, 0]),
        ({"A": 7, "B": 5}, 0, "average", [0, 0]),
        ({"A": 0, "B": 0}, 2, "first", [2, 0]),
    ],
)
def test_hand_cases(spark, votes, seats, ties, expected):
    df = spark.createDataFrame([(1, u, v, seats) for u, v in votes.items()], VOTES)
    won = seats_of(df, ties)
    assert [won[(1, u)] for u in votes] == expected


def random_groups(seed, groups=60):
    rng = random.Random(seed)
    out = {}
    for g in range(groups):
        scale = rng.choice([5, 60, 1000, 10**6])
        units = [f"U{i:02d}" for i in range(rng.randint(1, 9))]
        out[g] = ({u: rng.randint(0, scale) for u in units}, rng.randint(0, 25))
    return out


def frame(spark, groups):
    return spark.createDataFrame(
        [(g, u, v, s) for g, (votes, s) in groups.items() for u, v in votes.items()], VOTES
    )


@pytest.mark.parametrize("step", [1, 2, 3])
@pytest.mark.parametrize("rounded", [False, True])
def test_pruned_equals_unpruned_and_brute_force(spark, step, rounded):
    groups = random_groups(step * 10 + rounded)
    df = frame(spark, groups)
    pruned = seats_of(df, step=step, round_quotient=rounded)
    assert pruned == seats_of(df, step=step, round_quotient=rounded, prune=False)
    expected = {
        (g, u): n
        for g, (votes, s) in groups.items()
        for u, n in brute_highest(votes, s, step, rounded).items()
    }
    assert pruned == expected


def test_first_ties_always_fill(spark):
    groups = random_groups(7)
    df = frame(spark, groups)
    won = seats_of(df, "first")
    for g, (votes, seats) in groups.items():
        assert sum(won[(g, u)] for u in votes) == seats


def test_more_votes_never_lose_seats(spark):
    groups = random_groups(11)
    df = frame(spark, groups)
    more = df.withColumn("votes", F.when(F.col("unit") == "U00", F.col("votes") * 2 + 1).otherwise(F.col("votes")))
    before, after = seats_of(df, "first"), seats_of(more, "first")
    assert all(after[(g, "U00")] >= before[(g, "U00")] for g in groups)


def test_pruning_cuts_the_exploded_rows(spark):
    df = spark.createDataFrame([(1, f"U{i}", 1000 - i, 100) for i in range(50)], VOTES)
    full = ap.highest_averages(df, ["g"], "unit", "votes", "seats", prune=False, detail=True)
    cut = ap.highest_averages(df, ["g"], "unit", "votes", "seats", detail=True)
    assert full.count() == 5000
    assert cut.count() <= 4 * 50 + 100


def test_divisor_table(spark, rows):
    df = spark.createDataFrame([(1, 3), (2, 0)], "g INT, n INT")
    assert rows(ap.divisor_table(df, ["g"], "n", 3)) == [(1, 1), (1, 4), (1, 7)]


PARTIES = "g INT, party STRING, alliance STRING, votes BIGINT"


def test_parties_without_alliance_share_one_pool(spark):
    df = spark.createDataFrame(
        [(1, "A", "X", 50), (1, "B", "X", 30), (1, "C", None, 40), (1, "D", None, 35)], PARTIES
    )
    pools = ap.alliance_seats(df, ["g"], "alliance", "votes", 5)
    assert {(r.alliance, r.alliance_votes, r.won) for r in pools.collect()} == {
        ("X", 80, 3), (None, 75, 2),
    }
    seats = ap.alliance_party_seats(df, ["g"], "party", "alliance", "votes", 5)
    assert {r.party: r.seats for r in seats.collect()} == {"A": 2, "B": 1, "C": 1, "D": 1}


def test_alliance_can_change_the_result(spark):
    df = spark.createDataFrame(
        [(1, "A", "X", 30), (1, "B", "X", 29), (1, "C", None, 58)], PARTIES
    )
    effect = {
        r.party: (r.with_alliance, r.without_alliance, r.differs)
        for r in ap.alliance_effect(df, ["g"], "party", "alliance", "votes", 1).collect()
    }
    assert effect == {"A": (1, 0, True), "B": (0, 0, False), "C": (0, 1, True)}


def test_seat_order_counts_every_seat_once(spark):
    df = spark.createDataFrame(
        [(1, "A", "X", 50), (1, "B", "X", 31), (1, "C", "Y", 47), (1, "D", None, 23)], PARTIES
    )
    quotients = ap.alliance_party_quotients(df, ["g"], "party", "alliance", "votes", 6)
    won = ap.seat_order(quotients, ["g"]).where("won")
    assert sorted(r.overall_rank for r in won.collect()) == [1, 2, 3, 4, 5, 6]


WEIGHTS = "g INT, unit STRING, weight BIGINT"


def test_largest_remainder_hand_case(spark):
    df = spark.createDataFrame(
        [(1, u, w) for u, w in zip("ABCDEF", (47, 16, 16, 12, 5, 4))], WEIGHTS
    )
    got = {}
    for ties in ("average", "first", "dense"):
        seats = ap.largest_remainder(df, ["g"], "unit", "weight", 10, ties)
        got[ties] = [r.seats for r in seats.orderBy("unit").collect()]
    assert got["average"] == got["first"] == [5, 2, 2, 1, 0, 0]
    # B and C share a dense rank, so the next fraction gets a seat too many
    assert got["dense"] == [5, 2, 2, 1, 1, 0]


def test_largest_remainder_against_fractions(spark):
    rng = random.Random(3)
    groups = {g: [rng.randint(1, 5000) for _ in range(rng.randint(1, 12))] for g in range(50)}
    df = spark.createDataFrame(
        [(g, f"U{i:02d}", w) for g, ws in groups.items() for i, w in enumerate(ws)], WEIGHTS
    )
    got = {}
    for r in ap.largest_remainder(df, ["g"], "unit", "weight", 40, "first").collect():
        got.setdefault(r.g, {})[int(r.unit[1:])] = r.seats
    for g, weights in groups.items():
        exact = [Fraction(w * 40, sum(weights)) for w in weights]
        assert sum(got[g].values()) == 40
        assert all(got[g][i] in (math.floor(x), math.floor(x) + 1) for i, x in enumerate(exact))


REGIONS = "g INT, region STRING, unit STRING, weight BIGINT"


def test_floor_gives_the_minimum_once(spark):
    df = spark.createDataFrame(
        [(1, "R", "a", 500), (1, "R", "b", 300), (1, "S", "c", 190), (1, "S", "d", 10)], REGIONS
    )
    plain = ap.nested_remainder(df, ["g"], "region", "unit", "weight", 10)
    assert {r.unit: r.seats for r in plain.collect()} == {"a": 5, "b": 3, "c": 2, "d": 0}
    floor = ap.largest_remainder_with_floor(df, ["g"], "region", "unit", "weight", 10, 2)
    got = {r.unit: (r.seats, r.guaranteed) for r in floor.collect()}
    assert got == {"a": (4, False), "b": (2, False), "c": (2, False), "d": (2, True)}
    unguarded = ap.largest_remainder_with_floor(
        df, ["g"], "region", "unit", "weight", 10, 2, guarded=["a"]
    )
    assert {r.unit: r.seats for r in unguarded.collect()} == {"a": 5, "b": 3, "c": 2, "d": 0}


def test_levelling_pool_is_the_difference(spark):
    df = spark.createDataFrame(
        [(1, "R", "a", 500), (1, "R", "b", 300), (1, "S", "c", 190), (1, "S", "d", 10)], REGIONS
    )
    pool = ap.levelling_pool(df, ["g"], "region", "unit", "weight", 15, 10)
    assert {r.region: (r.region_seats, r.unit_seats, r.pool) for r in pool.collect()} == {
        "R": (12, 8, 4), "S": (3, 2, 1),
    }


def test_empty_input(spark):
    df = spark.createDataFrame([], VOTES)
    assert ap.highest_averages(df, ["g"], "unit", "votes", "seats").count() == 0
