"""Thresholds, entitlements and placement."""

from __future__ import annotations

import random

import pytest

from civicspark.operators import levelling as lv
from civicspark.operators import threshold as th


def test_region_rule_alone_qualifies(spark):
    national = spark.createDataFrame(
        [(1, "A", 980_000), (1, "B", 15_000), (1, "C", 5_000)], "g INT, party STRING, votes BIGINT"
    )
    regional = spark.createDataFrame(
        [(1, 1, "A", 90), (1, 1, "B", 12), (1, 2, "A", 80), (1, 2, "B", 11), (1, 2, "C", 2),
         (1, 3, "A", 999), (1, 3, "C", 1)],
        "g INT, region_id INT, party STRING, votes BIGINT",
    )
    won = spark.createDataFrame([(1, "A", 9), (1, "B", 0)], "g INT, party STRING, won INT")
    seats = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "region_id INT, region_seats INT")
    result = {
        r.party: (r.seat_rule, r.region_rule, r.share_rule, r.qualified)
        for r in th.threshold(national, regional, won, seats, ["g"]).collect()
    }
    assert result == {
        "A": (True, True, True, True),
        "B": (False, True, False, True),
        "C": (False, False, False, False),  # no seat row at all: under, not unknown
    }


def test_share_is_strict_unless_inclusive(spark):
    votes = spark.createDataFrame([(1, "A", 98), (1, "B", 2)], "g INT, party STRING, votes BIGINT")
    strict = {r.party: r.share_rule for r in th.share_rule(votes, ["g"]).collect()}
    loose = {r.party: r.share_rule for r in th.share_rule(votes, ["g"], inclusive=True).collect()}
    assert strict["B"] is False and loose["B"] is True


QUALIFIED = "g INT, party STRING, votes BIGINT, constituency_seats INT"


def test_totals_without_overhang(spark):
    df = spark.createDataFrame([(1, "A", 60, 5), (1, "B", 30, 2), (1, "C", 10, 0)], QUALIFIED)
    got = {
        r.party: (r.triggered, r.levelling_seats, r.total_seats)
        for r in lv.levelling_totals(df, ["g"], 10).collect()
    }
    assert got == {"A": (False, 1, 6), "B": (False, 1, 3), "C": (False, 1, 1)}


def test_totals_with_overhang(spark):
    # A holds 8 of 10 seats but is entitled to 6. C, entitled to less than one, holds its
    # rounded-down zero and is left out as well, so B gets the other two
    df = spark.createDataFrame([(1, "A", 60, 8), (1, "B", 31, 0), (1, "C", 9, 0)], QUALIFIED)
    got = {
        r.party: (r.triggered, r.excluded, r.levelling_seats, r.total_seats)
        for r in lv.levelling_totals(df, ["g"], 10).collect()
    }
    assert got == {
        "A": (True, True, 0, 8),
        "B": (True, False, 2, 2),
        "C": (True, True, 0, 0),
    }


def test_party_exactly_at_its_entitlement_is_excluded_only_when_triggered(spark):
    df = spark.createDataFrame(
        [(1, "A", 50, 6), (1, "B", 30, 3), (1, "C", 20, 0),
         (2, "A", 50, 5), (2, "B", 30, 3), (2, "C", 20, 0)],
        QUALIFIED,
    )
    got = {
        (r.g, r.party): (r.excluded, r.total_seats)
        for r in lv.levelling_totals(df, ["g"], 10).collect()
    }
    assert got[(1, "B")] == (True, 3)
    assert got[(2, "B")] == (False, 3)
    assert got[(1, "C")] == (False, 1) and got[(2, "C")] == (False, 2)


def test_struck_quotients_are_the_largest(spark, rows):
    df = spark.createDataFrame([(1, "A", 90, 2, 4)], "g INT, party STRING, votes BIGINT, used INT, n INT")
    cells = lv.placement_quotients(df, ["g"], "used", "n", step=2)
    assert rows(cells, "divisor", "struck", "quotient") == [
        (1, True, None), (3, True, None), (5, False, 18.0), (7, False, 90 / 7),
    ]


CAND = "g INT, region INT, party STRING, divisor INT, q DOUBLE, region_cap INT, party_cap INT"


def greedy_loop(cells, total):
    """Search the largest open quotient again for every seat."""
    regions, parties, taken = {}, {}, []
    left = [c for c in cells if c[4] is not None]
    while len(taken) < total:
        open_cells = [
            c for c in left
            if regions.get(c[1], 0) < c[5] and parties.get(c[2], 0) < c[6]
        ]
        if not open_cells:
            break
        best = max(open_cells, key=lambda c: c[4])
        left.remove(best)
        regions[best[1]] = regions.get(best[1], 0) + 1
        parties[best[2]] = parties.get(best[2], 0) + 1
        taken.append((best[0], best[1], best[2], best[3], best[4], len(taken) + 1))
    return taken


def test_greedy_equals_repeated_search(spark):
    rng = random.Random(5)
    cells, expected = [], []
    for g in range(25):
        regions = {r: rng.randint(0, 5) for r in range(rng.randint(1, 4))}
        parties = {p: rng.randint(0, 5) for p in "ABCDEF"[: rng.randint(1, 6)]}
        group = [
            (g, r, p, d, None if rng.random() < 0.15 else rng.random() * 100, rc, pc)
            for r, rc in regions.items()
            for p, pc in parties.items()
            for d in range(1, 7)
        ]
        # quotients of one pair fall with the divisor, as they do in use
        fixed = []
        for r in regions:
            for p in parties:
                pair = [c for c in group if c[1] == r and c[2] == p]
                values = sorted((c[4] for c in pair if c[4] is not None), reverse=True)
                for c in pair:
                    q = values.pop(0) if c[4] is not None else None
                    fixed.append((*c[:4], q, *c[5:]))
        cells += fixed
        expected += greedy_loop(fixed, 8)
    df = spark.createDataFrame(cells, CAND)
    awards = lv.capped_greedy(
        df, ["g"], "q", "region", "region_cap", "party", "party_cap", 8, ["divisor"]
    )
    got = [
        (r.g, r.region, r.party, r.divisor, r.q, r.award_no) for r in awards.collect()
    ]
    assert sorted(got) == sorted(expected)


def test_greedy_breaks_exact_ties_and_stops_when_caps_close(spark):
    df = spark.createDataFrame(
        [(1, 1, "A", 1, 10.0, 1, 1), (1, 2, "A", 1, 10.0, 1, 1), (1, 1, "B", 1, 10.0, 1, 1)], CAND
    )
    awards = lv.capped_greedy(
        df, ["g"], "q", "region", "region_cap", "party", "party_cap", 5, ["divisor"]
    )
    assert [(r.region, r.party, r.award_no) for r in awards.orderBy("award_no").collect()] == [
        (1, "A", 1)
    ]


CELLS = "g INT, region INT, area INT, party STRING, votes BIGINT, used INT, awards INT"


@pytest.mark.parametrize(("divisors", "placed"), [("sufficient", 2), ("reference", 1)])
def test_placement_needs_enough_divisors(spark, divisors, placed):
    # with 2 awards the reference bound has divisors 1 and 4; both of area 1 are used
    df = spark.createDataFrame(
        [(1, 1, 1, "A", 900, 2, 2), (1, 1, 2, "A", 100, 1, 2)], CELLS
    )
    cells = lv.constituency_placement(
        df, ["g"], "region", "area", "party", "used", "awards", divisors
    )
    assert cells.where("placed").count() == placed


def test_unknown_divisor_rule_is_rejected():
    with pytest.raises(ValueError):
        lv.divisor_count("used", None, "used", ["g"], "other")
