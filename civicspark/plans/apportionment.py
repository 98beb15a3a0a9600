"""Seat apportionment queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from civicspark.operators import apportion as ap
from civicspark.plans.elections import EuropeanElection, constituency_seats
from civicspark.plans.registry import query
from civicspark.plans.tables import (
    CONSTITUENCY_SEATS,
    EP_SEATS,
    NATIONAL_SEATS,
)
from civicspark.session import materialize

KEYS = ["election_id"]

# Quotients of a table ``base(g, unit, votes, seats)`` with mean ranks of ties.
AVG_RANK = "rank() OVER w + (count(*) OVER t - 1) / 2.0"


@query("dhondt_national", f"""
WITH q AS (SELECT election_id, party, votes, d, votes / d::DOUBLE AS quotient
           FROM fx_national_votes, generate_series(1, {NATIONAL_SEATS}) AS s(d)),
r AS (SELECT *, {AVG_RANK} AS rk FROM q
      WINDOW w AS (PARTITION BY election_id ORDER BY quotient DESC),
             t AS (PARTITION BY election_id, quotient))
SELECT election_id, party, votes, sum((rk <= {NATIONAL_SEATS})::INT)::INT AS won
FROM r GROUP BY 1, 2, 3""")
def dhondt_national(t):
    return ap.highest_averages(t.national_votes(), KEYS, "party", "votes", NATIONAL_SEATS)


CONSTITUENCY_WON = """
cq AS (SELECT v.*, s.seats, d, round_even(votes / d::DOUBLE, 0) AS quotient
       FROM {votes} v JOIN fx_seats s USING (constituency_id, region_id),
            generate_series(1, 11) AS x(d) WHERE d <= seats),
cr AS (SELECT *, rank() OVER w + (count(*) OVER t - 1) / 2.0 AS rk FROM cq
       WINDOW w AS (PARTITION BY election_id, constituency_id ORDER BY quotient DESC),
              t AS (PARTITION BY election_id, constituency_id, quotient)),
cwon AS (SELECT election_id, region_id, constituency_id, party, votes, seats,
                sum((rk <= seats)::INT)::INT AS won FROM cr GROUP BY ALL)
"""


@query("dhondt_constituency", f"""
WITH {CONSTITUENCY_WON.format(votes="fx_party_votes")} SELECT * FROM cwon""")
def dhondt_constituency(t):
    return constituency_seats(t.party_votes(), t.seats())


def european(t, candidates: bool = False) -> EuropeanElection:
    # both stages read the votes, so the ballots are counted once
    t = t.counted(candidates)
    persons = t.national_candidates() if candidates else None
    return EuropeanElection(alliance_votes(t), EP_SEATS, persons)


def alliance_votes(t):
    """National votes with the party's alliance."""
    return t.national_votes().join(t.parties().select("party", "alliance"), "party")


ALLIANCES = f"""
av AS (SELECT v.election_id, p.alliance, v.party, v.votes
       FROM fx_national_votes v JOIN fx_party p ON v.party = p.party),
ap AS (SELECT election_id, alliance, sum(votes)::BIGINT AS alliance_votes FROM av GROUP BY 1, 2),
aq AS (SELECT *, alliance_votes / d::DOUBLE AS quotient
       FROM ap, generate_series(1, {EP_SEATS}) AS s(d)),
ar AS (SELECT *, {AVG_RANK} AS rk FROM aq
       WINDOW w AS (PARTITION BY election_id ORDER BY quotient DESC),
              t AS (PARTITION BY election_id, quotient)),
aseats AS (SELECT election_id, alliance, alliance_votes,
                  sum((rk <= {EP_SEATS})::INT)::INT AS won FROM ar GROUP BY 1, 2, 3)
"""

PARTIES_IN_ALLIANCE = ALLIANCES + f""",
pq AS (SELECT av.*, alliance_votes, won AS alliance_seats, d, votes / d::DOUBLE AS quotient
       FROM av JOIN (SELECT *, max(won) OVER (PARTITION BY election_id) AS upto FROM aseats) a
         ON av.election_id = a.election_id AND av.alliance IS NOT DISTINCT FROM a.alliance,
            generate_series(1, {EP_SEATS}) AS s(d) WHERE d <= upto),
pr AS (SELECT *, {AVG_RANK} AS rk FROM pq
       WINDOW w AS (PARTITION BY election_id, alliance ORDER BY quotient DESC),
              t AS (PARTITION BY election_id, alliance, quotient)),
pw AS (SELECT *, rk <= alliance_seats AS won, alliance_votes / rk AS order_key FROM pr)
"""


@query("alliance_stage1", f"WITH {ALLIANCES} SELECT * FROM aseats")
def alliance_stage1(t):
    return ap.alliance_seats(alliance_votes(t), KEYS, "alliance", "votes", EP_SEATS)


def alliance_quotients(t):
    return european(t).quotients


@query("alliance_stage2", f"""
WITH {PARTIES_IN_ALLIANCE}
SELECT election_id, alliance, party, votes, alliance_seats, d::INT AS divisor, quotient,
       rk::DOUBLE AS rank, won FROM pw""")
def alliance_stage2(t):
    return alliance_quotients(t).drop("alliance_votes")


@query("seat_order", f"""
WITH {PARTIES_IN_ALLIANCE}
SELECT election_id, alliance, party, d::INT AS divisor, rk::DOUBLE AS rank, won,
       (dense_rank() OVER (PARTITION BY election_id ORDER BY order_key DESC))::INT AS overall_rank
FROM pw""")
def seat_order(t):
    return european(t).seat_ranking.select(
        "election_id", "alliance", "party", "divisor", "rank", "won", "overall_rank"
    )


@query("seats_and_share", f"""
WITH {PARTIES_IN_ALLIANCE},
s AS (SELECT election_id, alliance, party, votes, sum(won::INT)::INT AS seats
      FROM pw GROUP BY 1, 2, 3, 4)
SELECT *, votes / sum(votes) OVER (PARTITION BY election_id) AS share,
       round(votes / sum(votes) OVER (PARTITION BY election_id) * 100, 2) AS share_pct FROM s""")
def seats_and_share(t):
    return european(t).party_seats


@query("alliance_effect", f"""
WITH {PARTIES_IN_ALLIANCE},
s AS (SELECT election_id, party, votes, sum(won::INT)::INT AS with_alliance FROM pw GROUP BY 1, 2, 3),
nq AS (SELECT *, votes / d::DOUBLE AS quotient FROM fx_national_votes, generate_series(1, {EP_SEATS}) x(d)),
nr AS (SELECT *, {AVG_RANK} AS rk FROM nq
       WINDOW w AS (PARTITION BY election_id ORDER BY quotient DESC),
              t AS (PARTITION BY election_id, quotient)),
n AS (SELECT election_id, party, sum((rk <= {EP_SEATS})::INT)::INT AS without_alliance FROM nr GROUP BY 1, 2)
SELECT s.election_id, s.party, votes / sum(votes) OVER (PARTITION BY s.election_id) AS share,
       with_alliance, without_alliance, with_alliance <> without_alliance AS differs
FROM s JOIN n USING (election_id, party)""")
def alliance_effect(t):
    return ap.alliance_effect(alliance_votes(t.counted()), KEYS, "party", "alliance", "votes", EP_SEATS)


def weights(t):
    return ap.apportion_weight(t.weights())


def counted_weights(t):
    """The weights, written once for queries that read them several times: one row per
    election and constituency."""
    return materialize(weights(t))


@query("apportion_weight", """
SELECT election_id, constituency_id, region_id, population, voters, area_km2, weight
FROM fx_weights""")
def apportion_weight(t):
    return weights(t)


def remainder_sql(name, source, keys, unit, weight, seats, rank):
    """Largest-remainder stage as CTEs ``<name>x``, ``<name>r``, ``<name>``."""
    part = ", ".join(keys)
    return f"""
{name}x AS (SELECT *, {weight} / (sum({weight}) OVER (PARTITION BY {part}) / ({seats})::DOUBLE) AS exact
            FROM {source}),
{name}f AS (SELECT *, exact - floor(exact) AS fraction FROM {name}x),
{name}r AS (SELECT *, {rank} AS rk,
            ({seats}) - sum(floor(exact)) OVER (PARTITION BY {part}) AS rest FROM {name}f
            WINDOW w AS (PARTITION BY {part} ORDER BY fraction DESC),
                   t AS (PARTITION BY {part}, fraction)),
{name} AS (SELECT * EXCLUDE (exact, fraction, rk, rest),
           (floor(exact) + (rk <= rest)::INT)::INT AS {name}_seats FROM {name}r)"""


REGION_WEIGHTS = """rw AS (SELECT election_id, region_id, sum(weight)::BIGINT AS region_weight
                           FROM fx_weights GROUP BY 1, 2)"""


@query("largest_remainder", f"""
WITH {REGION_WEIGHTS}, {remainder_sql("lr", "rw", ["election_id"], "region_id", "region_weight", NATIONAL_SEATS, AVG_RANK)}
SELECT election_id, region_id, region_weight, lr_seats AS seats FROM lr""")
def largest_remainder(t):
    regions = weights(t).groupBy("election_id", "region_id").agg(
        F.sum("weight").alias("region_weight")
    )
    return ap.largest_remainder(regions, KEYS, "region_id", "region_weight", NATIONAL_SEATS)


DENSE = "dense_rank() OVER w"


def nested_sql(name, source, seats):
    """Region stage and unit stage over ``source(election_id, region_id, constituency_id, weight)``."""
    return f"""
{name}g AS (SELECT election_id, region_id, sum(weight)::BIGINT AS region_weight, max({seats}) AS total
            FROM {source} GROUP BY 1, 2),
{remainder_sql(name + "u", name + "g", ["election_id"], "region_id", "region_weight", "total", DENSE)},
{name}j AS (SELECT s.election_id, s.region_id, constituency_id, weight, region_weight,
                   {name}u_seats AS region_seats
            FROM {source} s JOIN {name}u USING (election_id, region_id)),
{remainder_sql(name, name + "j", ["election_id", "region_id"], "constituency_id", "weight", "region_seats", DENSE)}"""


@query("nested_remainder", f"""
WITH {nested_sql("nr", "fx_weights", str(CONSTITUENCY_SEATS))}
SELECT election_id, region_id, constituency_id, weight, region_weight, region_seats,
       nr_seats AS seats FROM nr""")
def nested_remainder(t):
    return ap.nested_remainder(
        counted_weights(t).select("election_id", "region_id", "constituency_id", "weight"),
        KEYS, "region_id", "constituency_id", "weight", CONSTITUENCY_SEATS,
    )


FLOOR = 6


@query("remainder_with_floor", f"""
WITH {nested_sql("a", "fx_weights", str(CONSTITUENCY_SEATS))},
flagged AS (SELECT election_id, region_id, constituency_id, weight, a_seats < {FLOOR} AS guaranteed,
                   {CONSTITUENCY_SEATS} - {FLOOR} * sum((a_seats < {FLOOR})::INT)
                     OVER (PARTITION BY election_id) AS open_seats FROM a),
others AS (SELECT * FROM flagged WHERE NOT guaranteed),
{nested_sql("b", "others", "open_seats")}
SELECT election_id, region_id, constituency_id, weight, false AS guaranteed, b_seats AS seats FROM b
UNION ALL
SELECT election_id, region_id, constituency_id, weight, true, {FLOOR} FROM flagged WHERE guaranteed""")
def remainder_with_floor(t):
    return ap.largest_remainder_with_floor(
        counted_weights(t), KEYS, "region_id", "constituency_id", "weight", CONSTITUENCY_SEATS, FLOOR
    )


@query("levelling_pool", f"""
WITH {REGION_WEIGHTS}, {remainder_sql("lr", "rw", ["election_id"], "region_id", "region_weight", NATIONAL_SEATS, AVG_RANK)},
{nested_sql("nr", "fx_weights", str(CONSTITUENCY_SEATS))},
u AS (SELECT election_id, region_id, sum(nr_seats)::INT AS unit_seats FROM nr GROUP BY 1, 2)
SELECT election_id, r_name AS region_name, lr_seats AS region_seats, unit_seats,
       lr_seats - unit_seats AS pool
FROM lr JOIN u USING (election_id, region_id) JOIN region ON r_regionkey = region_id""")
def levelling_pool(t):
    pool = ap.levelling_pool(
        counted_weights(t), KEYS, "region_id", "constituency_id", "weight",
        NATIONAL_SEATS, CONSTITUENCY_SEATS,
    )
    names = t("region").select(F.col("r_regionkey").alias("region_id"), "r_name")
    return pool.join(names, "region_id").select(
        "election_id", F.col("r_name").alias("region_name"), "region_seats", "unit_seats", "pool"
    )


@query("region_seat_totals", f"""
WITH {CONSTITUENCY_WON.format(votes="fx_party_votes")},
rs AS (SELECT region_id, sum(seats)::INT AS region_seats FROM fx_seats GROUP BY 1)
SELECT election_id, region_id, party, sum(won)::INT AS won, max(region_seats)::INT AS region_seats
FROM cwon JOIN rs USING (region_id) GROUP BY 1, 2, 3""")
def region_seat_totals(t):
    won = constituency_seats(t.party_votes(), t.seats()).groupBy("election_id", "region_id", "party").agg(
        F.sum("won").cast("int").alias("won")
    )
    return won.join(t.region_seats(), "region_id")


@query("divisor_tables", """
WITH areas AS (SELECT DISTINCT election_id, constituency_id FROM fx_party_votes),
steps AS (SELECT a.election_id, s.constituency_id, s.seats, step
          FROM fx_seats s JOIN areas a USING (constituency_id), (VALUES (1), (2), (3)) x(step))
SELECT election_id, constituency_id, step::INT AS step, (1 + step * (i - 1))::INT AS divisor
FROM steps, generate_series(1, 11) g(i) WHERE i <= seats""")
def divisor_tables(t):
    areas = t.party_votes("election_id", "constituency_id").drop("votes").join(
        t.seats(), "constituency_id"
    )
    steps = areas.withColumn("step", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return ap.divisor_table(steps, ["election_id", "constituency_id", "step"], "seats", "step")


@query("seat_distribution", f"""
WITH {nested_sql("nr", "fx_weights", str(CONSTITUENCY_SEATS))}
SELECT election_id, constituency_id, s.seats AS current_seats, nr_seats AS recomputed_seats,
       nr_seats - s.seats AS change
FROM nr JOIN fx_seats s USING (constituency_id)""")
def seat_distribution(t):
    recomputed = nested_remainder(t).select(
        "election_id", "constituency_id", F.col("seats").alias("recomputed_seats")
    )
    current = t.seats().select("constituency_id", F.col("seats").alias("current_seats"))
    return recomputed.join(current, "constituency_id").withColumn(
        "change", F.col("recomputed_seats") - F.col("current_seats")
    )


@query("seat_distribution_table", f"""
WITH {REGION_WEIGHTS}, {remainder_sql("lr", "rw", ["election_id"], "region_id", "region_weight", NATIONAL_SEATS, AVG_RANK)},
{nested_sql("nr", "fx_weights", str(CONSTITUENCY_SEATS))},
u AS (SELECT election_id, region_id, sum(nr_seats)::INT AS unit_seats FROM nr GROUP BY 1, 2),
stacked AS (
  SELECT election_id, region_id, NULL::INT AS constituency_id, NULL::INT AS current_seats, NULL::INT AS recomputed_seats,
         pool AS current_levelling, (lr_seats - unit_seats)::INT AS recomputed_levelling
  FROM lr JOIN u USING (election_id, region_id) JOIN fx_region_pool USING (region_id)
  UNION ALL
  SELECT election_id, nr.region_id, constituency_id, s.seats, nr_seats, NULL, NULL
  FROM nr JOIN fx_seats s USING (constituency_id))
SELECT *, row_number() OVER (PARTITION BY election_id ORDER BY region_id, constituency_id NULLS FIRST)::INT AS place FROM stacked""")
def seat_distribution_table(t):
    """Regions with their compensatory seats, each followed by its constituencies with theirs."""
    table = weights(t).select("election_id", "region_id", "constituency_id", "weight")
    counted = materialize(table)
    pools = ap.levelling_pool(
        counted, KEYS, "region_id", "constituency_id", "weight", NATIONAL_SEATS, CONSTITUENCY_SEATS
    ).join(t.region_pool().withColumnRenamed("pool", "current_levelling"), "region_id")
    regions = pools.select(
        "election_id", "region_id", "current_levelling", F.col("pool").cast("int").alias("recomputed_levelling")
    )
    units = ap.nested_remainder(counted, KEYS, "region_id", "constituency_id", "weight", CONSTITUENCY_SEATS)
    units = units.select("election_id", "region_id", "constituency_id", F.col("seats").alias("recomputed_seats")).join(
        t.seats().select("constituency_id", F.col("seats").alias("current_seats")), "constituency_id"
    )
    # an election has a handful of areas
    order = Window.partitionBy(*KEYS).orderBy("region_id", F.col("constituency_id").asc_nulls_first())
    stacked = regions.unionByName(units, allowMissingColumns=True)
    return stacked.withColumn("place", F.row_number().over(order)).orderBy("election_id", "place")


@query("all_elections", f"""
WITH {PARTIES_IN_ALLIANCE}
SELECT election_id, party, votes, sum(won::INT)::INT AS seats,
       min(CASE WHEN won THEN overall END)::INT AS first_seat_no
FROM (SELECT *, dense_rank() OVER (PARTITION BY election_id ORDER BY order_key DESC) AS overall FROM pw)
GROUP BY 1, 2, 3""")
def all_elections(t):
    """Every election's report in one keyed job."""
    ordered = european(t).seat_ranking
    return ordered.groupBy("election_id", "party", "votes").agg(
        F.sum(F.col("won").cast("int")).cast("int").alias("seats"),
        F.min(F.when(F.col("won"), F.col("overall_rank"))).alias("first_seat_no"),
    )


@query("report_party_seats", f"""
WITH {PARTIES_IN_ALLIANCE},
s AS (SELECT election_id, alliance, party, votes, sum(won::INT)::INT AS seats FROM pw GROUP BY 1, 2, 3, 4)
SELECT election_id, party, votes, round(votes / sum(votes) OVER (PARTITION BY election_id) * 100, 2) AS share_pct,
       seats FROM s QUALIFY seats > 0""")
def report_party_seats(t):
    """Parties with seats, their votes and vote share."""
    return (
        seats_and_share(t)
        .where("seats > 0")
        .select("election_id", "party", "votes", "share_pct", "seats")
    )


@query("report_seat_ranking", f"""
WITH {PARTIES_IN_ALLIANCE}
SELECT election_id, party, alliance, quotient, rk::DOUBLE AS rank, order_key,
       (dense_rank() OVER (PARTITION BY election_id ORDER BY order_key DESC))::INT AS overall_rank, won FROM pw""")
def report_seat_ranking(t):
    """Full quotient ranking in award order; the won rows are the seats."""
    return (
        european(t).seat_ranking
        .select(
            "election_id", "party", "alliance", "quotient", "rank", "order_key", "overall_rank", "won"
        )
        .orderBy("election_id", "overall_rank")
    )
