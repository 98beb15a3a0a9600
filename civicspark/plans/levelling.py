"""Threshold, entitlement and compensatory-seat queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions.rank import avg_rank
from civicspark.operators import levelling as lv
from civicspark.operators import threshold as th
from civicspark.plans.apportionment import CONSTITUENCY_WON
from civicspark.plans.elections import NationalElection, constituency_seats
from civicspark.plans.registry import query
from civicspark.plans.tables import LEVELLED_TOTAL

KEYS = ["election_id"]
LEVELLED = 66

WON = CONSTITUENCY_WON.format(votes="fx_skewed_votes")

RULES = f"""{WON},
rule1 AS (SELECT election_id, party, sum(won) > 0 AS seat_rule, sum(won)::INT AS constituency_seats
          FROM cwon GROUP BY 1, 2),
reg AS (SELECT election_id, region_id, party, sum(votes)::BIGINT AS votes FROM fx_skewed_votes GROUP BY 1, 2, 3),
rs AS (SELECT region_id, sum(seats)::INT AS region_seats FROM fx_seats GROUP BY 1),
rover AS (SELECT election_id, party,
                 votes > sum(votes) OVER (PARTITION BY election_id, region_id) / region_seats::DOUBLE AS o
          FROM reg JOIN rs USING (region_id)),
rule2 AS (SELECT election_id, party, sum(o::INT)::INT AS regions_over, sum(o::INT) >= 2 AS region_rule
          FROM rover GROUP BY 1, 2),
nat AS (SELECT election_id, party, sum(votes)::BIGINT AS votes FROM fx_skewed_votes GROUP BY 1, 2),
rule3 AS (SELECT *, votes / sum(votes) OVER (PARTITION BY election_id) * 100 AS share_pct FROM nat),
rules AS (SELECT r3.*, share_pct > 2.0 AS share_rule,
                 coalesce(constituency_seats, 0) AS constituency_seats,
                 coalesce(regions_over, 0) AS regions_over,
                 coalesce(seat_rule, false) AS seat_rule, coalesce(region_rule, false) AS region_rule
          FROM rule3 r3 LEFT JOIN rule1 USING (election_id, party)
               LEFT JOIN rule2 USING (election_id, party)),
qual AS (SELECT election_id, party, votes, constituency_seats FROM rules
         WHERE seat_rule OR region_rule OR share_rule)
"""

TOTALS = RULES + f""",
ent AS (SELECT *, sum(votes) OVER g / {LEVELLED_TOTAL}::DOUBLE AS quota FROM qual
        WINDOW g AS (PARTITION BY election_id)),
ent2 AS (SELECT *, votes / quota AS entitled, constituency_seats > floor(votes / quota) AS over_represented
         FROM ent),
ent3 AS (SELECT *, bool_or(over_represented) OVER (PARTITION BY election_id) AS triggered FROM ent2),
ov AS (SELECT *, triggered AND constituency_seats >= floor(entitled) AS excluded FROM ent3),
ov2 AS (SELECT *, coalesce(sum(CASE WHEN excluded THEN constituency_seats END) OVER g, 0)::INT AS held,
               sum(CASE WHEN NOT excluded THEN votes END) OVER g AS open_votes
        FROM ov WINDOW g AS (PARTITION BY election_id)),
ov3 AS (SELECT *, CASE WHEN triggered THEN open_votes / ({LEVELLED_TOTAL} - held)::DOUBLE ELSE quota END AS quota2
        FROM ov2),
ov4 AS (SELECT *, CASE WHEN NOT excluded THEN votes / quota2 END AS entitled2 FROM ov3),
rem AS (SELECT *, floor(entitled2)::INT AS whole, entitled2 - floor(entitled2) AS fraction FROM ov4),
rem2 AS (SELECT *, ({LEVELLED_TOTAL} - held - coalesce(sum(whole) OVER (PARTITION BY election_id), 0))::INT AS rest,
                CASE WHEN fraction IS NOT NULL THEN
                  (rank() OVER (PARTITION BY election_id ORDER BY fraction DESC NULLS LAST)
                   + (count(*) OVER (PARTITION BY election_id, fraction) - 1) / 2.0)::DOUBLE END AS fraction_rank
         FROM rem),
tot AS (SELECT *, fraction_rank <= rest AS remainder_seat,
               coalesce(whole + (fraction_rank <= rest)::INT - constituency_seats, 0)::INT AS levelling_seats
        FROM rem2)
"""


def election(t) -> NationalElection:
    return NationalElection(
        t.skewed_votes(), t.seats(), t.region_pool(), LEVELLED_TOTAL, LEVELLED
    )


@query("threshold_seat", f"""WITH {RULES} SELECT * FROM rule1""")
def threshold_seat(t):
    return th.seat_rule(constituency_seats(t.skewed_votes(), t.seats()), KEYS, "party")


@query("threshold_regions", f"""WITH {RULES} SELECT * FROM rule2""")
def threshold_regions(t):
    votes = t.skewed_votes().groupBy("election_id", "region_id", "party").agg(
        F.sum("votes").alias("votes")
    )
    return th.region_rule(votes, t.region_seats(), KEYS, "region_id", "party")


@query("threshold_share", f"""
WITH {RULES} SELECT election_id, party, votes, share_pct, share_pct > 2.0 AS share_rule FROM rule3""")
def threshold_share(t):
    votes = t.skewed_votes().groupBy("election_id", "party").agg(F.sum("votes").alias("votes"))
    return th.share_rule(votes, KEYS)


@query("threshold_any", f"""
WITH {RULES} SELECT *, seat_rule OR region_rule OR share_rule AS qualified FROM rules""")
def threshold_any(t):
    return election(t).rules


@query("entitlement", f"""
WITH {TOTALS}
SELECT election_id, party, votes, constituency_seats, quota, entitled, over_represented, triggered
FROM ent3""")
def entitlement(t):
    return lv.entitlement(election(t).qualified, KEYS, LEVELLED_TOTAL)


@query("overhang_requota", f"""
WITH {TOTALS}
SELECT election_id, party, constituency_seats, excluded, held, quota2, entitled2 FROM ov4""")
def overhang_requota(t):
    entitled = entitlement(t)
    return lv.overhang_requota(entitled, KEYS, LEVELLED_TOTAL).select(
        "election_id", "party", "constituency_seats", "excluded", "held", "quota2", "entitled2"
    )


@query("levelling_remainder", f"""
WITH {TOTALS}
SELECT election_id, party, whole, fraction, rest, fraction_rank, remainder_seat FROM tot""")
def levelling_remainder(t):
    return election(t).totals.select(
        "election_id", "party", "whole", "fraction", "rest", "fraction_rank", "remainder_seat"
    )


@query("party_totals", f"""
WITH {TOTALS}
SELECT election_id, party, votes, constituency_seats, levelling_seats, remainder_seat,
       (levelling_seats + constituency_seats)::INT AS total_seats FROM tot""")
def party_totals(t):
    return election(t).totals.select(
        "election_id", "party", "votes", "constituency_seats", "levelling_seats",
        "remainder_seat", "total_seats",
    )


PLACES = TOTALS + f""",
rwon AS (SELECT election_id, region_id, party, sum(won)::INT AS used FROM cwon GROUP BY 1, 2, 3),
place AS (SELECT reg.election_id, reg.region_id, reg.party, reg.votes, coalesce(used, 0) AS used,
                 levelling_seats AS party_cap, pool AS region_cap,
                 coalesce(used, 0) + least(levelling_seats, pool) AS n
          FROM reg JOIN tot USING (election_id, party) JOIN fx_region_pool USING (region_id)
               LEFT JOIN rwon ON rwon.election_id = reg.election_id AND rwon.region_id = reg.region_id
                             AND rwon.party = reg.party),
rq AS (SELECT election_id, region_id, party, votes, used, party_cap, region_cap, i::INT AS ordinal,
              (2 * i - 1)::INT AS divisor, i <= used AS struck,
              CASE WHEN i > used THEN votes / (2 * i - 1)::DOUBLE END AS quotient
       FROM place, generate_series(1, {LEVELLED_TOTAL}) g(i) WHERE i <= n),
cand AS (SELECT *, row_number() OVER (PARTITION BY election_id
                                      ORDER BY quotient DESC, region_id, party, divisor) AS rn
         FROM rq WHERE quotient IS NOT NULL)
"""

GREEDY = PLACES + f""",
walk AS (
  SELECT election_id, 0::BIGINT AS rn, list_resize([]::INT[], 5, 0) AS rused,
         map([]::VARCHAR[], []::INT[]) AS cused, 0 AS n,
         NULL::INT AS region_id, NULL::VARCHAR AS party, NULL::INT AS divisor,
         NULL::DOUBLE AS quotient, false AS hit
  FROM (SELECT DISTINCT election_id FROM cand)
  UNION ALL
  SELECT election_id, rn,
         CASE WHEN hit THEN list_transform(rused, lambda x, k: CASE WHEN k = region_id + 1 THEN x + 1 ELSE x END) ELSE rused END,
         CASE WHEN hit THEN map_concat(cused, map([party], [coalesce(cused[party], 0) + 1])) ELSE cused END,
         n + hit::INT, region_id, party, divisor, quotient, hit
  FROM (SELECT c.election_id, c.rn, w.rused, w.cused, w.n, c.region_id, c.party, c.divisor, c.quotient,
               w.n < {LEVELLED} AND w.rused[c.region_id + 1] < c.region_cap
                 AND coalesce(w.cused[c.party], 0) < c.party_cap AS hit
        FROM walk w JOIN cand c ON c.election_id = w.election_id AND c.rn = w.rn + 1)),
award AS (SELECT election_id, region_id, party, divisor, quotient, n AS award_no FROM walk WHERE hit),
regaward AS (SELECT election_id, region_id, party, count(*)::INT AS awards FROM award GROUP BY 1, 2, 3)
"""


@query("region_quotients", f"WITH RECURSIVE {PLACES} SELECT * FROM rq")
def region_quotients(t):
    return election(t).region_cells


@query("capped_greedy", f"WITH RECURSIVE {GREEDY} SELECT * FROM award")
def capped_greedy(t):
    return election(t).awards


@query("capped_greedy_log", f"""
WITH RECURSIVE {GREEDY},
rk AS (SELECT election_id, region_id, party, divisor,
              (rank() OVER (PARTITION BY election_id ORDER BY quotient DESC)
               + (count(*) OVER (PARTITION BY election_id, quotient) - 1) / 2.0)::DOUBLE AS national_rank,
              (rank() OVER (PARTITION BY election_id, region_id ORDER BY quotient DESC)
               + (count(*) OVER (PARTITION BY election_id, region_id, quotient) - 1) / 2.0)::DOUBLE AS region_rank
       FROM cand)
SELECT award.*, national_rank, region_rank,
       (count(*) OVER (PARTITION BY election_id, party ORDER BY award_no))::INT AS party_awards,
       (count(*) OVER (PARTITION BY election_id, region_id ORDER BY award_no))::INT AS region_awards
FROM award JOIN rk USING (election_id, region_id, party, divisor)""")
def capped_greedy_log(t):
    chain = election(t)
    open_cells = chain.region_cells.where(F.col("quotient").isNotNull())
    ranks = open_cells.select(
        "election_id",
        "region_id",
        "party",
        "divisor",
        avg_rank("quotient", KEYS).alias("national_rank"),
        avg_rank("quotient", ["election_id", "region_id"]).alias("region_rank"),
    )
    progress = lv.award_progress(chain.awards, KEYS, "region_id", "party")
    return progress.join(ranks, ["election_id", "region_id", "party", "divisor"])


@query("levelling_by_region", f"""
WITH RECURSIVE {GREEDY}
SELECT reg.election_id, reg.region_id, reg.party, coalesce(awards, 0)::INT AS awards
FROM reg JOIN qual USING (election_id, party)
     LEFT JOIN regaward a ON a.election_id = reg.election_id AND a.region_id = reg.region_id
                         AND a.party = reg.party""")
def levelling_by_region(t):
    return election(t).region_awards


PLACED = GREEDY + f""",
cells AS (SELECT c.election_id, c.region_id, c.constituency_id, c.party, c.votes, c.won AS used,
                 coalesce(a.awards, 0) AS awards
          FROM cwon c JOIN qual USING (election_id, party)
               LEFT JOIN regaward a ON a.election_id = c.election_id AND a.region_id = c.region_id
                                   AND a.party = c.party),
cc AS (SELECT *, (3 * i - 2)::INT AS divisor,
              CASE WHEN i > used THEN votes / (3 * i - 2)::DOUBLE END AS cquotient
       FROM cells, generate_series(1, {LEVELLED_TOTAL}) g(i) WHERE i <= used + awards),
ck AS (SELECT *, CASE WHEN cquotient IS NOT NULL THEN
                 (rank() OVER (PARTITION BY election_id, region_id, party ORDER BY cquotient DESC NULLS LAST)
                  + (count(*) OVER (PARTITION BY election_id, region_id, party, cquotient) - 1) / 2.0)::DOUBLE
              END AS rk FROM cc)
"""


@query("constituency_placement", f"""
WITH RECURSIVE {PLACED}
SELECT election_id, region_id, constituency_id, party, used, awards, divisor,
       cquotient AS quotient, rk AS rank, coalesce(rk <= awards, false) AS placed FROM ck""")
def constituency_placement(t):
    return election(t).constituency_cells.select(
        "election_id", "region_id", "constituency_id", "party", "used", "awards", "divisor",
        "quotient", "rank", "placed",
    )


@query("seats_by_constituency", f"""
WITH RECURSIVE {PLACED},
p AS (SELECT election_id, constituency_id, party, sum((rk <= awards)::INT)::INT AS levelling_seats
      FROM ck GROUP BY 1, 2, 3)
SELECT election_id, region_id, constituency_id, party, used AS constituency_seats,
       coalesce(p.levelling_seats, 0) AS levelling_seats
FROM cells LEFT JOIN p USING (election_id, constituency_id, party)""")
def seats_by_constituency(t):
    return election(t).seats_by_constituency
