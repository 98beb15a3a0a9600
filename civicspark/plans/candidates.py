"""Candidate selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import candidates as cd
from civicspark.operators import geo
from civicspark.operators.grouping import with_group_stats
from civicspark.operators.reshape import danish_rank, member_text
from civicspark.plans.apportionment import PARTIES_IN_ALLIANCE, european
from civicspark.plans.elections import rank_lists
from civicspark.plans.levelling import PLACED, election
from civicspark.plans.registry import query
from civicspark.session import materialize

KEYS = ["election_id"]
LIST = ["election_id", "party"]
LOCAL = ["election_id", "constituency_id", "party"]

# ---- two-stage elections: one national list per party -------------------------------

PARTY_SEATS = PARTIES_IN_ALLIANCE + """,
pseats AS (SELECT election_id, party, votes AS party_votes, sum(won::INT)::INT AS seats
           FROM pw GROUP BY 1, 2, 3),
nc AS (SELECT c.election_id, c.party, candidate, list_pos, personal_votes, list_votes, ordered_list,
              seats, party_votes
       FROM fx_national_candidates c JOIN pseats USING (election_id, party))
"""

OPEN_LISTS = PARTY_SEATS + """,
ol AS (SELECT *, row_number() OVER (PARTITION BY election_id, party
                                    ORDER BY personal_votes DESC, candidate)::INT AS rank
       FROM nc WHERE NOT ordered_list),
ol2 AS (SELECT *, rank <= seats AS elected FROM ol)
"""


@query("open_list", f"""
WITH {OPEN_LISTS}
SELECT election_id, party, candidate, personal_votes, seats, rank, elected FROM ol2""")
def open_list(t):
    return european(t, candidates=True).open_lists.select(
        "election_id", "party", "candidate", "personal_votes", "seats", "rank", "elected"
    )


SUBSTITUTES = OPEN_LISTS + """,
ol3 AS (SELECT *, row_number() OVER (PARTITION BY election_id, party, elected ORDER BY rank)::DOUBLE AS r
        FROM ol2)
"""


@query("substitute_order", f"""
WITH {SUBSTITUTES}
SELECT election_id, party, candidate, elected, CASE WHEN elected THEN r END AS elected_rank,
       CASE WHEN NOT elected THEN r END AS substitute_rank FROM ol3""")
def substitute_order(t):
    return cd.substitute_order(european(t, candidates=True).open_lists, LIST).select(
        "election_id", "party", "candidate", "elected", "elected_rank", "substitute_rank"
    )


@query("droop_quota", f"""
WITH {PARTY_SEATS}
SELECT election_id, party, party_votes, seats,
       (floor(party_votes / (seats + 1)::DOUBLE) + 1)::BIGINT AS european_quota,
       floor(party_votes / (seats + 1)::DOUBLE + 1)::BIGINT AS national_quota FROM pseats""")
def droop_quota(t):
    votes, seats = F.col("party_votes"), F.col("seats")
    lists = european(t).party_seats.withColumnRenamed("votes", "party_votes")
    return lists.select("election_id", "party", "seats", "party_votes").withColumns(
        {
            "european_quota": cd.droop_quota(votes, seats),
            "national_quota": cd.droop_quota(votes, seats, "national"),
        }
    )


ORDERED_LISTS = PARTY_SEATS + """,
wl AS (SELECT *, party_votes - sum(personal_votes) OVER (PARTITION BY election_id, party) AS pool,
              floor(party_votes / (seats + 1)::DOUBLE)::BIGINT + 1 AS quota
       FROM nc WHERE ordered_list),
wl2 AS (SELECT *, greatest(quota - personal_votes, 0) AS need FROM wl),
wl3 AS (SELECT *, least(need, greatest(0, pool - coalesce(sum(need) OVER (
                  PARTITION BY election_id, party ORDER BY list_pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS allotted FROM wl2),
wl4 AS (SELECT *, personal_votes + allotted AS total FROM wl3),
wl5 AS (SELECT *, row_number() OVER (PARTITION BY election_id, party
                                     ORDER BY total DESC, list_pos)::INT AS rank FROM wl4),
wl6 AS (SELECT *, total >= quota OR rank <= seats AS elected FROM wl5)
"""


@query("list_waterfall", f"""
WITH {ORDERED_LISTS}
SELECT election_id, party, candidate, list_pos, pool::BIGINT AS pool, quota, need::BIGINT AS need,
       allotted FROM wl6""")
def list_waterfall(t):
    return european(t, candidates=True).ordered_lists.select(
        "election_id", "party", "candidate", "list_pos", "pool", "quota", "need", "allotted"
    )


@query("list_winners", f"""
WITH {ORDERED_LISTS}
SELECT election_id, party, candidate, list_pos, total, quota, rank, elected FROM wl6""")
def list_winners(t):
    return european(t, candidates=True).ordered_lists.select(
        "election_id", "party", "candidate", "list_pos", "total", "quota", "rank", "elected"
    )


RANKING = OPEN_LISTS + "," + ORDERED_LISTS.removeprefix(PARTY_SEATS).lstrip().lstrip(",") + """,
ol3 AS (SELECT *, row_number() OVER (PARTITION BY election_id, party, elected ORDER BY rank)::DOUBLE AS r
        FROM ol2),
wl7 AS (SELECT *, row_number() OVER (PARTITION BY election_id, party, elected ORDER BY rank)::DOUBLE AS r
        FROM wl6),
ranking AS (
  SELECT election_id, party, candidate, ordered_list, personal_votes, elected,
         CASE WHEN elected THEN r END AS elected_rank, CASE WHEN NOT elected THEN r END AS substitute_rank
  FROM ol3
  UNION ALL
  SELECT election_id, party, candidate, ordered_list, personal_votes, elected,
         CASE WHEN elected THEN list_pos::DOUBLE END, CASE WHEN NOT elected THEN r END
  FROM wl7),
nth AS (SELECT election_id, party,
               overall::INT AS overall_rank,
               row_number() OVER (PARTITION BY election_id, party ORDER BY overall) AS n
        FROM (SELECT *, dense_rank() OVER (PARTITION BY election_id ORDER BY order_key DESC) AS overall
              FROM pw) WHERE won),
person_order AS (SELECT ranking.*, overall_rank FROM ranking LEFT JOIN nth
                 ON nth.election_id = ranking.election_id AND nth.party = ranking.party
                    AND nth.n = ranking.elected_rank)
"""

HEADS = ("Aa", "Å", "Æ", "Ø", "Z")


@query("candidate_ranking", f"""
WITH {RANKING},
named AS (SELECT *, {list(HEADS)}[length(candidate) % 5 + 1] || candidate AS name FROM ranking)
SELECT *, row_number() OVER (PARTITION BY election_id, party ORDER BY name COLLATE da, name)::INT AS name_order FROM named""")
def candidate_ranking(t):
    """Both list types in one table; ``name_order`` is a candidate's place in Danish name order."""
    heads = F.array(*[F.lit(h) for h in HEADS])
    name = F.concat(F.element_at(heads, F.length("candidate") % 5 + 1), "candidate")
    ranking = european(t, candidates=True).ranking.withColumn("name", name)
    return ranking.withColumn("name_order", danish_rank("name", LIST))


@query("person_seat_order", f"WITH {RANKING} SELECT * FROM person_order")
def person_seat_order(t):
    return european(t, candidates=True).person_order


@query("report_elected", f"""
WITH {RANKING}
SELECT election_id, party, candidate, personal_votes, elected_rank, overall_rank
FROM person_order WHERE elected""")
def report_elected(t):
    return (
        european(t, candidates=True)
        .person_order.where("elected")
        .select(
            "election_id", "party", "candidate", "personal_votes", "elected_rank", "overall_rank"
        )
        .orderBy("election_id", "overall_rank", "party", "elected_rank")
    )


@query("elected_names", f"""
WITH {RANKING}
SELECT election_id, party, count(*)::INT AS n_elected, string_agg(candidate, ', ' ORDER BY candidate) AS elected
FROM ranking WHERE elected GROUP BY 1, 2""")
def elected_names(t):
    chosen = european(t, candidates=True).ranking.where(F.col("elected")).select("election_id", "party", "candidate")
    return member_text(chosen, LIST, "candidate", "elected", distinct=False)


# ---- national elections: one list per party and constituency -------------------------


@query("list_type", """
WITH c AS (SELECT *, sum(list_votes) OVER (PARTITION BY election_id, constituency_id, party) AS party_list
           FROM fx_candidates),
f AS (SELECT election_id, constituency_id, party,
             bool_or(party_list = list_votes AND party_list > 0) AS ordered_list FROM c GROUP BY 1, 2, 3)
SELECT election_id, n_regionkey AS region_id, party, bool_or(ordered_list) AS ordered_list
FROM f JOIN nation ON n_nationkey = constituency_id GROUP BY 1, 2, 3""")
def list_type(t):
    lists = t.counted(candidates=True).candidates()
    allotted = with_group_stats(lists, LOCAL, party_list=F.sum("list_votes"))
    pairs = geo.level_pairs(t.seats(), "region_id", "constituency_id")
    return cd.list_type(
        allotted, pairs, KEYS, "constituency_id", "region_id", "party", "party_list", "list_votes"
    )


@query("list_type_catalogue", """
WITH p AS (SELECT election_id, party, chr(64 + CAST(substr(party, 7) AS INT)) AS letter
           FROM (SELECT DISTINCT election_id, party FROM fx_party_votes)),
c AS (SELECT DISTINCT election_id, CASE election_id % 3 WHEN 0 THEN 'CFO' WHEN 1 THEN 'R' END AS letters
      FROM fx_party_votes)
SELECT election_id, party, letter,
       coalesce(list_contains(string_split(letters, ''), letter), false) AS ordered_list
FROM p JOIN c USING (election_id)""")
def list_type_catalogue(t):
    pairs = t.national_votes().select("election_id", "party")
    letter = F.char(F.substr(F.col("party"), F.lit(7)).cast("int") + 64)
    letters = F.when(F.col("election_id") % 3 == 0, "CFO").when(F.col("election_id") % 3 == 1, "R")
    years = t("orders").select(F.year("o_orderdate").alias("election_id")).distinct()
    catalogue = years.withColumn("letters", letters)
    return cd.list_type_from_catalogue(
        pairs.withColumn("letter", letter), catalogue, KEYS, "letter", "letters"
    )


LOCAL_LISTS = PLACED + """,
lp AS (SELECT election_id, constituency_id, party, sum((rk <= awards)::INT)::INT AS levelling
       FROM ck GROUP BY 1, 2, 3),
final_seats AS (SELECT election_id, constituency_id, party, used AS won, coalesce(levelling, 0)::INT AS levelling
                FROM cells LEFT JOIN lp USING (election_id, constituency_id, party)),
whole AS (SELECT *, sum(list_votes) OVER (PARTITION BY election_id, constituency_id, party) AS party_list
          FROM fx_skewed_candidates),
types AS (SELECT election_id, region_id, party, bool_or(party_list = list_votes AND party_list > 0) AS ordered_list
          FROM whole JOIN fx_seats USING (constituency_id) GROUP BY 1, 2, 3),
lc AS (SELECT c.election_id, c.constituency_id, c.party, candidate, list_pos,
              personal_votes + list_votes AS total_votes, coalesce(ordered_list, false) AS ordered_list,
              coalesce(won, 0) AS won, coalesce(levelling, 0) AS levelling,
              coalesce(won, 0) + coalesce(levelling, 0) AS seats
       FROM fx_skewed_candidates c JOIN fx_seats s ON s.constituency_id = c.constituency_id
            LEFT JOIN final_seats f ON f.election_id = c.election_id AND f.party = c.party
                                   AND f.constituency_id = c.constituency_id
            LEFT JOIN types t ON t.election_id = c.election_id AND t.party = c.party AND t.region_id = s.region_id),
lq AS (SELECT *, floor(sum(total_votes) OVER (PARTITION BY election_id, constituency_id, party)
                       / (seats + 1)::DOUBLE + 1)::BIGINT AS quota FROM lc WHERE ordered_list),
lq2 AS (SELECT *, total_votes > quota AS over_quota FROM lq),
lq3 AS (SELECT *, row_number() OVER (PARTITION BY election_id, constituency_id, party, over_quota
                                     ORDER BY list_pos) AS nth FROM lq2),
li AS (SELECT *, row_number() OVER (PARTITION BY election_id, constituency_id, party
                                    ORDER BY nth, over_quota DESC)::DOUBLE AS rank FROM lq3),
lo AS (SELECT *, (rank() OVER w + (count(*) OVER t - 1) / 2.0)::DOUBLE AS rank FROM lc WHERE NOT ordered_list
       WINDOW w AS (PARTITION BY election_id, constituency_id, party ORDER BY total_votes DESC),
              t AS (PARTITION BY election_id, constituency_id, party, total_votes)),
merged AS (SELECT election_id, constituency_id, party, candidate, ordered_list, total_votes, won, seats,
                  rank, quota, over_quota FROM li
           UNION ALL
           SELECT election_id, constituency_id, party, candidate, ordered_list, total_votes, won, seats,
                  rank, NULL, NULL FROM lo)
"""


def local_persons(t):
    persons = t.skewed_candidates()
    return persons.withColumn("total_votes", F.col("personal_votes") + F.col("list_votes"))


def local_types(t):
    """List types by region, from the votes: the constituencies are its districts."""
    allotted = with_group_stats(t.skewed_candidates(), LOCAL, party_list=F.sum("list_votes"))
    pairs = geo.level_pairs(t.seats(), "region_id", "constituency_id")
    return cd.list_type(
        allotted, pairs, KEYS, "constituency_id", "region_id", "party", "party_list", "list_votes"
    )


def local_lists(t):
    """Candidates with the constituency and the compensatory seats of their lists."""
    t = t.counted(candidates=True)
    return election(t).lists(local_persons(t), local_types(t))


@query("candidate_enrich", f"""
WITH RECURSIVE {LOCAL_LISTS}
SELECT election_id, constituency_id, party, candidate, total_votes, won, levelling, seats, ordered_list
FROM lc""")
def candidate_enrich(t):
    return local_lists(t).select(
        "election_id", "constituency_id", "party", "candidate", "total_votes", "won", "levelling",
        "seats", "ordered_list",
    )


def interleaved(lists):
    return cd.list_order_interleaved(
        lists.where("ordered_list"), LOCAL, "list_pos", "total_votes", "seats", ["candidate"]
    )


@query("list_order_interleaved", f"""
WITH RECURSIVE {LOCAL_LISTS}
SELECT election_id, constituency_id, party, candidate, quota, over_quota, rank FROM li""")
def list_order_interleaved(t):
    return interleaved(local_lists(t)).select(
        "election_id", "constituency_id", "party", "candidate", "quota", "over_quota", "rank"
    )


MERGED = [
    "election_id", "constituency_id", "party", "candidate", "ordered_list", "total_votes", "won",
    "seats", "rank", "quota", "over_quota",
]


def merged_lists(t):
    lists = materialize(local_lists(t))
    opened = cd.open_list(
        lists.where(~F.col("ordered_list")), LOCAL, "candidate", "total_votes", "seats", "average"
    )
    return cd.merge_list_types(opened, interleaved(lists)).select(*MERGED)


@query("merge_list_types", f"WITH RECURSIVE {LOCAL_LISTS} SELECT * FROM merged")
def merge_list_types(t):
    return merged_lists(t)


LABELS = LOCAL_LISTS.rstrip() + """,
m1 AS (SELECT *, rank <= seats AS elected FROM merged),
m2 AS (SELECT *, (rank() OVER w + (count(*) OVER t - 1) / 2.0)::DOUBLE AS seat_rank FROM m1
       WINDOW w AS (PARTITION BY election_id, constituency_id, party, elected ORDER BY rank),
              t AS (PARTITION BY election_id, constituency_id, party, elected, rank)),
m3 AS (SELECT *, elected AND seat_rank <= won AS direct, elected AND seat_rank > won AS lev FROM m2),
m4 AS (SELECT *, (rank() OVER w + (count(*) OVER t - 1) / 2.0)::DOUBLE AS lrank FROM m3
       WINDOW w AS (PARTITION BY election_id, constituency_id, party, lev ORDER BY total_votes),
              t AS (PARTITION BY election_id, constituency_id, party, lev, total_votes)),
labels AS (SELECT election_id, constituency_id, party, candidate, total_votes, elected,
                  CASE WHEN direct THEN replace(seat_rank::VARCHAR, '.0', '') || 'K' END AS constituency_seat,
                  CASE WHEN lev THEN replace(lrank::VARCHAR, '.0', '') || 'T' END AS levelling_seat,
                  CASE WHEN NOT elected THEN seat_rank END AS substitute_rank
           FROM m4)
"""


@query("seat_labels", f"""
WITH RECURSIVE {LABELS}
SELECT election_id, constituency_id, party, candidate, elected, constituency_seat, levelling_seat, substitute_rank
FROM labels""")
def seat_labels(t):
    return rank_lists(materialize(local_lists(t))).select(
        "election_id", "constituency_id", "party", "candidate", "elected", "constituency_seat",
        "levelling_seat", "substitute_rank",
    )


@query("elected_by_party", f"""
WITH RECURSIVE {LABELS}
SELECT election_id, party, count(*)::INT AS n_elected,
       CAST(to_json(list({{'constituency_id': constituency_id, 'candidate': candidate, 'total_votes': total_votes,
                           'label': coalesce(constituency_seat, levelling_seat)}}
                         ORDER BY constituency_id, total_votes DESC, candidate)) AS VARCHAR) AS elected
FROM labels WHERE elected GROUP BY 1, 2""")
def elected_by_party(t):
    """Nested tables of the elected, as JSON text to be compared with their order."""
    t = t.counted(candidates=True)
    nested = election(t).elected(local_persons(t), local_types(t))
    return nested.withColumn("elected", F.to_json("elected"))
