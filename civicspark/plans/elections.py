"""Whole elections: every result table of a report from votes, seats and candidates.

Each class takes a table of many elections and works on all of them in one job. Results
are lazy; the few small tables that several results share are written once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.operators import apportion as ap
from civicspark.operators import candidates as cd
from civicspark.operators import levelling as lv
from civicspark.operators import reshape
from civicspark.operators import threshold as th
from civicspark.session import materialize

KEYS = ["election_id"]
PARTY = ["election_id", "party"]
REGION_PARTY = ["election_id", "region_id", "party"]
LIST = ["election_id", "constituency_id", "party"]


def constituency_seats(votes: DataFrame, seats: DataFrame) -> DataFrame:
    """Seats per constituency and party from rounded quotients.

    A constituency without a seat row has no seats; its votes stay.
    """
    known = votes.join(seats.select("constituency_id", "seats"), "constituency_id", "left")
    return ap.highest_averages(
        known.withColumn("seats", F.coalesce("seats", F.lit(0))),
        ["election_id", "region_id", "constituency_id"],
        "party",
        "votes",
        "seats",
        round_quotient=True,
    )


class NationalElection:
    """Constituency seats, thresholds, compensatory seats and elected candidates.

    ``votes`` (election_id, region_id, constituency_id, party, votes), ``seats``
    (constituency_id, region_id, seats), ``region_pool`` (region_id, pool). Only the tally
    with its seats is written, once; it has one row per election, constituency and party, and
    all other results are plans on it.
    """

    def __init__(
        self,
        votes: DataFrame,
        seats: DataFrame,
        region_pool: DataFrame,
        total_seats: int,
        levelling_seats: int,
        share: float = 2.0,
        min_regions: int = 2,
        divisors: str = "sufficient",
    ):
        self._votes = votes
        self.seats = seats
        self.region_pool = region_pool
        self.total_seats = total_seats
        self.levelling_seats = levelling_seats
        self.share = share
        self.min_regions = min_regions
        self.divisors = divisors

    @cached_property
    def won(self) -> DataFrame:
        """Constituency seats per party, the only pass over the given votes."""
        return materialize(constituency_seats(self._votes, self.seats))

    @property
    def votes(self) -> DataFrame:
        return self.won.select("election_id", "region_id", "constituency_id", "party", "votes")

    @property
    def regional_votes(self) -> DataFrame:
        return self.votes.groupBy(*REGION_PARTY).agg(F.sum("votes").alias("votes"))

    @property
    def rules(self) -> DataFrame:
        """Every party with its threshold rules and whether it qualifies."""
        return th.threshold(
            self.votes.groupBy(*PARTY).agg(F.sum("votes").alias("votes")),
            self.regional_votes,
            self.won,
            self.seats.groupBy("region_id").agg(F.sum("seats").cast("int").alias("region_seats")),
            KEYS,
            share=self.share,
            min_regions=self.min_regions,
        )

    @property
    def qualified(self) -> DataFrame:
        return self.rules.where("qualified").select(*PARTY, "votes", "constituency_seats")

    @property
    def totals(self) -> DataFrame:
        """Compensatory and total seats per qualifying party."""
        return lv.levelling_totals(self.qualified, KEYS, self.total_seats)

    @property
    def result_table(self) -> DataFrame:
        """Seats per party with a total row per election."""
        sums = {c: c for c in ("total_seats", "constituency_seats", "levelling_seats")}
        return reshape.totals_row(self.totals, "party", "I alt", sums, KEYS)

    @property
    def region_cells(self) -> DataFrame:
        """Open and struck quotients of every qualifying party in every region."""
        won = self.won.groupBy(*REGION_PARTY).agg(F.sum("won").cast("int").alias("used"))
        caps = self.totals.select(*PARTY, F.col("levelling_seats").alias("party_cap"))
        places = (
            self.regional_votes.join(caps, PARTY)
            .join(self.region_pool.withColumnRenamed("pool", "region_cap"), "region_id")
            .join(won, REGION_PARTY, "left")
            .withColumn("used", F.coalesce("used", F.lit(0)))
        )
        owed = F.least("party_cap", "region_cap")
        count = lv.divisor_count("used", owed, "used", ["election_id", "region_id"], self.divisors)
        return lv.placement_quotients(places, KEYS, "used", count, step=2)

    @property
    def awards(self) -> DataFrame:
        """Compensatory seats in award order, by region and party."""
        return lv.capped_greedy(
            self.region_cells, KEYS, "quotient", "region_id", "region_cap", "party", "party_cap",
            self.levelling_seats, payload=["divisor"],
        )

    @property
    def region_awards(self) -> DataFrame:
        """Compensatory seats per region and qualifying party, zeros included."""
        counted = self.awards.groupBy(*REGION_PARTY).agg(
            F.count(F.lit(1)).cast("int").alias("awards")
        )
        pairs = self.regional_votes.drop("votes").join(self.totals.select(*PARTY), PARTY)
        return pairs.join(counted, REGION_PARTY, "left").withColumn(
            "awards", F.coalesce("awards", F.lit(0))
        )

    @property
    def constituency_cells(self) -> DataFrame:
        """Quotients of the constituencies and which of them place a compensatory seat."""
        won = self.won.withColumnRenamed("won", "used").drop("seats")
        cells = won.join(self.region_awards, REGION_PARTY)
        return lv.constituency_placement(
            cells, KEYS, "region_id", "constituency_id", "party", "used", "awards", self.divisors
        )

    @property
    def seats_by_constituency(self) -> DataFrame:
        """Final seats of every qualifying party in every constituency."""
        placed = self.constituency_cells.groupBy(*LIST).agg(
            F.sum(F.col("placed").cast("int")).cast("int").alias("levelling_seats")
        )
        won = self.won.join(self.totals.select(*PARTY), PARTY)
        return won.join(placed, LIST, "left").select(
            "election_id",
            "region_id",
            "constituency_id",
            "party",
            F.col("won").alias("constituency_seats"),
            F.coalesce("levelling_seats", F.lit(0)).alias("levelling_seats"),
        )

    def lists(self, persons: DataFrame, list_types: DataFrame) -> DataFrame:
        """Candidates with the constituency and compensatory seats of their list and its type.

        ``persons`` (election_id, constituency_id, party, candidate, list_pos, total_votes);
        ``list_types`` (any of its key columns or region_id, party, ordered_list). A list without
        seats has 0, one of unknown type is an open one.
        """
        seats = self.seats_by_constituency.select(
            *LIST,
            F.col("constituency_seats").alias("won"),
            F.col("levelling_seats").alias("levelling"),
        )
        if "region_id" in list_types.columns:
            areas = self.seats.select("constituency_id", "region_id")
            list_types = list_types.join(areas, "region_id").drop("region_id")
        on = [c for c in LIST if c in list_types.columns]
        lists = cd.candidate_enrich(persons, seats, list_types, LIST, on)
        return lists.withColumn("seats", F.col("won") + F.col("levelling")).withColumn(
            "ordered_list", F.coalesce("ordered_list", F.lit(False))
        )

    def candidates(self, persons: DataFrame, list_types: DataFrame) -> DataFrame:
        """All candidates with rank, seat label or substitute number, from ``lists``."""
        return rank_lists(materialize(self.lists(persons, list_types)))

    def elected(self, persons: DataFrame, list_types: DataFrame) -> DataFrame:
        """Per party a nested table of the elected with constituency, votes and seat label."""
        labelled = self.candidates(persons, list_types)
        return cd.elected_table(labelled, PARTY, "constituency_id", "candidate", "total_votes")


def rank_lists(lists: DataFrame) -> DataFrame:
    """Rank both list types by their rules and label the seats."""
    ordered = F.coalesce("ordered_list", F.lit(False))
    opened = cd.open_list(lists.where(~ordered), LIST, "candidate", "total_votes", "seats", "average")
    numbered = cd.list_order_interleaved(
        lists.where(ordered), LIST, "list_pos", "total_votes", "seats", ["candidate"]
    )
    merged = cd.merge_list_types(opened.drop("elected"), numbered)
    return cd.seat_labels(merged, LIST, "total_votes", "won", "seats")


class EuropeanElection:
    """Alliances, seat order and elected persons of national lists.

    ``votes`` (election_id, party, alliance, votes); ``seats`` a number or a column of
    ``votes``; ``persons`` (election_id, party, candidate, list_pos, personal_votes,
    ordered_list) where candidates are wanted.
    """

    RANKING = [
        "election_id", "party", "candidate", "ordered_list", "personal_votes", "elected",
        "elected_rank", "substitute_rank",
    ]

    def __init__(self, votes: DataFrame, seats: int | str, persons: DataFrame | None = None):
        self.votes = votes
        self.seats = seats
        self.persons = persons

    @property
    def quotients(self) -> DataFrame:
        """Every party's quotients inside its alliance."""
        return ap.alliance_party_quotients(
            self.votes, KEYS, "party", "alliance", "votes", self.seats
        )

    @property
    def party_seats(self) -> DataFrame:
        """Seats, vote share and rounded percentage per party."""
        seats = ap.alliance_party_seats(
            self.votes, KEYS, "party", "alliance", "votes", self.seats
        )
        return seats.withColumn("share_pct", F.round(F.col("share") * 100, 2))

    @property
    def seat_ranking(self) -> DataFrame:
        """All quotients with the order in which they win; ``won`` marks the seats."""
        return ap.seat_order(self.quotients, KEYS)

    @property
    def seat_orders(self) -> DataFrame:
        """Votes and seats per party, with the places of its seats in the national order."""
        places = F.sort_array(F.collect_list(F.when(F.col("won"), F.col("overall_rank"))))
        return self.seat_ranking.groupBy(*PARTY, F.col("votes").alias("party_votes")).agg(
            F.sum(F.col("won").cast("int")).cast("int").alias("seats"), places.alias("places")
        )

    @property
    def lists(self) -> DataFrame:
        """Persons with their party's seats, votes and seat places.

        A party without votes has no seats, and a list of unknown type is an open one.
        """
        known = {c: F.coalesce(c, F.lit(0)) for c in ("seats", "party_votes")}
        known["ordered_list"] = F.coalesce("ordered_list", F.lit(False))
        return self.persons.join(self.seat_orders, PARTY, "left").withColumns(known)

    @property
    def open_lists(self) -> DataFrame:
        return cd.open_list(
            self.lists.where(~F.col("ordered_list")), PARTY, "candidate", "personal_votes", "seats"
        )

    @property
    def ordered_lists(self) -> DataFrame:
        return cd.ordered_list(
            self.lists.where("ordered_list"), PARTY, "list_pos", "personal_votes", "party_votes",
            "seats", ["candidate"],
        )

    def _ranked(self, *more: str) -> DataFrame:
        opened = cd.substitute_order(self.open_lists, PARTY).select(*self.RANKING, *more)
        ordered = cd.substitute_order(self.ordered_lists, PARTY, "list_pos").select(*self.RANKING, *more)
        return cd.merge_list_types(opened, ordered)

    @property
    def ranking(self) -> DataFrame:
        """Both list types in one table, with elected and substitute order."""
        return self._ranked()

    @property
    def person_order(self) -> DataFrame:
        """The ranking with each elected person's place in the national seat order.

        The place is looked up in the party's nested places, so the quotients of an election
        are computed once.
        """
        place = cd.nth_place("places", "elected_rank").alias("overall_rank")
        return self._ranked("places").select(*self.RANKING, place)
