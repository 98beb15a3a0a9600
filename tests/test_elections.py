"""Whole elections, from landed documents to elected candidates."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from civicspark.plans.elections import EuropeanElection, NationalElection
from civicspark.sources import catalogue, counts

PARTIES = {"A": 260, "B": 180, "C": 90, "D": 40, "E": 12, "F": 3}
AREAS = {"10": "7", "11": "7", "12": "7", "13": "7", "14": "8", "15": "8", "16": "8", "17": "9",
         "18": "9", "19": "9"}


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    """Party and person documents of two elections in the published ten constituencies."""
    folder = tmp_path_factory.mktemp("landing")
    rng = random.Random(9)
    for election in (2022, 2026):
        for area in AREAS:
            parties, persons = "", ""
            for party, weight in PARTIES.items():
                people = rng.sample(range(1, weight * 14 + 25), 25)
                listed = rng.randint(1, weight) * 60
                votes = sum(people) + listed
                parties += (
                    f'<Parti Id="{party}" Bogstav="{party}" Navn="{party}" StemmerAntal="{votes}"/>'
                )
                persons += f'<Parti Id="{party}" Bogstav="{party}" navn="{party}" TildeltePartiStemmer="{listed}">'
                for i, own in enumerate(people):
                    given = listed if party == "B" and i == 0 else 0
                    persons += (
                        f'<Person Navn="{party}{i:02d}" PersonligeStemmer="{own}" '
                        f'TildeltePartiStemmer="{given}" StemmerIAlt="{own + given}"/>'
                    )
                persons += "</Parti>"
            head = f'<Status Kode="1">Færdig</Status><Sted Id="{area}">Storkreds {area}</Sted>'
            for kind, body in (
                ("party", f"<Stemmer>{parties}</Stemmer>"), ("person", f"<Personer>{persons}</Personer>")
            ):
                target = folder / kind / f"election_id={election}"
                target.mkdir(parents=True, exist_ok=True)
                (target / f"{area}.xml").write_text(f"<Data>{head}{body}</Data>", encoding="utf-8")
    return folder


@pytest.fixture(scope="module")
def national(spark, landing):
    tree = spark.createDataFrame(list(AREAS.items()), "constituency_id STRING, region_id STRING")
    votes = (
        counts.read_party_votes(spark, str(landing / "party"))
        .withColumnRenamed("area_id", "constituency_id")
        .join(tree, "constituency_id")
        .select("election_id", "region_id", "constituency_id", "party", "votes")
    )
    seats = catalogue.constituency_seats(spark).join(tree, "constituency_id")
    pool = catalogue.region_pool(spark).select("region_id", "pool")
    return NationalElection(votes, seats, pool, 175, 40)


def test_every_seat_is_awarded_once(national):
    table = {(r.election_id, r.party): r for r in national.result_table.collect()}
    for election in (2022, 2026):
        total = table[(election, "I alt")]
        assert (total.total_seats, total.constituency_seats, total.levelling_seats) == (175, 135, 40)
    awards = national.awards.groupBy("election_id").count().collect()
    assert {r["count"] for r in awards} == {40}
    regions = national.awards.groupBy("election_id", "region_id").count().collect()
    assert {(r.region_id, r["count"]) for r in regions} == {("7", 11), ("8", 15), ("9", 14)}


def test_small_parties_stay_below_the_threshold(national):
    under = {r.party for r in national.rules.where("NOT qualified").collect()}
    assert "F" in under and not under & {"A", "B", "C"}


def test_candidates_fill_the_constituency_seats(spark, landing, national):
    persons = (
        counts.read_candidate_votes(spark, str(landing / "person"))
        .withColumnRenamed("area_id", "constituency_id")
        .withColumn("list_pos", F.right("candidate", F.lit(2)).cast("int"))
    )
    types = spark.createDataFrame([(p, p == "B") for p in PARTIES], "party STRING, ordered_list BOOLEAN")
    chosen = national.candidates(
        persons.select("election_id", "constituency_id", "party", "candidate", "list_pos", "total_votes"),
        types,
    )
    by_list = chosen.groupBy("election_id", "constituency_id", "party").agg(
        F.count("constituency_seat").alias("k"),
        F.count("levelling_seat").alias("t"),
        F.count("substitute_rank").alias("s"),
        F.max("won").alias("won"),
        F.max("seats").alias("seats"),
        F.count(F.lit(1)).alias("n"),
    ).collect()
    assert len(by_list) == 2 * 10 * len(PARTIES)
    # no two candidates of a list have equal votes, so no rank is shared
    for r in by_list:
        assert (r.k, r.k + r.t, r.k + r.t + r.s) == (r.won, r.seats, r.n)
    assert sum(r.seats for r in by_list) == 2 * 175


def test_european_election_with_published_alliances(spark):
    alliances = catalogue.alliances(spark).where("election_id = 2024")
    letters = "ABCFIMOVÆØÅ"
    votes = spark.createDataFrame(
        [(2024, p, 1000 + 137 * i + 7 * i * i) for i, p in enumerate(letters)], "election_id INT, party STRING, votes BIGINT"
    ).join(alliances.withColumnRenamed("letter", "party"), ["election_id", "party"], "left")
    persons = spark.createDataFrame(
        [(2024, p, f"{p}{i}", i, 200 - 10 * i, p == "Ø") for p in letters for i in range(1, 6)],
        "election_id INT, party STRING, candidate STRING, list_pos INT, personal_votes BIGINT, ordered_list BOOLEAN",
    )
    election = EuropeanElection(votes, 15, persons)
    assert election.party_seats.agg(F.sum("seats")).first()[0] == 15
    assert sorted(r.overall_rank for r in election.seat_ranking.where("won").collect()) == list(range(1, 16))
    elected = election.person_order.where("elected").collect()
    assert len(elected) == 15
    assert sorted(r.overall_rank for r in elected if r.party != "Ø") == sorted(
        r.overall_rank for r in election.seat_ranking.where("won AND party <> 'Ø'").collect()
    )


def test_persons_of_a_party_without_votes_and_of_unknown_list_type_stay(spark):
    votes = spark.createDataFrame([(1, "A", 100, None)], "election_id INT, party STRING, votes BIGINT, alliance STRING")
    persons = spark.createDataFrame(
        [(1, "A", "a1", 1, 9, None), (1, "A", "a2", 2, 5, None), (1, "B", "b1", 1, 7, False)],
        "election_id INT, party STRING, candidate STRING, list_pos INT, personal_votes BIGINT, ordered_list BOOLEAN",
    )
    ranking = EuropeanElection(votes, 1, persons).ranking
    assert {r.candidate: bool(r.elected) for r in ranking.collect()} == {"a1": True, "a2": False, "b1": False}


def test_votes_of_a_constituency_without_seats_count(spark):
    votes = spark.createDataFrame(
        [(1, "r", "c1", "A", 1000), (1, "r", "c1", "B", 50), (1, "r", "c2", "B", 500), (1, "r", "c2", "A", 10)],
        "election_id INT, region_id STRING, constituency_id STRING, party STRING, votes LONG",
    )
    seats = spark.createDataFrame([("c1", "r", 3)], "constituency_id STRING, region_id STRING, seats INT")
    pool = spark.createDataFrame([("r", 2)], "region_id STRING, pool INT")
    election = NationalElection(votes, seats, pool, 5, 2, share=30.0)
    rules = {r.party: r for r in election.rules.collect()}
    assert {p: r.votes for p, r in rules.items()} == {"A": 1010, "B": 550}
    assert rules["B"].share_pct == pytest.approx(550 / 1560 * 100) and rules["B"].qualified
    won = {(r.constituency_id, r.party): r.won for r in election.won.collect()}
    assert won == {("c1", "A"): 3, ("c1", "B"): 0, ("c2", "A"): 0, ("c2", "B"): 0}
    assert election.regional_votes.agg({"votes": "sum"}).first()[0] == 1560
    assert election.awards.count() == 2


def test_seat_labels_from_votes_to_the_elected(spark):
    """Votes to compensatory seats to labels, with list types by region and a party below all thresholds."""
    votes = spark.createDataFrame(
        [(1, "r", "c1", "A", 900), (1, "r", "c1", "B", 500), (1, "r", "c2", "A", 300), (1, "r", "c2", "B", 400), (1, "r", "c2", "C", 3)],
        "election_id INT, region_id STRING, constituency_id STRING, party STRING, votes LONG",
    )
    seats = spark.createDataFrame([("c1", "r", 1), ("c2", "r", 1)], "constituency_id STRING, region_id STRING, seats INT")
    pool = spark.createDataFrame([("r", 2)], "region_id STRING, pool INT")
    election = NationalElection(votes, seats, pool, 4, 2)
    persons = spark.createDataFrame(
        [(1, c, p, f"{p}{i}", i, 100 * i) for c in ("c1", "c2") for p in "ABC" for i in (1, 2, 3)],
        "election_id INT, constituency_id STRING, party STRING, candidate STRING, list_pos INT, total_votes LONG",
    )
    types = spark.createDataFrame([(1, "r", "A", True)], "election_id INT, region_id STRING, party STRING, ordered_list BOOLEAN")
    lists = {(r.constituency_id, r.party): (r.won, r.levelling, r.seats, r.ordered_list) for r in election.lists(persons, types).collect()}
    assert lists["c1", "C"] == lists["c2", "C"] == (0, 0, 0, False)
    assert sum(x[0] for x in lists.values()) == 2 and sum(x[1] for x in lists.values()) == 2
    assert lists["c1", "A"][3] and not lists["c1", "B"][3]
    elected = {r.party: [tuple(x) for x in r.elected] for r in election.elected(persons, types).collect()}
    assert sum(map(len, elected.values())) == 4 and set(elected) == {"A", "B"}
    labels = [label for party in elected.values() for *_, label in party]
    assert sorted(x[-1] for x in labels) == ["K", "K", "T", "T"]
    # B's open list goes by votes, A's by the list
    assert all(name == "B3" for area, name, *_ in elected["B"] if len([x for x in elected["B"] if x[0] == area]) == 1)
