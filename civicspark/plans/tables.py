"""Input tables and the views that read them as elections, calendars and gazetteers.

Mapping: election = order year, region = ``region``, constituency = ``nation``, party =
``p_brand``, candidate = ``p_type``, votes = summed quantity (whole numbers, so sums are
exact), matches = ``events``, cities and municipalities = ``customer``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.session import materialize

#: Seats used by the queries.
NATIONAL_SEATS = 175
CONSTITUENCY_SEATS = 135
LEVELLED_TOTAL = 260
#: Seats of the two-stage elections with alliances.
EP_SEATS = 60

#: Declared columns, so that reading a table does not open its files first.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
}

#: How many votes a counted one stands for, so that parties fall on both sides of the thresholds.
SKEW = """CASE WHEN party_no <= 3 THEN 40 WHEN party_no <= 8 THEN 12 WHEN party_no <= 14 THEN 4
     WHEN party_no <= 18 AND constituency_id = party_no THEN 60 ELSE 1 END"""

FIXTURES = {
    "fx_ballots": """
SELECT CAST(year(o_orderdate) AS INT) AS election_id, n_regionkey AS region_id,
       n_nationkey AS constituency_id, p_brand AS party, p_type AS candidate,
       l_linestatus, l_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "fx_party_votes": """
SELECT election_id, region_id, constituency_id, party, CAST(sum(l_quantity) AS BIGINT) AS votes
FROM fx_ballots GROUP BY 1, 2, 3, 4""",
    "fx_national_votes": """
SELECT election_id, party, CAST(sum(l_quantity) AS BIGINT) AS votes
FROM fx_ballots GROUP BY 1, 2""",
    "fx_party": """
SELECT DISTINCT p_brand AS party, CAST(substr(p_brand, 7) AS INT) AS party_no,
       CASE WHEN CAST(substr(p_brand, 7) AS INT) % 5 = 0 THEN NULL
            ELSE concat('L', CAST(CAST(substr(p_brand, 7) AS INT) % 4 AS VARCHAR)) END AS alliance,
       CAST(substr(p_brand, 7) AS INT) % 3 = 0 AS ordered_list
FROM part""",
    "fx_skewed_votes": f"""
SELECT election_id, region_id, constituency_id, v.party, CAST(votes * {SKEW} AS BIGINT) AS votes
FROM fx_party_votes v JOIN fx_party p ON v.party = p.party""",
    "fx_seats": """
SELECT n_nationkey AS constituency_id, n_regionkey AS region_id,
       CAST(5 + n_nationkey % 7 AS INT) AS seats FROM nation""",
    "fx_region_pool": """
SELECT r_regionkey AS region_id,
       CAST(CASE WHEN r_regionkey = 0 THEN 14 ELSE 13 END AS INT) AS pool FROM region""",
    "fx_candidates": """
SELECT election_id, constituency_id, party, candidate,
       CASE candidate WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                      WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS list_pos,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS personal_votes,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_quantity END) AS BIGINT) AS list_votes
FROM fx_ballots GROUP BY 1, 2, 3, 4, 5""",
    "fx_national_candidates": """
SELECT c.election_id, c.party, p.ordered_list, candidate, list_pos,
       CAST(sum(personal_votes) AS BIGINT) AS personal_votes,
       CAST(sum(list_votes) AS BIGINT) AS list_votes
FROM fx_candidates c JOIN fx_party p ON c.party = p.party GROUP BY 1, 2, 3, 4, 5""",
    "fx_skewed_candidates": f"""
SELECT election_id, constituency_id, c.party, candidate, list_pos,
       CAST(personal_votes * {SKEW} AS BIGINT) AS personal_votes, CAST(list_votes * {SKEW} AS BIGINT) AS list_votes
FROM fx_candidates c JOIN fx_party p ON c.party = p.party""",
    "fx_weights": """
SELECT CAST(year(o_orderdate) AS INT) AS election_id, n_nationkey AS constituency_id,
       n_regionkey AS region_id, CAST(count(DISTINCT c_custkey) * 1000 AS BIGINT) AS population,
       CAST(count(o_orderkey) * 70 AS BIGINT) AS voters,
       CAST(100 + n_nationkey * 37 AS BIGINT) AS area_km2,
       CAST(count(DISTINCT c_custkey) * 1000 + count(o_orderkey) * 70
            + 20 * (100 + n_nationkey * 37) AS BIGINT) AS weight
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY CAST(year(o_orderdate) AS INT), n_nationkey, n_regionkey""",
    "fx_matches": """
SELECT event_id AS match_id, ts AS kickoff, event_type AS league,
       concat('T', CAST(user_id AS VARCHAR)) AS home,
       concat('T', CAST((user_id * 7 + 3) % 150 AS VARCHAR)) AS away,
       CASE WHEN event_id % 17 = 0 THEN NULL
            ELSE concat('City', CAST(user_id % 40 AS VARCHAR)) END AS city,
       concat('Stadium', CAST(user_id % 60 AS VARCHAR)) AS stadium,
       concat('Regular Season - ', replace(replace(props, '{"k": ', ''), '}', '')) AS round_text,
       replace(replace(props, '{"k": ', ''), '}', '') AS round_no,
       CASE WHEN event_id % 11 = 0 THEN 'TBD' ELSE 'NS' END AS status
FROM events""",
    "fx_cities": """
SELECT c_custkey AS city_id,
       concat('City', CAST(CASE c_custkey % 45 WHEN 7 THEN 45 ELSE c_custkey % 45 END AS VARCHAR)) AS name,
       CAST(round(c_acctbal * 100) AS BIGINT) AS population,
       CAST(c_custkey % 90 AS DOUBLE) / 10 + 8 AS lon,
       CAST(c_custkey % 70 AS DOUBLE) / 10 + 50 AS lat
FROM customer""",
    # one place per name: the largest, the lowest id among equals
    "fx_gazetteer": """
SELECT name, lon, lat, population FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY population DESC, city_id) AS rn
  FROM fx_cities) WHERE rn = 1""",
    "fx_seasons": """
SELECT DISTINCT n_regionkey AS comp_id, CAST(year(o_orderdate) AS INT) AS season_id,
       make_date(CAST(year(o_orderdate) AS INT), 6, 30) AS end_date
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
}


def by_number(number: Column, bands: list[tuple[int, int]], default: int) -> Column:
    """First band whose upper bound holds the number."""
    out = None
    for upper, value in bands:
        out = F.when(number <= upper, value) if out is None else out.when(number <= upper, value)
    return out.otherwise(default)


class Tables:
    """Lazily read tables of one data directory and the views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._counted: DataFrame | None = None

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def counted(self, candidates: bool = False) -> Tables:
        """The same tables with the ballots counted once and written.

        For queries that read the votes several times: the raw rows are passed once, and
        later steps see one row per election, area and party (and candidate and line
        status), however many ballots there are.
        """
        if self._counted is not None and (not candidates or "candidate" in self._counted.columns):
            return self
        detail = ["candidate", "l_linestatus"] if candidates else []
        by = ["election_id", "region_id", "constituency_id", "party", *detail]
        twin = Tables(self.spark, self.sf_dir)
        sums = twin.ballots().groupBy(*by).agg(F.sum("l_quantity").alias("l_quantity"))
        twin._counted = materialize(sums)
        return twin

    def ballots(self) -> DataFrame:
        """Every counted line with its election, area, party and candidate."""
        if self._counted is not None:
            return self._counted
        # orders find their area before they meet the lines, so the lines are shuffled for
        # two joins only, each time with few columns
        held = (
            self("orders")
            .join(self("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                "o_orderkey",
                F.year("o_orderdate").alias("election_id"),
                F.col("n_regionkey").alias("region_id"),
                F.col("n_nationkey").alias("constituency_id"),
            )
        )
        lines = (
            self("lineitem")
            .join(self("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                "l_orderkey",
                F.col("p_brand").alias("party"),
                F.col("p_type").alias("candidate"),
                "l_linestatus",
                "l_quantity",
            )
        )
        return lines.join(held, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "election_id",
            "region_id",
            "constituency_id",
            "party",
            "candidate",
            "l_linestatus",
            "l_quantity",
        )

    def party_votes(self, *by: str) -> DataFrame:
        """Votes per election, area and party, or per the given columns."""
        by = by or ("election_id", "region_id", "constituency_id", "party")
        return self.ballots().groupBy(*by).agg(F.sum("l_quantity").cast("bigint").alias("votes"))

    def national_votes(self) -> DataFrame:
        return self.party_votes("election_id", "party")

    def parties(self) -> DataFrame:
        """Distinct parties with number, alliance (NULL for some) and list type."""
        number = F.substr(F.col("p_brand"), F.lit(7)).cast("int")
        party = self("part").select(F.col("p_brand").alias("party"), number.alias("party_no"))
        alliance = F.when(
            F.col("party_no") % 5 != 0, F.concat(F.lit("L"), (F.col("party_no") % 4).cast("string"))
        )
        return (
            party.distinct()
            .withColumn("alliance", alliance)
            .withColumn("ordered_list", F.col("party_no") % 3 == 0)
        )

    def _skewed(self, votes: DataFrame, *columns: str) -> DataFrame:
        number = F.col("party_no")
        local = F.when((number <= 18) & (F.col("constituency_id") == number), 60).otherwise(1)
        factor = F.when(number <= 14, by_number(number, [(3, 40), (8, 12), (14, 4)], 1)).otherwise(
            local
        )
        return (
            votes.join(self.parties().select("party", "party_no"), "party")
            .withColumns({c: (F.col(c) * factor).cast("bigint") for c in columns})
            .select(*votes.columns)
        )

    def skewed_votes(self) -> DataFrame:
        """Party votes scaled so that parties fall on both sides of the thresholds."""
        return self._skewed(self.party_votes(), "votes")

    def skewed_candidates(self) -> DataFrame:
        """Candidates scaled like their parties, whose votes they add up to."""
        return self._skewed(self.candidates(), "personal_votes", "list_votes")

    def seats(self) -> DataFrame:
        return self("nation").select(
            F.col("n_nationkey").alias("constituency_id"),
            F.col("n_regionkey").alias("region_id"),
            (F.col("n_nationkey") % 7 + 5).cast("int").alias("seats"),
        )

    def region_seats(self) -> DataFrame:
        return self.seats().groupBy("region_id").agg(
            F.sum("seats").cast("int").alias("region_seats")
        )

    def region_pool(self) -> DataFrame:
        return self("region").select(
            F.col("r_regionkey").alias("region_id"),
            F.when(F.col("r_regionkey") == 0, 14).otherwise(13).alias("pool"),
        )

    def list_position(self) -> Column:
        """Place on the party list, by candidate name."""
        names = F.array(*[F.lit(n) for n in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")])
        place = F.array_position(names, F.col("candidate")).cast("int")
        return F.when(place > 0, place).otherwise(6)

    def candidates(self, *by: str) -> DataFrame:
        """Personal and list votes per candidate, by constituency or by ``by``."""
        by = by or ("election_id", "constituency_id", "party", "candidate")
        personal = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0)
        listed = F.when(F.col("l_linestatus") == "F", 0).otherwise(F.col("l_quantity"))
        return (
            self.ballots()
            .groupBy(*by)
            .agg(
                F.sum(personal).cast("bigint").alias("personal_votes"),
                F.sum(listed).cast("bigint").alias("list_votes"),
            )
            .withColumn("list_pos", self.list_position())
        )

    def national_candidates(self) -> DataFrame:
        return self.candidates("election_id", "party", "candidate").join(
            self.parties().select("party", "ordered_list"), "party"
        )

    def weights(self) -> DataFrame:
        """Population, voters and area per election and constituency."""
        return (
            self("orders")
            .join(self("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(
                F.year("o_orderdate").alias("election_id"),
                F.col("c_nationkey").alias("constituency_id"),
            )
            .agg(
                (F.countDistinct("c_custkey") * 1000).alias("population"),
                (F.count("o_orderkey") * 70).alias("voters"),
            )
            .join(self("nation"), F.col("constituency_id") == F.col("n_nationkey"))
            .select(
                "election_id",
                "constituency_id",
                F.col("n_regionkey").alias("region_id"),
                "population",
                "voters",
                (F.col("n_nationkey") * 37 + 100).cast("bigint").alias("area_km2"),
            )
        )

    def matches(self) -> DataFrame:
        """Match records with the kick-off in UTC."""
        round_no = F.replace(F.replace("props", F.lit('{"k": '), F.lit("")), F.lit("}"), F.lit(""))
        event, user = F.col("event_id"), F.col("user_id")
        return self("events").select(
            event.alias("match_id"),
            F.col("ts").alias("kickoff"),
            F.col("event_type").alias("league"),
            F.concat(F.lit("T"), user.cast("string")).alias("home"),
            F.concat(F.lit("T"), ((user * 7 + 3) % 150).cast("string")).alias("away"),
            F.when(event % 17 != 0, F.concat(F.lit("City"), (user % 40).cast("string"))).alias(
                "city"
            ),
            F.concat(F.lit("Stadium"), (user % 60).cast("string")).alias("stadium"),
            F.concat(F.lit("Regular Season - "), round_no).alias("round_text"),
            round_no.alias("round_no"),
            F.when(event % 11 == 0, "TBD").otherwise("NS").alias("status"),
        )

    def cities(self) -> DataFrame:
        """Gazetteer rows, several per name; City7 has none."""
        key = F.col("c_custkey")
        number = F.when(key % 45 == 7, 45).otherwise(key % 45)
        return (
            self("customer")
            .select(
                key.alias("city_id"),
                F.concat(F.lit("City"), number.cast("string")).alias("name"),
                F.round(F.col("c_acctbal") * 100).cast("bigint").alias("population"),
                ((key % 90).cast("double") / 10 + 8).alias("lon"),
                ((key % 70).cast("double") / 10 + 50).alias("lat"),
            )
        )

    def gazetteer(self) -> DataFrame:
        """One place per name: the largest, the lowest id among equals."""
        best = F.min(F.struct((-F.col("population")).alias("p"), "city_id", "lon", "lat"))
        return (
            self.cities()
            .groupBy("name")
            .agg(best.alias("b"))
            .select("name", "b.lon", "b.lat", (-F.col("b.p")).alias("population"))
        )

    def seasons(self) -> DataFrame:
        """Competitions (regions) with one season per order year, ending in June."""
        return (
            self("orders")
            .join(self("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select("c_nationkey", F.year("o_orderdate").alias("season_id"))
            .distinct()
            .join(self("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("n_regionkey").alias("comp_id"),
                "season_id",
                F.make_date(F.col("season_id"), F.lit(6), F.lit(30)).alias("end_date"),
            )
            .distinct()
        )
