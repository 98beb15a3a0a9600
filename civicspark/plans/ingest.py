"""Source and sink queries.

Each query writes the given tables in the landed format to a fresh shared folder, reads
them back with the library's reader and returns the rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.plans.geography import BOXES, boundaries
from civicspark.plans.registry import query
from civicspark.session import shared_dir
from civicspark.sources import catalogue, counts, headers, matches, sinks, statistics
from civicspark.sources import fixed_values as fixed
from civicspark.sources.fixed_values import INDEPENDENT, NOT_READY

DONE = "Optællingen er afsluttet."
LOADED_AT = dt.datetime(2024, 2, 1, 12, 0, 0)

# ---- count documents ------------------------------------------------------------------

# Every tenth document is not ready; every seventh party is an independent.
READY = "(election_id + constituency_id) % 10 <> 0"


def letter(party_no):
    return F.char(party_no + 64)


def status(election, area):
    return F.when((election + area) % 10 == 0, NOT_READY).otherwise(DONE)


def with_head(t, documents):
    """Add the parts every count document has."""
    names = t("nation").select(F.col("n_nationkey").alias("constituency_id"), "n_name")
    place = F.struct(
        F.col("constituency_id").cast("string").alias("_Id"), F.col("n_name").alias("_VALUE")
    )
    state = F.struct(
        F.lit("1").alias("_Kode"),
        status(F.col("election_id"), F.col("constituency_id")).alias("_VALUE"),
    )
    return documents.join(names, "constituency_id").withColumns(
        {"_udgave": F.lit(1), "Status": state, "Sted": place}
    )


def party_documents(t):
    """One document per election and constituency with its parties."""
    votes = t.party_votes("election_id", "constituency_id", "party").join(
        t.parties().select("party", "party_no"), "party"
    )
    node = F.struct(
        F.col("party_no").cast("string").alias("_Id"),
        letter(F.col("party_no")).alias("_Bogstav"),
        F.col("party").alias("_Navn"),
        F.col("votes").alias("_StemmerAntal"),
    )
    parties = votes.groupBy("election_id", "constituency_id").agg(
        F.struct(F.sort_array(F.collect_list(node)).alias("Parti")).alias("Stemmer"),
        (F.sum("votes") * 2).alias("Stemmeberettigede"),
    )
    return with_head(t, parties).select(
        "election_id", "_udgave", "Status", "Sted", "Stemmer", "Stemmeberettigede"
    )


def person_documents(t):
    """One document per election and constituency with its parties' persons."""
    votes = t.candidates().join(t.parties().select("party", "party_no"), "party")
    numbers = [
        F.sum("personal_votes").alias("_PersonligeStemmer"),
        F.sum("list_votes").alias("_TildeltePartiStemmer"),
        F.sum(F.col("personal_votes") + F.col("list_votes")).alias("_StemmerIAlt"),
    ]
    person = F.struct(
        F.col("candidate").alias("_Navn"),
        F.col("personal_votes").alias("_PersonligeStemmer"),
        F.col("list_votes").alias("_TildeltePartiStemmer"),
        (F.col("personal_votes") + F.col("list_votes")).alias("_StemmerIAlt"),
    )
    alone = F.col("party_no") % 7 == 0
    by_party = votes.groupBy("election_id", "constituency_id", "party", "party_no").agg(
        *numbers, F.sort_array(F.collect_list(person)).alias("persons")
    )
    node = F.struct(
        letter(F.col("party_no")).alias("_Bogstav"),
        F.col("party").alias("_navn"),
        "_PersonligeStemmer",
        "_TildeltePartiStemmer",
        "_StemmerIAlt",
        F.when(~alone, F.col("persons")).alias("Person"),
    )
    parties = by_party.groupBy("election_id", "constituency_id").agg(
        F.struct(F.collect_list(node).alias("Parti")).alias("Personer")
    )
    return with_head(t, parties).select("election_id", "_udgave", "Status", "Sted", "Personer")


def landed(t, documents):
    path = shared_dir(t.spark)
    counts.write_documents(documents, path)
    return path


def manifest_documents(t):
    """One manifest per region with five levels of areas below it."""
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    district = F.concat_ws("-", "n_nationkey", "c_mktsegment")
    base = customers.select(
        F.col("n_regionkey").cast("string").alias("landsdel_id"),
        F.col("n_nationkey").cast("string").alias("storkreds_id"),
        district.alias("opstillingskreds_id"),
        F.concat_ws("-", district, F.col("c_custkey") % 4).alias("afstemningsomraade_id"),
    )

    def level(container, element, area, parent):
        node = F.struct(
            F.col(area).alias(f"_{area}"),
            F.col(parent).alias(f"_{parent}"),
            F.concat(F.lit(element), F.lit("_"), F.col(area), F.lit(".xml")).alias("_filnavn"),
            F.concat(F.lit(f"{element} "), F.col(area)).alias("_VALUE"),
        )
        nodes = F.sort_array(F.collect_set(node))
        rows = base.withColumn("land_id", F.lit("1")).groupBy("landsdel_id")
        return rows.agg(F.struct(nodes.alias(element)).alias(container))

    regions = base.select("landsdel_id").distinct().select(
        "landsdel_id",
        F.array(
            F.struct(F.lit("1").alias("_land_id"), F.lit("land.xml").alias("_filnavn"),
                     F.lit("Land").alias("_VALUE"))
        ).alias("Land"),
    )
    for spec in (
        ("Landsdele", "Landsdel", "landsdel_id", "land_id"),
        ("Storkredse", "Storkreds", "storkreds_id", "landsdel_id"),
        ("Opstillingskredse", "Opstillingskreds", "opstillingskreds_id", "storkreds_id"),
        ("Afstemningsomraader", "Afstemningsomraade", "afstemningsomraade_id", "opstillingskreds_id"),
    ):
        regions = regions.join(level(*spec), "landsdel_id")
    return regions.withColumn("election_id", F.lit(2022)).withColumn(
        "ValgDato", F.lit("1-11-2022")
    ).drop("landsdel_id")


@query("src_manifest", """
WITH b AS (SELECT n_regionkey::VARCHAR AS r, n_nationkey::VARCHAR AS s, n_nationkey || '-' || c_mktsegment AS o,
                  n_nationkey || '-' || c_mktsegment || '-' || (c_custkey % 4) AS a
           FROM customer JOIN nation ON c_nationkey = n_nationkey),
areas AS (SELECT DISTINCT 'Storkreds' AS e, s AS area_id, r AS parent_id FROM b
          UNION ALL SELECT DISTINCT 'Landsdel', r, '1' FROM b
          UNION ALL SELECT DISTINCT 'Opstillingskreds', o, s FROM b
          UNION ALL SELECT DISTINCT 'Afstemningsomraade', a, o FROM b)
SELECT 2022 AS election_id, area_id, parent_id, e || ' ' || area_id AS name, e || '_' || area_id || '.xml' AS file
FROM areas
UNION ALL SELECT 2022, '1', NULL, 'Land', 'land.xml' FROM (SELECT DISTINCT r FROM b)""")
def src_manifest(t):
    path = landed(t, manifest_documents(t))
    return counts.read_manifest(t.spark, path, list(fixed.LEVELS))


PARTY_ROWS = f"""
SELECT election_id, constituency_id::VARCHAR AS area_id, n_name AS area, party_no::VARCHAR AS party_id,
       chr(64 + party_no) AS letter, v.party, votes
FROM fx_party_votes v JOIN fx_party p ON v.party = p.party JOIN nation ON n_nationkey = constituency_id
WHERE {READY}"""


@query("src_party_votes", PARTY_ROWS)
def src_party_votes(t):
    return counts.read_party_votes(t.spark, landed(t, party_documents(t)))


@query("src_ready_only", f"""
SELECT DISTINCT election_id, constituency_id::VARCHAR AS area_id FROM fx_party_votes WHERE {READY}""")
def src_ready_only(t):
    documents = counts.read_documents(
        t.spark, landed(t, party_documents(t)), counts.PARTY_DOCUMENT
    )
    return counts.ready_only(documents).select("election_id", F.col("Sted._Id").alias("area_id"))


CANDIDATE_ROWS = f"""
cand AS (SELECT election_id, constituency_id::VARCHAR AS area_id, chr(64 + party_no) AS letter, c.party,
                candidate, personal_votes, list_votes AS allotted_votes,
                personal_votes + list_votes AS total_votes,
                sum(list_votes) OVER (PARTITION BY election_id, constituency_id, c.party)::BIGINT AS party_allotted_votes,
                false AS independent
         FROM fx_candidates c JOIN fx_party p ON c.party = p.party WHERE {READY} AND party_no % 7 <> 0
         UNION ALL
         SELECT election_id, constituency_id::VARCHAR, NULL, '{INDEPENDENT}', c.party,
                sum(personal_votes)::BIGINT, sum(list_votes)::BIGINT, sum(personal_votes + list_votes)::BIGINT,
                NULL, true
         FROM fx_candidates c JOIN fx_party p ON c.party = p.party WHERE {READY} AND party_no % 7 = 0
         GROUP BY election_id, constituency_id, c.party)
"""


def candidate_rows(t):
    return counts.read_candidate_votes(t.spark, landed(t, person_documents(t)))


@query("src_candidate_votes", f"WITH {CANDIDATE_ROWS} SELECT * FROM cand")
def src_candidate_votes(t):
    return candidate_rows(t)


@query("src_independents", f"""
WITH {CANDIDATE_ROWS}
SELECT election_id, area_id, letter, party, candidate, total_votes FROM cand WHERE independent""")
def src_independents(t):
    return candidate_rows(t).where("independent").select(
        "election_id", "area_id", "letter", "party", "candidate", "total_votes"
    )


@query("src_electorate", """
SELECT election_id, constituency_id::VARCHAR AS area_id, (sum(votes) * 2)::BIGINT AS voters
FROM fx_party_votes GROUP BY 1, 2""")
def src_electorate(t):
    return counts.read_electorate(t.spark, landed(t, party_documents(t)))


# ---- headers and catalogue ----------------------------------------------------------------


@query("src_coalesce", """
SELECT l_orderkey AS order_id, l_linenumber AS line, l_quantity::BIGINT AS votes FROM lineitem""")
def src_coalesce(t):
    quantity, line = F.col("l_quantity").cast("bigint"), F.col("l_linenumber")
    spelled = t("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        line.alias("line"),
        F.when(line % 3 == 0, quantity).alias("StemmerIAlt"),
        F.when(line % 3 == 1, quantity).alias("PersonStemmerIAlt"),
        F.when(line % 3 == 2, quantity).alias("StemmerIAltParti"),
    )
    return headers.coalesce_spellings(
        spelled, {"votes": ["StemmerIAlt", "PersonStemmerIAlt", "StemmerIAltParti", "Stemmer"]}
    )


@query("src_headers", """
SELECT c_custkey AS id_parti, c_name AS navn, c_nationkey AS personlige_stemmer, c_mktsegment AS place
FROM customer""")
def src_headers(t):
    raw = t("customer").select(
        F.col("c_custkey").alias("@IdParti"),
        F.col("c_name").alias("Navn"),
        F.col("c_nationkey").alias("PersonligeStemmer"),
        F.col("c_mktsegment").alias("#text"),
        F.col("c_acctbal").alias("Person"),
    )
    return headers.clean_headers(raw, rename={"text": "place"}, drop=["person", "person_navn"])


CODES = "CASE year WHEN 1992 THEN 'Valg92' WHEN 1994 THEN 'Valg94' END"


@query("src_catalogue", f"""
WITH e AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders),
c AS (SELECT year, 'EP' AS type, kind,
             CASE year WHEN 1992 THEN 13 WHEN 1994 THEN 14 END AS seats,
             CASE year WHEN 1994 THEN 'OØÅ' END AS letters, {CODES} AS code,
             CASE kind WHEN 'valgaften' THEN 'xml/valgdag.xml' ELSE 'xml/fintal.xml' END AS file
      FROM e, (VALUES ('valgaften'), ('fintælling')) k(kind))
SELECT year, type, kind, seats, letters, 'landing/' || code || '/' || file AS link FROM c""")
def src_catalogue(t):
    elections = t("orders").select(F.year("o_orderdate").alias("year")).distinct().withColumn(
        "type", F.lit("EP")
    )
    return catalogue.expand_catalogue(
        elections,
        {("EP", 1992): "Valg92", ("EP", 1994): "Valg94"},
        {1992: 13, 1994: 14},
        {1994: "OØÅ"},
        "landing/",
    )


@query("src_count_phase", """
WITH e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS held_on FROM orders)
SELECT held_on, CASE WHEN held_on < DATE '1995-06-01' THEN 'fintælling' ELSE 'valgaften' END AS kind FROM e""")
def src_count_phase(t):
    held = t("orders").select(F.date_format("o_orderdate", "d-M-yyyy").alias("date")).distinct()
    kinds = F.array(F.lit("valgaften"), F.lit("fintælling"))
    rows = held.withColumn("kind", F.explode(kinds))
    return catalogue.pick_phase(rows, "date", F.lit(dt.date(1995, 6, 1))).select("held_on", "kind")


# ---- match records ----------------------------------------------------------------------------


def match_records(t):
    """Matches as nested records."""
    return t.matches().select(
        F.struct(
            F.lit(78).cast("bigint").alias("id"),
            F.col("league").alias("name"),
            F.lit("Germany").alias("country"),
            F.lit(2023).alias("season"),
            F.col("round_text").alias("round"),
        ).alias("league"),
        F.struct(
            F.col("match_id").alias("id"),
            F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date"),
            F.lit("UTC").alias("timezone"),
            F.struct(F.lit("Match").alias("long"), F.col("status").alias("short")).alias("status"),
            F.struct(
                F.lit(None).cast("bigint").alias("id"),
                F.col("stadium").alias("name"),
                F.col("city").alias("city"),
            ).alias("venue"),
        ).alias("fixture"),
        F.struct(
            F.struct(F.col("home").alias("name")).alias("home"),
            F.struct(F.col("away").alias("name")).alias("away"),
        ).alias("teams"),
    )


@query("src_json_flatten", """
SELECT match_id, round_no AS round, 'Regular Season' AS stage, '2023/2024' AS season, league, status, home, away,
       stadium, city, strftime(kickoff, '%Y-%m-%d %H:%M:%S') AS kickoff
FROM fx_matches""")
def src_json_flatten(t):
    path = shared_dir(t.spark)
    match_records(t).write.json(path)
    flat = matches.flatten_matches(matches.read_matches(t.spark, path))
    return flat.select(
        "match_id", "round", "stage", "season", "league", "status", "home", "away", "stadium", "city",
        F.date_format(
            F.to_utc_timestamp("kickoff", F.current_timezone()), "yyyy-MM-dd HH:mm:ss"
        ).alias("kickoff"),
    )


@query("src_schedule", """
SELECT 'sr:match:' || match_id AS match_id, league, home, away, home || ' - ' || away AS title, city,
       (match_id % 90)::DOUBLE / 4 AS lat, (match_id % 180)::DOUBLE / 8 AS lon
FROM fx_matches""")
def src_schedule(t):
    match_id = F.col("match_id")
    sides = [
        F.struct(F.col(side).alias("name"), F.lit(side).alias("qualifier"))
        for side in ("home", "away")
    ]
    point = F.format_string("%s,%s", (match_id % 90) / 4, (match_id % 180) / 8)
    event = F.struct(
        F.concat(F.lit("sr:match:"), match_id.cast("string")).alias("id"),
        F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("start_time"),
        F.struct(F.struct(F.col("league").alias("name")).alias("competition")).alias(
            "sport_event_context"
        ),
        F.when(match_id % 2 == 0, F.array(*sides)).otherwise(F.array(*sides[::-1])).alias(
            "competitors"
        ),
        F.struct(F.col("city").alias("city_name"), point.alias("map_coordinates")).alias("venue"),
    )
    path = shared_dir(t.spark)
    t.matches().select(event.alias("sport_event")).write.json(path)
    return matches.read_schedules(t.spark, path).select(
        "match_id", "league", "home", "away", "title", "city", "lat", "lon"
    )


@query("src_union_leagues", """
SELECT match_id, league, CASE WHEN league = 'click' THEN NULL ELSE city END AS city FROM fx_matches""")
def src_union_leagues(t):
    flat = t.matches().select("match_id", "league", "city")
    path = shared_dir(t.spark)
    flat.where("league <> 'click'").write.parquet(f"{path}/main")
    flat.where("league = 'click'").drop("city").write.parquet(f"{path}/other")
    return matches.union_loads(
        [t.spark.read.parquet(f"{path}/main"), t.spark.read.parquet(f"{path}/other")]
    )


@query("src_point_parse", """
SELECT c_custkey AS id, (c_custkey % 180)::DOUBLE / 8 AS lon, (c_custkey % 90)::DOUBLE / 4 AS lat FROM customer""")
def src_point_parse(t):
    key = F.col("c_custkey")
    lon, lat = (key % 180) / 8, (key % 90) / 4
    # the two spellings: c(lon, lat) and lat,lon
    vector = key % 2 == 0
    text = F.when(vector, F.format_string("c(%s, %s)", lon, lat)).otherwise(
        F.format_string("%s,%s", lat, lon)
    )
    points = t("customer").select(key.alias("id"), vector.alias("vector"), text.alias("point"))
    first, second = tx.point_part(F.col("point"), 1), tx.point_part(F.col("point"), 2)
    return points.select(
        "id",
        F.when(F.col("vector"), first).otherwise(second).alias("lon"),
        F.when(F.col("vector"), second).otherwise(first).alias("lat"),
    )


# ---- statistics ---------------------------------------------------------------------------------


@query("src_latest_period", """
SELECT 'T' || n_regionkey AS id, max(strftime(o_orderdate, '%YM%m')) AS period
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def src_latest_period(t):
    monthly = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("id"),
            F.date_format("o_orderdate", "yyyy'M'MM").alias("period"),
        )
        .distinct()
    )
    value = F.struct(F.col("period").alias("id"), F.col("period").alias("text"))
    tables = monthly.groupBy("id").agg(F.sort_array(F.collect_list(value)).alias("periods"))
    area = F.array(F.struct(F.lit("000").alias("id"), F.lit("zzz").alias("text")))

    def variable(name, is_time, values):
        return F.struct(
            F.lit(name).alias("id"), F.lit(name).alias("text"), F.lit(is_time).alias("time"),
            values.alias("values"),
        )

    path = shared_dir(t.spark)
    tables.select(
        "id",
        F.array(
            variable("OMRÅDE", False, area), variable("Tid", True, F.col("periods"))
        ).alias("variables"),
    ).write.json(path)
    return statistics.latest_period(statistics.read_table_info(t.spark, path))


@query("src_decimal_comma", """
SELECT o_orderkey AS order_id, round(o_totalprice, 2) AS amount FROM orders""")
def src_decimal_comma(t):
    path = shared_dir(t.spark)
    (
        t("orders")
        .select(
            F.col("o_orderkey").alias("order_id"),
            tx.danish_number(F.col("o_totalprice"), 2).alias("amount"),
        )
        .write.option("sep", ";").option("header", "true").csv(path)
    )
    rows = statistics.read_decimal_comma(t.spark, path, "order_id BIGINT, amount DECIMAL(18,2)")
    return rows.withColumn("amount", F.col("amount").cast("double"))


@query("src_geojson", f"""
WITH {BOXES},
outer_ring AS (SELECT area_id, 0 AS polygon, 0 AS ring, i, x + CASE WHEN i IN (1, 2) THEN w ELSE 0 END AS lon,
                      y + CASE WHEN i IN (2, 3) THEN h ELSE 0 END AS lat
               FROM box, (VALUES (0), (1), (2), (3), (4)) p(i)),
hole_ring AS (SELECT area_id, 0 AS polygon, 1 AS ring, 4 - i AS i, x + 0.25 + CASE WHEN i IN (1, 2) THEN 0.5 ELSE 0 END AS lon,
                     y + 0.25 + CASE WHEN i IN (2, 3) THEN 0.5 ELSE 0 END AS lat
              FROM box, (VALUES (0), (1), (2), (3), (4)) p(i) WHERE hole),
island_ring AS (SELECT area_id, 1 AS polygon, 0 AS ring, i, x + CASE WHEN i IN (1, 2) THEN 1 ELSE 0 END AS lon,
                       y + 4 + CASE WHEN i IN (2, 3) THEN 1 ELSE 0 END AS lat
                FROM box, (VALUES (0), (1), (2), (3), (4)) p(i) WHERE island)
SELECT * FROM outer_ring UNION ALL SELECT * FROM hole_ring UNION ALL SELECT * FROM island_ring""")
def src_geojson(t):
    def collections(areas, kind, coordinates):
        feature = F.struct(
            F.lit("Feature").alias("type"),
            F.create_map(F.lit("id"), F.col("area_id").cast("string")).alias("properties"),
            F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        )
        return areas.select(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))

    path = shared_dir(t.spark)
    # one collection per line, so a large set of areas is never one document
    areas, several = boundaries(t), F.size("polygons") > 1
    collections(areas.where(~several), "Polygon", F.col("polygons")[0]).write.json(path)
    collections(areas.where(several), "MultiPolygon", F.col("polygons")).write.mode("append").json(path)
    features = statistics.read_features(t.spark, path, multi_line=False).withColumn(
        "area_id", F.col("properties")["id"].cast("bigint")
    )
    return statistics.ring_points(features, "area_id")


# ---- sinks ----------------------------------------------------------------------------------------


@query("sink_snapshot", """
SELECT match_id, league, home, away, '2024-02-01 12:00:00' AS loaded_at FROM fx_matches""")
def sink_snapshot(t):
    path = shared_dir(t.spark)
    sinks.write_snapshot(
        t.matches().select("match_id", "league", "home", "away"), path, "league", LOADED_AT
    )
    return t.spark.read.parquet(path).withColumn(
        "loaded_at", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss")
    )


@query("sink_json", """
SELECT election_id, constituency_id, region_id, population, voters, weight FROM fx_weights""")
def sink_json(t):
    path = shared_dir(t.spark)
    table = t.weights().withColumn(
        "weight", F.col("population") + F.col("voters") + 20 * F.col("area_km2")
    ).drop("area_km2")
    sinks.write_json(table, path)
    return t.spark.read.schema(table.schema).json(path)
