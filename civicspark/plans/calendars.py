"""Match calendar and gazetteer queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.operators import calendar as cal
from civicspark.operators import enrich
from civicspark.plans.registry import query
from civicspark.session import shared_dir
from civicspark.sources import matches as match_feeds
from civicspark.sources.fixed_values import POPULATION_TARGET

AS_OF = dt.date(2024, 1, 15)

# ISO week with Monday counted to the week before, and the Friday-to-Monday flag.
WEEK = "CAST(week(kickoff) - CASE WHEN isodow(kickoff) = 1 THEN 1 ELSE 0 END AS INT)"
WEEKEND = "isodow(kickoff) IN (1, 5, 6, 7)"

ROUNDS = f"""
wk AS (SELECT *, CAST(kickoff AS DATE) AS match_day, {WEEK} AS match_week, {WEEKEND} AS weekend
       FROM fx_matches),
rounds AS (SELECT *, (dense_rank() OVER (ORDER BY match_week, weekend))::INT AS derived_round,
                  min(match_day) OVER (PARTITION BY match_week, weekend) AS round_start FROM wk)
"""
LOCAL_TIME = "strftime(timezone({zone}, timezone('UTC', kickoff)), '%H:%M')"
GERMAN_TIME = f"CASE WHEN status = 'TBD' THEN 'TBA' ELSE {LOCAL_TIME.format(zone=repr('Europe/Berlin'))} END"


@query("round_stage", """
SELECT match_id, nullif(regexp_extract(txt, '- (.+)', 1), '') AS round_name,
       nullif(regexp_extract(txt, '(.+) -', 1), '') AS stage
FROM (SELECT match_id, CASE WHEN match_id % 13 = 0 THEN 'Final' ELSE round_text END AS txt FROM fx_matches)""")
def round_stage(t):
    text = F.when(F.col("match_id") % 13 == 0, "Final").otherwise(F.col("round_text"))
    return t.matches().select(
        "match_id", tx.round_name(text).alias("round_name"), tx.stage_name(text).alias("stage")
    )


@query("kickoff_local", f"SELECT match_id, {GERMAN_TIME} AS kickoff_text FROM fx_matches")
def kickoff_local(t):
    return t.matches().select(
        "match_id", cal.kickoff_text(F.col("kickoff"), F.col("status")).alias("kickoff_text")
    )


@query("match_week", f"SELECT match_id, {WEEK} AS match_week FROM fx_matches")
def match_week(t):
    return t.matches().select(
        "match_id", cal.match_week(F.to_date("kickoff")).alias("match_week")
    )


@query("weekend_flag", f"SELECT match_id, {WEEKEND} AS weekend FROM fx_matches")
def weekend_flag(t):
    return t.matches().select("match_id", cal.weekend(F.to_date("kickoff")).alias("weekend"))


def dated(t):
    return t.matches().withColumn("match_day", F.to_date("kickoff"))


@query("derived_round", f"""
WITH {ROUNDS} SELECT match_id, match_week, weekend, derived_round FROM rounds""")
def derived_round(t):
    return cal.derive_rounds(dated(t), "match_day").select(
        "match_id", "match_week", "weekend", "derived_round"
    )


@query("round_start", f"WITH {ROUNDS} SELECT match_id, derived_round, round_start FROM rounds")
def round_start(t):
    return cal.derive_rounds(dated(t), "match_day").select(
        "match_id", "derived_round", "round_start"
    )


@query("derive_calendar", f"""
WITH {ROUNDS}
SELECT match_id, match_day, {GERMAN_TIME} AS kickoff_text, match_week, weekend, derived_round, round_start,
       ['mandag', 'tirsdag', 'onsdag', 'torsdag', 'fredag', 'lørdag', 'søndag'][isodow(kickoff)] AS weekday
FROM rounds""")
def derive_calendar(t):
    return cal.derive_calendar(t.matches()).select(
        "match_id", "match_day", "kickoff_text", "match_week", "weekend", "derived_round",
        "round_start", "weekday",
    )


#: Even rounds kick off at one instant, as rounds without a schedule do.
ONE_INSTANT = dt.datetime(2024, 7, 6, 13, 30)


@query("unscheduled_round", f"""
WITH m AS (SELECT * REPLACE (CASE WHEN CAST(round_no AS INT) % 2 = 0 THEN TIMESTAMP '{ONE_INSTANT}' ELSE kickoff END AS kickoff)
           FROM fx_matches),
k AS (SELECT *, {GERMAN_TIME} AS kt, min(kickoff) OVER g = max(kickoff) OVER g AS one_instant FROM m
      WINDOW g AS (PARTITION BY round_no, league))
SELECT match_id, kickoff_text, kickoff_text <> kt AS changed
FROM (SELECT *, CASE WHEN one_instant AND round_no <> '38' THEN 'TBA' ELSE kt END AS kickoff_text FROM k)""")
def unscheduled_round(t):
    even = F.col("round_no").cast("int") % 2 == 0
    kickoff = F.when(even, F.lit(ONE_INSTANT).cast("timestamp_ntz")).otherwise(F.col("kickoff"))
    timed = t.matches().withColumn("kickoff", kickoff)
    text = cal.kickoff_text(F.col("kickoff"), F.col("status"))
    timed = timed.withColumn("kickoff_text", text).withColumn("before", text)
    return cal.unscheduled_rounds(
        timed, ["round_no", "league"], "kickoff", "kickoff_text", "round_no", "38"
    ).select("match_id", "kickoff_text", (F.col("kickoff_text") != F.col("before")).alias("changed"))


@query("home_away", """
SELECT match_id, home, away, home || ' - ' || away AS title FROM fx_matches""")
def home_away(t):
    first = F.struct(F.col("home").alias("name"), F.lit("home").alias("qualifier"))
    second = F.struct(F.col("away").alias("name"), F.lit("away").alias("qualifier"))
    competitors = F.when(F.col("match_id") % 2 == 0, F.array(first, second)).otherwise(
        F.array(second, first)
    )
    home, away = cal.home_away(F.col("competitors"))
    return (
        t.matches()
        .select("match_id", competitors.alias("competitors"))
        .select("match_id", home.alias("home"), away.alias("away"))
        .withColumn("title", cal.match_title(F.col("home"), F.col("away")))
    )


@query("next_rounds", f"""
WITH {ROUNDS},
f AS (SELECT derived_round, min(match_day) AS first_day FROM rounds GROUP BY 1)
SELECT *, date_diff('day', DATE '{AS_OF}', first_day)::INT AS days_away, first_day < DATE '{AS_OF}' AS past
FROM f ORDER BY past, days_away, derived_round""")
def next_rounds(t):
    return cal.next_rounds(
        cal.derive_rounds(dated(t), "match_day"), "derived_round", "match_day", F.lit(AS_OF)
    )


@query("round_programme", f"""
WITH {ROUNDS},
f AS (SELECT derived_round, min(match_day) AS first_day FROM rounds GROUP BY 1),
p AS (SELECT *, date_diff('day', DATE '{AS_OF}', first_day)::INT AS days_away, first_day < DATE '{AS_OF}' AS past FROM f),
n AS (SELECT *, row_number() OVER (ORDER BY past, days_away, derived_round)::INT AS place FROM p)
SELECT place, derived_round, days_away, past, match_day, match_id, home || ' - ' || away AS title
FROM rounds JOIN n USING (derived_round)""")
def round_programme(t):
    """The matches of each round, the next round first."""
    rounds = cal.derive_rounds(dated(t), "match_day").withColumn("title", cal.match_title(F.col("home"), F.col("away")))
    return cal.round_programme(rounds, "derived_round", "match_day", F.lit(AS_OF), ["match_day", "match_id"]).select(
        "place", "derived_round", "days_away", "past", "match_day", "match_id", "title"
    )


ZONES = ("Europe/Berlin", "America/New_York", "Europe/Lisbon", "Asia/Tokyo")
#: Every other match is half a year later, and every third is told in its venue's local time.
SECOND_FEED = f"""
feed AS (SELECT match_id, home, away, {list(ZONES)}[(match_id % 4)::INT + 1] AS zone,
                CASE WHEN match_id % 2 = 0 THEN kickoff ELSE kickoff + INTERVAL 182 DAY END AS kickoff FROM fx_matches),
dated AS (SELECT *, CAST(kickoff AS DATE) AS match_day, {WEEK} AS match_week, {WEEKEND} AS weekend FROM feed),
numbered AS (SELECT *, (dense_rank() OVER (ORDER BY match_week, weekend))::INT AS derived_round,
                    min(match_day) OVER (PARTITION BY match_week, weekend) AS round_start FROM dated)
"""


@query("second_calendar", f"""
WITH {SECOND_FEED}
SELECT 'sr:match:' || match_id AS match_id, home || ' - ' || away AS title, zone AS timezone, match_day,
       {LOCAL_TIME.format(zone="'Europe/Berlin'")} AS kickoff_text, {LOCAL_TIME.format(zone="zone")} AS venue_text,
       match_week, weekend, derived_round, round_start
FROM numbered""")
def second_calendar(t):
    """The calendar of the second feed, which has a time zone per venue."""
    match_id = F.col("match_id")
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (match_id % 4 + 1).cast("int"))
    start = F.when(match_id % 2 == 0, F.col("kickoff")).otherwise(F.col("kickoff") + F.expr("INTERVAL 182 DAY"))
    form = "yyyy-MM-dd'T'HH:mm:ss"
    told = F.when(
        match_id % 3 == 0, F.date_format(F.convert_timezone(F.lit("UTC"), zone, start), form)
    ).otherwise(F.date_format(start, form + "'+00:00'"))
    sides = F.array(*[F.struct(F.col(s).alias("name"), F.lit(s).alias("qualifier")) for s in ("away", "home")])
    event = F.struct(
        F.concat(F.lit("sr:match:"), match_id.cast("string")).alias("id"), told.alias("start_time"),
        sides.alias("competitors"), F.struct(F.col("city").alias("city_name"), zone.alias("timezone")).alias("venue"),
    )
    path = shared_dir(t.spark)
    t.matches().select(event.alias("sport_event")).write.json(path)
    return cal.derive_calendar(match_feeds.read_schedules(t.spark, path)).select(
        "match_id", "title", "timezone", "match_day", "kickoff_text", "venue_text", "match_week", "weekend",
        "derived_round", "round_start",
    )


def order_days(t):
    """Orders as dated events of a competition (region)."""
    return (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("n_regionkey").alias("comp_id"),
            F.to_date("o_orderdate").alias("day"),
        )
    )


ORDER_DAYS = """
days AS (SELECT o_orderkey AS order_id, n_regionkey AS comp_id, CAST(o_orderdate AS DATE) AS day
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


@query("current_season", f"""
WITH {ORDER_DAYS},
wanted AS (SELECT comp_id, day FROM days GROUP BY 1, 2)
SELECT a.comp_id, a.day, min(s.season_id)::INT AS season_id, min(s.end_date) AS end_date
FROM wanted a LEFT JOIN fx_seasons s ON s.comp_id = a.comp_id AND a.day <= s.end_date GROUP BY 1, 2""")
def current_season(t):
    days = order_days(t).select("comp_id", "day").distinct()
    return enrich.asof_join(days, t.seasons(), ["comp_id"], "day", "end_date")


@query("join_asof", f"""
WITH {ORDER_DAYS}
SELECT d.*, s.season_id, s.end_date
FROM days d ASOF LEFT JOIN fx_seasons s ON d.comp_id = s.comp_id AND d.day <= s.end_date""")
def join_asof(t):
    return enrich.asof_join(order_days(t), t.seasons(), ["comp_id"], "day", "end_date")


@query("season_year", """
SELECT o_orderkey AS order_id,
       CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS INT) AS season_year
FROM orders""")
def season_year(t):
    return t("orders").select(
        F.col("o_orderkey").alias("order_id"),
        cal.season_year(F.col("o_orderdate")).alias("season_year"),
    )


@query("league_filter", """
SELECT match_id, league, 'like' AS kind FROM fx_matches WHERE regexp_matches(league, 'c')
UNION ALL
SELECT match_id, league, 'unlike' FROM fx_matches WHERE NOT regexp_matches(league, 'i')""")
def league_filter(t):
    matches = t.matches().select("match_id", "league")
    like = matches.where(F.col("league").rlike("c")).withColumn("kind", F.lit("like"))
    unlike = matches.where(~F.col("league").rlike("i")).withColumn("kind", F.lit("unlike"))
    return like.unionByName(unlike)


@query("venue_recode", """
SELECT match_id, CASE WHEN contains(lower(home), 't14') THEN 'Forest'
                      WHEN contains(lower(city), 'city3') THEN 'Antwerpen'
                      WHEN contains(lower(home), 't7') THEN 'Mechelen' ELSE city END AS city
FROM fx_matches""")
def venue_recode(t):
    home, city = F.col("home"), F.col("city")
    rules = [(home, "t14", "Forest"), (city, "city3", "Antwerpen"), (home, "t7", "Mechelen")]
    return t.matches().select("match_id", enrich.rule_recode(rules, city).alias("city"))


@query("value_recode", """
SELECT match_id, CASE city WHEN 'City1' THEN 'Munich' WHEN 'City2' THEN 'Cologne' ELSE city END AS city
FROM fx_matches""")
def value_recode(t):
    mapping = {"City1": "Munich", "City2": "Cologne"}
    return t.matches().select("match_id", enrich.value_recode(F.col("city"), mapping).alias("city"))


@query("official_name", """
WITH places AS (SELECT c_custkey AS place_id, c_name AS name,
                       CASE WHEN c_custkey % 3 = 0 THEN 'uofficielt' ELSE 'officielt' END AS status,
                       c_custkey % 4 AS n FROM customer),
sec AS (SELECT place_id, i, 'Alt' || i || ' ' || name AS alt,
               CASE WHEN i = 1 THEN 'uofficielt' ELSE 'officielt' END AS alt_status
        FROM places, generate_series(1, 3) g(i) WHERE i <= n)
SELECT p.place_id, CASE WHEN p.status = 'officielt' THEN name WHEN alt_status = 'officielt' THEN alt END AS name
FROM places p LEFT JOIN sec USING (place_id)""")
def official_name(t):
    key = F.col("c_custkey")
    alternatives = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.lit(3)),
            lambda i: F.struct(
                F.when(
                    i <= key % 4,
                    F.concat(F.lit("Alt"), i.cast("string"), F.lit(" "), F.col("c_name")),
                ).alias("navn"),
                F.when(i == 1, "uofficielt").otherwise("officielt").alias("navnstatus"),
            ),
        ),
        lambda s: s["navn"].isNotNull(),
    )
    places = t("customer").select(
        key.alias("place_id"),
        F.col("c_name").alias("name"),
        F.when(key % 3 == 0, "uofficielt").otherwise("officielt").alias("status"),
        alternatives.alias("secondary"),
    )
    return enrich.official_names(places, "name", "status", "secondary").select("place_id", "name")


@query("gazetteer_dedup", """
WITH used AS (SELECT DISTINCT city FROM fx_matches)
SELECT * EXCLUDE (top) FROM (
  SELECT *, max(population) OVER (PARTITION BY name) AS top FROM fx_cities
  WHERE name IN (SELECT city FROM used WHERE city IS NOT NULL)) WHERE population = top""")
def gazetteer_dedup(t):
    return enrich.dedup_gazetteer(t.cities(), t.matches().select(F.col("city").alias("name")))


ENRICHED = ROUNDS + """,
en AS (SELECT r.*, lon, lat FROM rounds r LEFT JOIN fx_gazetteer g ON r.city = g.name)
"""


def enriched(t):
    """Matches with derived rounds and the coordinates of their city."""
    places = t.gazetteer().select(F.col("name").alias("city"), "lon", "lat")
    return cal.derive_rounds(dated(t), "match_day").join(places, "city", "left")


@query("geo_enrich", f"WITH {ENRICHED} SELECT match_id, city, lon, lat FROM en")
def geo_enrich(t):
    return enriched(t).select("match_id", "city", "lon", "lat")


STADIUMS = """
stadiums AS (SELECT 'Stadium' || (s_suppkey % 60 + CASE s_suppkey % 4 WHEN 1 THEN 60 ELSE 0 END) AS stadium,
                    max(s_suppkey % 50 + 5)::DOUBLE AS lon, max(s_suppkey % 40 + 45)::DOUBLE AS lat
             FROM supplier GROUP BY 1)
"""


def stadiums(t):
    key = F.col("s_suppkey")
    number = key % 60 + F.when(key % 4 == 1, 60).otherwise(0)  # a quarter of the matches' stadiums has no place
    return (
        t("supplier")
        .groupBy(F.concat(F.lit("Stadium"), number.cast("string")).alias("stadium"))
        .agg(
            F.max(key % 50 + 5).cast("double").alias("lon"),
            F.max(key % 40 + 45).cast("double").alias("lat"),
        )
    )


@query("geo_patch", f"""
WITH {STADIUMS}
SELECT match_id, coalesce(s.lon, g.lon, r.lon) AS lon, coalesce(s.lat, g.lat, r.lat) AS lat
FROM fx_matches m LEFT JOIN stadiums s USING (stadium) LEFT JOIN fx_gazetteer g ON m.city = g.name
     LEFT JOIN (SELECT 'T' || c_custkey AS home, (c_custkey % 180)::DOUBLE AS lon, (c_custkey % 80)::DOUBLE AS lat
                FROM customer) r USING (home)""")
def geo_patch(t):
    first = t.matches().join(stadiums(t), "stadium", "left")
    second = t.gazetteer().select(F.col("name").alias("city"), "lon", "lat")
    key = F.col("c_custkey")
    third = t("customer").select(
        F.concat(F.lit("T"), key.cast("string")).alias("home"),
        (key % 180).cast("double").alias("lon"),
        (key % 80).cast("double").alias("lat"),
    )
    patched = enrich.patch_nulls(first, second, ["city"], ["lon", "lat"])
    return enrich.patch_nulls(patched, third, ["home"], ["lon", "lat"]).select(
        "match_id", "lon", "lat"
    )


@query("marker_jitter", f"""
WITH {ENRICHED}
SELECT match_id, CASE WHEN row_number() OVER (PARTITION BY derived_round, lon, lat ORDER BY match_id) > 1
                      THEN lon + 0.15 ELSE lon END AS lon, lat FROM en""")
def marker_jitter(t):
    return cal.marker_jitter(
        enriched(t), ["derived_round", "lon", "lat"], "match_id", "lon"
    ).select("match_id", "lon", "lat")


@query("coverage_gaps", f"""
WITH {ENRICHED}, miss AS (SELECT * FROM en WHERE lon IS NULL OR lat IS NULL)
SELECT 'city' AS kind, city AS value FROM miss UNION SELECT 'stadium', stadium FROM miss
UNION SELECT 'home', home FROM miss
UNION SELECT 'home_any_null', home FROM fx_matches GROUP BY home HAVING bool_or(city IS NULL)""")
def coverage_gaps(t):
    missing = F.col("lon").isNull() | F.col("lat").isNull()
    gaps = cal.coverage_gaps(enriched(t), ["city", "stadium", "home"], missing)
    any_null = (
        t.matches()
        .groupBy("home")
        .agg(F.bool_or(F.col("city").isNull()).alias("gap"))
        .where("gap")
        .select(F.lit("home_any_null").alias("kind"), F.col("home").alias("value"))
    )
    return gaps.unionByName(any_null)


UPSERT = """
missing AS (SELECT DISTINCT city AS name FROM fx_matches
            WHERE city IS NOT NULL AND city NOT IN (SELECT name FROM fx_cities)),
offered AS (SELECT c_custkey AS city_id, 'City' || (c_custkey % 45) AS name,
                   CAST(round(c_acctbal * 100) AS BIGINT) AS population,
                   CAST(c_custkey % 90 AS DOUBLE) / 10 + 8 AS lon, CAST(c_custkey % 70 AS DOUBLE) / 10 + 50 AS lat
            FROM customer),
fresh AS (SELECT * EXCLUDE (top) FROM (SELECT *, max(population) OVER (PARTITION BY name) AS top
          FROM offered WHERE name IN (SELECT name FROM missing)) WHERE population = top)
"""


@query("gazetteer_upsert", f"WITH {UPSERT} SELECT * FROM fx_cities UNION SELECT * FROM fresh")
def gazetteer_upsert(t):
    old = t.cities()
    missing = enrich.unmatched_keys(t.matches(), old, "city", "name")
    key = F.col("c_custkey")
    offered = t("customer").select(
        key.alias("city_id"),
        F.concat(F.lit("City"), (key % 45).cast("string")).alias("name"),
        F.round(F.col("c_acctbal") * 100).cast("bigint").alias("population"),
        ((key % 90).cast("double") / 10 + 8).alias("lon"),
        ((key % 70).cast("double") / 10 + 50).alias("lat"),
    )
    return enrich.upsert_dimension(old, enrich.dedup_gazetteer(offered, missing))


@query("match_label", f"""
SELECT match_id, home || ' - ' || away || chr(10) || strftime(kickoff, '%d/%m-%Y') || ' ' || {GERMAN_TIME} AS label
FROM fx_matches""")
def match_label(t):
    title = cal.match_title(F.col("home"), F.col("away"))
    time = cal.kickoff_text(F.col("kickoff"), F.col("status"))
    return t.matches().select(
        "match_id", cal.match_label(title, F.to_date("kickoff"), time).alias("label")
    )


@query("calendar_ready", """
SELECT home, count(match_id) AS matches, count(match_id) > 0 AS ready
FROM (SELECT 'T' || c_custkey AS home FROM customer) c LEFT JOIN fx_matches USING (home) GROUP BY 1""")
def calendar_ready(t):
    teams = t("customer").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("home")
    )
    return cal.calendar_ready(t.matches(), teams, "home")


@query("league_catalogue", """
SELECT r_name AS country, comp_id, season_id
FROM fx_seasons JOIN region ON r_regionkey = comp_id ORDER BY country, season_id""")
def league_catalogue(t):
    leagues = (
        t.seasons()
        .groupBy("comp_id")
        .agg(F.sort_array(F.collect_set("season_id")).alias("seasons"))
        .join(
            t("region").select(F.col("r_regionkey").alias("comp_id"), F.col("r_name").alias("country")),
            "comp_id",
        )
    )
    return (
        leagues
        .select("country", "comp_id", F.explode("seasons").alias("season_id"))
        .orderBy("country", "season_id")
    )


@query("id_digits", """
SELECT c_custkey AS place_id, c_custkey AS number FROM customer""")
def id_digits(t):
    composite = F.concat(F.lit("sr:competition:"), F.col("c_custkey").cast("string"))
    return t("customer").select(
        F.col("c_custkey").alias("place_id"), tx.id_digits(composite).alias("number")
    )


@query("countdown", f"""
WITH m AS (SELECT n_regionkey AS region_id, strftime(o_orderdate, '%YM%m') AS period, count(*) AS persons
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           GROUP BY 1, 2)
SELECT region_id, max(period) AS period, {POPULATION_TARGET} - max_by(persons, period) AS missing FROM m GROUP BY 1""")
def countdown(t):
    monthly = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.col("n_regionkey").alias("region_id"),
            F.date_format("o_orderdate", "yyyy'M'MM").alias("period"),
        )
        .agg(F.count(F.lit(1)).alias("persons"))
    )
    return enrich.countdown(monthly, ["region_id"], "period", "persons", POPULATION_TARGET)
