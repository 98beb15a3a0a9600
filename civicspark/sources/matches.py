"""Match records (JSON) of both calendar sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.operators import calendar as cal
from civicspark.operators import enrich
from civicspark.sources import fixed_values as fixed

MATCH_SCHEMA = (
    "league STRUCT<id: BIGINT, name: STRING, country: STRING, season: INT, round: STRING>, "
    "fixture STRUCT<id: BIGINT, date: STRING, timezone: STRING, "
    "status: STRUCT<long: STRING, short: STRING>, "
    "venue: STRUCT<id: BIGINT, name: STRING, city: STRING>>, "
    "teams STRUCT<home: STRUCT<name: STRING>, away: STRUCT<name: STRING>>"
)
SCHEDULE_SCHEMA = (
    "sport_event STRUCT<id: STRING, start_time: STRING, "
    "sport_event_context: STRUCT<category: STRUCT<name: STRING, country_code: STRING>, "
    "competition: STRUCT<id: STRING, name: STRING>, "
    "season: STRUCT<name: STRING, start_date: STRING, end_date: STRING>, "
    "round: STRUCT<number: INT>>, "
    "competitors: ARRAY<STRUCT<name: STRING, qualifier: STRING>>, "
    "venue: STRUCT<name: STRING, capacity: INT, city_name: STRING, map_coordinates: STRING, "
    "timezone: STRING>>"
)


def read_matches(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Nested match records of any number of leagues in one read."""
    return spark.read.schema(MATCH_SCHEMA).json(paths if isinstance(paths, str) else list(paths))


def flatten_matches(matches: DataFrame) -> DataFrame:
    """Flat match columns out of nested records."""
    return matches.select(
        F.col("fixture.id").alias("match_id"),
        tx.round_name(F.col("league.round")).alias("round"),
        tx.stage_name(F.col("league.round")).alias("stage"),
        F.concat_ws("/", "league.season", F.col("league.season") + 1).alias("season"),
        F.col("league.id").alias("league_id"),
        F.col("league.name").alias("league"),
        F.col("league.country").alias("country"),
        F.to_timestamp("fixture.date").alias("kickoff"),
        F.col("fixture.status.short").alias("status"),
        F.col("fixture.status.long").alias("status_text"),
        F.col("teams.home.name").alias("home"),
        F.col("teams.away.name").alias("away"),
        F.col("fixture.venue.id").alias("stadium_id"),
        F.col("fixture.venue.name").alias("stadium"),
        F.col("fixture.venue.city").alias("city"),
    ).distinct()


def widen(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace struct columns by their fields, named ``<column>_<field>``."""
    fields = []
    for column in records.columns:
        if column in columns:
            fields += [
                F.col(f"{column}.{f.name}").alias(f"{column}_{f.name}")
                for f in records.schema[column].dataType.fields
            ]
        else:
            fields.append(F.col(column))
    return records.select(*fields)


def zoned_instant(text: Column, zone: Column) -> Column:
    """The instant of a time text: by its own offset, or else as the local time of its row's zone.

    A row without a zone is in UTC. Meant for a session whose time zone is UTC.
    """
    own = F.try_to_timestamp(text)
    local = F.to_utc_timestamp(own, F.coalesce(zone, F.lit("UTC")))
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), own).otherwise(local)


def read_schedules(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Flat matches of the second source: competitors array, coordinate text, a time zone per venue."""
    raw = spark.read.schema(SCHEDULE_SCHEMA).json(
        paths if isinstance(paths, str) else list(paths)
    ).select("sport_event.*")
    home, away = cal.home_away(F.col("competitors"))
    return raw.select(
        F.col("id").alias("match_id"),
        F.col("sport_event_context.category.name").alias("country"),
        F.col("sport_event_context.category.country_code").alias("country_code"),
        F.col("sport_event_context.competition.name").alias("league"),
        F.col("sport_event_context.season.name").alias("season"),
        F.to_date("sport_event_context.season.start_date").alias("season_start"),
        F.to_date("sport_event_context.season.end_date").alias("season_end"),
        F.col("sport_event_context.round.number").alias("round"),
        zoned_instant(F.col("start_time"), F.col("venue.timezone")).alias("kickoff"),
        F.col("venue.timezone").alias("timezone"),
        home.alias("home"),
        away.alias("away"),
        cal.match_title(home, away).alias("title"),
        F.col("venue.name").alias("stadium"),
        F.col("venue.capacity").alias("capacity"),
        F.col("venue.city_name").alias("city"),
        tx.point_part(F.col("venue.map_coordinates"), 1).alias("lat"),
        tx.point_part(F.col("venue.map_coordinates"), 2).alias("lon"),
    )


def union_loads(loads: Sequence[DataFrame]) -> DataFrame:
    """Union of separate loads by column name; columns a load lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), loads)


def gazetteer_places(matches: DataFrame) -> DataFrame:
    """Cities and stadiums of matches as the gazetteer names them.

    A rule on the home team or the city comes first, then the city of a stadium whose match
    records name another one or none, then the spelling of the city; stadiums get their present names.
    """
    rules = [(F.col(column), text, city) for column, text, city in fixed.CITY_RULES]
    city = enrich.value_recode(F.col("city"), fixed.MATCH_CITY_NAMES)
    by_stadium = enrich.value_recode(F.col("stadium"), fixed.STADIUM_CITIES)
    city = F.when(F.col("stadium").isin(list(fixed.STADIUM_CITIES)), by_stadium).otherwise(city)
    return matches.withColumns(
        {
            "city": enrich.rule_recode(rules, city),
            "stadium": enrich.value_recode(F.col("stadium"), fixed.STADIUM_NAMES),
        }
    )


def gazetteer_names(cities: DataFrame, name: str = "name") -> DataFrame:
    """Gazetteer rows under the names the match records use."""
    return cities.withColumn(name, enrich.value_recode(F.col(name), fixed.CITY_NAMES))
