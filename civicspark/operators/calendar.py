"""Match calendars: rounds, weekends, seasons and ordering.

Matches grow with the data, so nothing here puts matches of one key into one task: the
derived rounds are numbered on the distinct (week, weekend) pairs, at most two per
calendar week, and everything else is an aggregate joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import weekday_name
from civicspark.operators.grouping import duplicate_flag, null_safe_join, with_group_stats


def match_week(day: Column) -> Column:
    """ISO week; a Monday belongs to the week before."""
    return F.weekofyear(day) - F.when(F.weekday(day) == 0, 1).otherwise(0)


def weekend(day: Column) -> Column:
    """True from Friday to Monday."""
    return F.weekday(day).isin(0, 4, 5, 6)


def season_year(day: Column) -> Column:
    """Start year of the season a day falls in; the season turns in July."""
    return F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)


def kickoff_text(
    kickoff: Column, status: Column, tz: str | Column = "Europe/Berlin", undecided: str = "TBD"
) -> Column:
    """Local kick-off ``HH:mm``, ``TBA`` while undecided.

    ``kickoff`` is UTC: a timestamp without zone, or an instant in a session set to UTC. ``tz``
    is one zone, or a column with the zone of each row.
    """
    utc = kickoff.cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz) if isinstance(tz, str) else tz, utc)
    return F.when(status == undecided, "TBA").otherwise(F.date_format(local, "HH:mm"))


def derive_rounds(matches: DataFrame, day: str, by_year: bool = False) -> DataFrame:
    """Number the (week, weekend) pairs over all leagues and date each round.

    Weeks carry no year unless ``by_year``. The table of pairs has at most 108 rows
    (times years), so one task ranks it.
    """
    base = matches.withColumn("match_week", match_week(F.col(day))).withColumn(
        "weekend", weekend(F.col(day))
    )
    by = ["match_week", "weekend"]
    if by_year:
        # weeks of one season year stay together across New Year
        thursday = F.date_add(F.trunc(day, "week"), 3)
        base = base.withColumn("iso_year", F.year(thursday))
        by = ["iso_year", *by]
    pairs = base.groupBy(*by).agg(F.min(day).alias("round_start"))
    rounds = pairs.withColumn("derived_round", F.dense_rank().over(Window.orderBy(*by)))
    return null_safe_join(base, rounds, by)


def derive_calendar(
    matches: DataFrame, kickoff: str = "kickoff", tz: str = "Europe/Berlin", by_year: bool = False
) -> DataFrame:
    """Day, weekday, kick-off text, week, weekend, derived round and round start.

    A source without a ``status`` column has no undecided kick-offs. One with a ``timezone`` column
    also gets ``venue_text``, the kick-off where it is played.
    """
    status = F.col("status") if "status" in matches.columns else F.lit(None).cast("string")
    dated = matches.withColumn("match_day", F.to_date(kickoff)).withColumns(
        {
            "kickoff_text": kickoff_text(F.col(kickoff), status, tz),
            "weekday": weekday_name(F.to_date(kickoff)),
        }
    )
    if "timezone" in matches.columns:
        dated = dated.withColumn("venue_text", kickoff_text(F.col(kickoff), status, F.col("timezone")))
    return derive_rounds(dated, "match_day", by_year)


def unscheduled_rounds(
    matches: DataFrame,
    keys: Sequence[str],
    kickoff: str,
    text: str,
    round_no: str,
    last_round: str | None = None,
    league: str | None = None,
    leagues: Sequence[str] | None = None,
) -> DataFrame:
    """``TBA`` for rounds whose matches all share one instant, except the last round."""
    stats = with_group_stats(matches, keys, __lo=F.min(kickoff), __hi=F.max(kickoff))
    open_round = F.col("__lo") == F.col("__hi")
    if last_round is not None:
        open_round = open_round & (F.col(round_no) != last_round)
    if leagues is not None:
        open_round = open_round & F.col(league).isin(list(leagues))
    return stats.withColumn(text, F.when(open_round, "TBA").otherwise(F.col(text))).drop(
        "__lo", "__hi"
    )


def next_rounds(rounds: DataFrame, round_no: str, day: str, as_of: Column) -> DataFrame:
    """One row per round with its first day, upcoming rounds first, nearest first."""
    firsts = rounds.groupBy(round_no).agg(F.min(day).alias("first_day"))
    return (
        firsts.withColumn("days_away", F.datediff("first_day", as_of))
        .withColumn("past", F.col("first_day") < as_of)
        .orderBy("past", "days_away", round_no)
    )


def round_programme(
    matches: DataFrame, round_no: str, day: str, as_of: Column, order: Sequence[str] = ()
) -> DataFrame:
    """Every match with its round's place, upcoming rounds first, nearest first.

    The rounds of a calendar are few, so one task numbers them; the matches stay rows of their own, in
    the order of the rounds and then of ``order``.
    """
    rounds = next_rounds(matches, round_no, day, as_of)
    place = F.row_number().over(Window.orderBy("past", "days_away", round_no))
    numbered = rounds.select(round_no, "first_day", "days_away", "past", place.alias("place"))
    return null_safe_join(matches, numbered, [round_no]).orderBy("place", *order)


def home_away(competitors: Column) -> tuple[Column, Column]:
    """Home and away names out of an array of ``struct(name, qualifier)``."""

    def side(name: str) -> Column:
        return F.get(F.filter(competitors, lambda c: c["qualifier"] == name), F.lit(0))["name"]

    return side("home"), side("away")


def match_title(home: Column, away: Column) -> Column:
    """``home - away``."""
    return F.concat_ws(" - ", home, away)


def match_label(title: Column, day: Column, time: Column, separator: str = "\n") -> Column:
    """Tooltip text: title, date and time."""
    return F.format_string(f"%s{separator}%s %s", title, F.date_format(day, "dd/MM-yyyy"), time)


def marker_jitter(
    matches: DataFrame, keys: Sequence[str], row_id: str, lon: str, shift: float = 0.15
) -> DataFrame:
    """Shift the second and later markers on one point of a round to the east."""
    flagged = duplicate_flag(matches, keys, row_id, "__again")
    return flagged.withColumn(
        lon, F.when(F.col("__again"), F.col(lon) + shift).otherwise(F.col(lon))
    ).drop("__again")


def calendar_ready(matches: DataFrame, countries: DataFrame, country: str) -> DataFrame:
    """Whether each country has any match."""
    counts = matches.groupBy(country).agg(F.count(F.lit(1)).alias("matches"))
    return countries.join(counts, country, "left").select(
        country,
        F.coalesce("matches", F.lit(0)).alias("matches"),
        (F.coalesce("matches", F.lit(0)) > 0).alias("ready"),
    )


def coverage_gaps(matches: DataFrame, columns: Sequence[str], missing: Column) -> DataFrame:
    """Distinct values of each column among matches without coordinates."""
    kinds = F.array(
        *[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return matches.where(missing).select(F.explode(kinds).alias("gap")).select("gap.*").distinct()
