"""Calendar rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.operators import calendar as cal


def days(spark, *dates):
    return spark.createDataFrame([(d,) for d in dates], "day DATE")


def test_week_rule(spark):
    df = days(spark, dt.date(2024, 7, 1), dt.date(2023, 1, 1), dt.date(2024, 12, 30))
    assert [r[0] for r in df.select(cal.match_week(F.col("day"))).collect()] == [26, 52, 0]


def test_weekend_runs_friday_to_monday(spark):
    week = [dt.date(2024, 7, 1) + dt.timedelta(i) for i in range(7)]
    out = days(spark, *week).select(cal.weekend(F.col("day")), tx.weekday_name(F.col("day"))).collect()
    assert [r[0] for r in out] == [True, False, False, False, True, True, True]
    assert [r[1] for r in out] == [
        "mandag", "tirsdag", "onsdag", "torsdag", "fredag", "lørdag", "søndag"
    ]


def test_rounds_over_new_year(spark):
    dates = [dt.date(2023, 12, 9), dt.date(2023, 12, 16), dt.date(2024, 1, 13)]
    plain = cal.derive_rounds(days(spark, *dates), "day")
    assert {r.day: r.derived_round for r in plain.collect()} == dict(zip(dates, [2, 3, 1]))
    by_year = cal.derive_rounds(days(spark, *dates), "day", by_year=True)
    assert {r.day: r.derived_round for r in by_year.collect()} == dict(zip(dates, [1, 2, 3]))


def test_kickoff_in_summer_and_winter(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 7, 1, 18, 30), "NS"), (dt.datetime(2024, 1, 1, 18, 30), "NS"),
         (dt.datetime(2024, 1, 1, 18, 30), "TBD")],
        "kickoff TIMESTAMP_NTZ, status STRING",
    )
    out = df.select(cal.kickoff_text(F.col("kickoff"), F.col("status"))).collect()
    assert [r[0] for r in out] == ["20:30", "19:30", "TBA"]


def test_unscheduled_rounds(spark):
    t0, t1 = dt.datetime(2024, 1, 1, 14), dt.datetime(2024, 1, 2, 14)
    df = spark.createDataFrame(
        [(1, "10", "3. Liga", t0, "15:00"), (2, "10", "3. Liga", t0, "15:00"),
         (3, "11", "3. Liga", t0, "15:00"), (4, "11", "3. Liga", t1, "15:00"),
         (5, "38", "3. Liga", t0, "15:00"), (6, "10", "Other", t0, "15:00")],
        "id INT, round STRING, league STRING, kickoff TIMESTAMP, text STRING",
    )
    out = cal.unscheduled_rounds(
        df, ["round", "league"], "kickoff", "text", "round", "38", "league", ["3. Liga"]
    )
    assert {r.id: r.text for r in out.collect()} == {
        1: "TBA", 2: "TBA", 3: "15:00", 4: "15:00", 5: "15:00", 6: "15:00"
    }


def test_next_rounds_put_upcoming_first(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 8)), (3, dt.date(2024, 1, 15)),
         (3, dt.date(2024, 1, 16))],
        "round INT, day DATE",
    )
    out = cal.next_rounds(df, "round", "day", F.lit(dt.date(2024, 1, 8)))
    assert [(r.round, r.days_away, r.past) for r in out.collect()] == [
        (2, 0, False), (3, 7, False), (1, -7, True)
    ]


def test_jitter_moves_later_markers(spark):
    df = spark.createDataFrame(
        [(1, 1, 8.0, 50.0), (2, 1, 8.0, 50.0), (3, 1, 8.0, 50.0), (4, 2, 8.0, 50.0), (5, 1, None, None)],
        "id INT, round INT, lon DOUBLE, lat DOUBLE",
    )
    out = cal.marker_jitter(df, ["round", "lon", "lat"], "id", "lon")
    assert {r.id: r.lon for r in out.collect()} == {1: 8.0, 2: 8.15, 3: 8.15, 4: 8.0, 5: None}


def test_home_and_away_in_any_order(spark):
    df = spark.createDataFrame(
        [(1, [("A", "home"), ("B", "away")]), (2, [("B", "away"), ("A", "home")]), (3, [("A", "home")])],
        "id INT, c ARRAY<STRUCT<name: STRING, qualifier: STRING>>",
    )
    home, away = cal.home_away(F.col("c"))
    out = df.select("id", home.alias("h"), away.alias("a")).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, "A", "B"), (2, "A", "B"), (3, "A", None)]


def test_season_year(spark):
    df = days(spark, dt.date(2024, 6, 30), dt.date(2024, 7, 1))
    assert [r[0] for r in df.select(cal.season_year(F.col("day"))).collect()] == [2023, 2024]


def test_label(spark):
    df = days(spark, dt.date(2024, 7, 1))
    label = cal.match_label(F.lit("A - B"), F.col("day"), F.lit("TBA"), "<br/>")
    assert df.select(label).first()[0] == "A - B<br/>01/07-2024 TBA"


def test_calendar_of_a_source_without_status(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 7, 6, 18, 30))], "match_id INT, kickoff TIMESTAMP")
    row = cal.derive_calendar(df).first()
    assert (row.kickoff_text, row.derived_round) == ("20:30", 1)


def test_times_of_each_rows_own_zone(spark):
    from civicspark.sources.matches import zoned_instant

    told = [
        (1, "2024-07-06T18:30:00+00:00", "America/New_York", "20:30", "14:30"),
        (2, "2024-07-06T14:30:00", "America/New_York", "20:30", "14:30"),
        (3, "2024-01-06T14:30:00", "America/New_York", "20:30", "14:30"),
        (4, "2024-07-06T20:30:00", "Asia/Tokyo", "13:30", "20:30"),
        (5, "2024-01-06T20:30:00Z", None, "21:30", None),
        (6, "2024-01-06T20:30:00", None, "21:30", None),
        (7, "soon", "Asia/Tokyo", None, None),
    ]
    df = spark.createDataFrame([t[:3] for t in told], "id INT, start STRING, timezone STRING")
    out = cal.derive_calendar(df.withColumn("kickoff", zoned_instant(F.col("start"), F.col("timezone"))))
    assert sorted((r.id, r.kickoff_text, r.venue_text) for r in out.collect()) == [(i, a, b) for i, _, _, a, b in told]


def test_programme_starts_with_the_next_round(spark):
    days = ["2024-01-01", "2024-01-20", "2024-01-21", "2024-02-10"]
    df = spark.createDataFrame([(i, d, n) for i, (d, n) in enumerate(zip(days, [1, 3, 3, 2]))], "id INT, d STRING, n INT")
    out = cal.round_programme(df.withColumn("d", F.to_date("d")), "n", "d", F.lit("2024-01-15").cast("date"), ["id"])
    assert [(r.place, r.n, r.id, r.past) for r in out.collect()] == [(1, 3, 1, False), (1, 3, 2, False), (2, 2, 3, False), (3, 1, 0, True)]


def test_both_outcomes_of_the_unscheduled_rule(spark):
    from civicspark.plans import load_all

    rows = load_all().QUERIES["unscheduled_round"](spark, "/root/testdata/sf0.001").groupBy("changed").count().collect()
    assert {r.changed for r in rows} == {True, False}
