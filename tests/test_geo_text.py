"""Polygons, hierarchy and text functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.operators import geo, reshape

POLYGON = "id INT, rings ARRAY<ARRAY<ARRAY<DOUBLE>>>"


def box(x, y, w, h, clockwise=False):
    ring = [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    return [[float(c) for c in p] for p in (ring[::-1] if clockwise else ring)]


def sphere(x, y, w, h):
    return geo.EARTH_RADIUS_KM**2 * math.radians(w) * (
        math.sin(math.radians(y + h)) - math.sin(math.radians(y))
    )


def test_area_and_centroid_whatever_the_direction(spark):
    rows = [
        (1, [box(0, 50, 2, 2)]),
        (2, [box(0, 50, 2, 2, clockwise=True)]),
        (3, [box(0, 50, 2, 2), box(1, 51, 1, 1, clockwise=True)]),
        (4, [box(0, 50, 2, 2), box(1, 51, 1, 1)]),
    ]
    df = spark.createDataFrame(rows, POLYGON)
    out = df.select(
        "id", geo.polygon_area_km2(F.col("rings")).alias("area"), geo.polygon_centroid(F.col("rings")).alias("c")
    ).orderBy("id").collect()
    full = sphere(0, 50, 2, 2)
    hole = full - sphere(1, 51, 1, 1)
    assert [r.area for r in out] == pytest.approx([full, full, hole, hole])
    centre = (4 * 1 - 1 * 1.5) / 3
    assert [r.c.x for r in out] == pytest.approx([1, 1, centre, centre])
    assert [r.c.y for r in out] == pytest.approx([51, 51, (4 * 51 - 51.5) / 3, (4 * 51 - 51.5) / 3])


def test_area_and_centroid_of_several_polygons(spark):
    places = [(1, [[box(0, 50, 2, 2), box(1, 51, 1, 1)], [box(4, 50, 1, 1, clockwise=True)]]), (2, []), (3, None)]
    df = spark.createDataFrame(places, "id INT, polygons ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")
    whole = F.col("polygons")
    out = df.select(
        "id", geo.multi_polygon_area_km2(whole).alias("area"), geo.multi_polygon_centroid(whole).alias("c")
    ).orderBy("id").collect()
    area = sphere(0, 50, 2, 2) - sphere(1, 51, 1, 1) + sphere(4, 50, 1, 1)
    assert out[0].area == pytest.approx(area)
    assert (out[0].c.x, out[0].c.y) == pytest.approx(((4 * 1 - 1.5 + 4.5) / 4, (4 * 51 - 51.5 + 50.5) / 4))
    assert (out[1].area, out[1].c.x, out[2].area) == (0, None, None)


def test_namesakes_in_a_group(spark):
    df = spark.createDataFrame([("A", "x"), ("A", "x"), ("A", "b")], "party STRING, name STRING")
    every = reshape.member_text(df, ["party"], "name", distinct=False).first()
    once = reshape.member_text(df, ["party"], "name").first()
    assert (every.members, every.n_members) == ("b, x, x", 3)
    assert (once.members, once.n_members) == ("b, x", 2)


def test_area_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, [box(0, 50, 2, 2)])], POLYGON)
    plan = df.select(geo.polygon_area_km2(F.col("rings")))._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()


def test_hierarchy_keeps_childless_areas(spark, rows):
    regions = spark.createDataFrame([(1,), (2,)], "region INT")
    areas = spark.createDataFrame([(1, 10), (1, 11)], "region INT, area INT")
    districts = spark.createDataFrame([(10, 100)], "area INT, district INT")
    out = geo.hierarchy([regions, areas, districts])
    assert rows(out, "region", "area", "district") == [(1, 10, 100), (1, 11, None), (2, None, None)]
    with pytest.raises(ValueError):
        geo.hierarchy([regions, spark.createDataFrame([(1,)], "other INT")])


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("title", "name"),
    [("Københavns Storkreds", "København"), ("Fyns Storkreds", "Fyn"), ("Østjylland", "Østjylland")],
)
def test_area_name(spark, title, name):
    assert one(spark, tx.area_name(F.lit(title))) == name


def test_rounding_of_halves(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (0.5,)], "x DOUBLE")
    assert [r[0] for r in df.select(F.bround("x", 0)).collect()] == [2.0, 4.0, 0.0]


def test_text_functions(spark):
    assert one(spark, tx.title_case(F.lit("SAINT-NICOLAS"))) == "Saint-Nicolas"
    assert one(spark, tx.round_name(F.lit("Regular Season - 12"))) == "12"
    assert one(spark, tx.stage_name(F.lit("Regular Season - 12"))) == "Regular Season"
    assert one(spark, tx.round_name(F.lit("Final"))) is None
    assert one(spark, tx.id_digits(F.lit("sr:competition:38"))) == 38
    assert one(spark, tx.danish_number(F.lit(5961249.5), 1)) == "5.961.249,5"
    assert one(spark, tx.danish_number(F.lit(5961249), 0, " ")) == "5 961 249"
    assert one(spark, tx.percent_text(F.lit(0.1234))) == "12,34 %"


@pytest.mark.parametrize(
    ("text", "value"),
    [("12", 12), (" -7 ", -7), ("1.5", None), ("x", None), ("", None), (None, None), ("9" * 19, None)],
)
def test_whole_number(spark, text, value):
    assert one(spark, tx.whole_number(F.lit(text).cast("string"))) == value


@pytest.mark.parametrize(
    ("text", "value"),
    [("12", 12.0), (" -7.25", -7.25), (".5", 0.5), ("1e3", 1000.0), ("1,5", None), ("x", None)],
)
def test_decimal_number(spark, text, value):
    assert one(spark, tx.decimal_number(F.lit(text))) == value


def test_point_text(spark):
    assert one(spark, tx.point_part(F.lit("c(12.5, 55.1)"), 2)) == 55.1
    assert one(spark, tx.point_part(F.lit("55.1,12.5"), 1)) == 55.1
    assert one(spark, tx.point_part(F.lit("unknown"), 1)) is None


def test_danish_order(spark):
    names = ["Zealand", "Ørsted", "Aalborg", "Århus", "Ærø", "Viborg"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    got = [r.n for r in df.orderBy(reshape.danish_order(F.col("n"))).collect()]
    assert got[:4] == ["Viborg", "Zealand", "Ærø", "Ørsted"]
    assert set(got[4:]) == {"Aalborg", "Århus"}


def test_reshape(spark, rows):
    df = spark.createDataFrame([(1, "A", 3), (1, "B", 4), (2, "A", 5)], "g INT, p STRING, v INT")
    assert rows(reshape.totals_row(df, "p", "I alt", {"v": "v"}, ["g"]), "g", "p", "v") == [
        (1, "A", 3), (1, "B", 4), (1, "I alt", 7), (2, "A", 5), (2, "I alt", 5)
    ]
    nested = reshape.nest(df, ["g"], "rows")
    assert rows(reshape.unnest(nested, "rows")) == rows(df)
    assert rows(reshape.member_text(df, ["g"], "p")) == [(1, "A, B", 2), (2, "A", 1)]
    assert rows(reshape.repeat_rows(df.where("g = 2"), F.lit(2), "i"), "p", "i") == [("A", 1), ("A", 2)]
    wide = reshape.quotient_matrix(df, ["g"], "p", "v", ["A", "B"])
    assert rows(wide, "g", "A", "B") == [(1, 3, 4), (2, 5, None)]
    order = df.select("p").distinct().orderBy(reshape.selected_first(F.col("p"), ["B"]))
    assert [r.p for r in order.collect()] == ["B", "A"]


def test_whole_number_takes_the_whole_range(spark):
    from pyspark.sql import functions as F

    from civicspark.functions.text import whole_number

    texts = ["9223372036854775807", "-9223372036854775808", "9223372036854775808", "1000000000000000000", "1x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(whole_number(F.col("t"))).collect()]
    assert got == [2**63 - 1, -(2**63), None, 10**18, None]
