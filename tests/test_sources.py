"""Readers on hand-written files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from civicspark.session import materialize, shared_dir
from civicspark.sources import catalogue, counts, headers, matches, sinks, statistics

PERSONS = """<?xml version="1.0" encoding="UTF-8"?>
<Data><Status Kode="12">Optællingen er afsluttet.</Status><Sted Id="13">Bornholm</Sted>
<Personer>
 <Parti Id="1" Bogstav="A" navn="Alfa" PersonligeStemmer="9" TildeltePartiStemmer="4" StemmerIAlt="13">
  <Person Navn="Ene" PersonligeStemmer="9" TildeltePartiStemmer="4" StemmerIAlt="13"/></Parti>
 <Parti Id="2" Bogstav="B" navn="Beta" PersonligeStemmer="5" TildeltePartiStemmer="3" StemmerIAlt="8">
  <Person Navn="To" PersonligeStemmer="2" TildeltePartiStemmer="3" StemmerIAlt="5"/>
  <Person Navn="Tre" PersonligeStemmer="3" StemmerIAlt="3"/></Parti>
 <Parti Id="3" navn="Løs Kandidat" PersonligeStemmer="7" TildeltePartiStemmer="0" StemmerIAlt="7"/>
</Personer></Data>"""
WAITING = """<Data><Status Kode="0">Resultatet foreligger endnu ikke.</Status><Sted Id="14">Fyn</Sted>
<Personer><Parti Id="1" Bogstav="A" navn="Alfa"><Person Navn="Nul" PersonligeStemmer="0"/></Parti></Personer></Data>"""
MANIFEST = """<Data><ValgDato>1-11-2022</ValgDato>
<Land land_id="1" filnavn="land.xml">Hele landet</Land>
<Landsdele><Landsdel landsdel_id="7" land_id="1" filnavn="d7.xml"> Hovedstaden </Landsdel></Landsdele>
<Storkredse><Storkreds storkreds_id="10" landsdel_id="7" filnavn="s10.xml">København</Storkreds>
<Storkreds storkreds_id="13" landsdel_id="7" filnavn="s13.xml">Bornholm</Storkreds></Storkredse></Data>"""


def land(tmp_path, *documents):
    folder = tmp_path / "election_id=2022"
    folder.mkdir()
    for i, text in enumerate(documents):
        (folder / f"{i}.xml").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_candidates_single_person_independent_and_not_ready(spark, tmp_path, rows):
    path = land(tmp_path, PERSONS, WAITING)
    out = counts.read_candidate_votes(spark, path)
    assert rows(
        out, "election_id", "area_id", "letter", "party", "candidate", "personal_votes",
        "allotted_votes", "total_votes", "independent",
    ) == [
        (2022, "13", "A", "Alfa", "Ene", 9, 4, 13, False),
        (2022, "13", "B", "Beta", "To", 2, 3, 5, False),
        # a missing person attribute falls back to the party's
        (2022, "13", "B", "Beta", "Tre", 3, 3, 3, False),
        (2022, "13", None, "Uden for partier", "Løs Kandidat", 7, 0, 7, True),
    ]


def test_readiness(spark, tmp_path):
    waiting = counts.read_documents(spark, land(tmp_path, WAITING), counts.PERSON_DOCUMENT)
    assert not counts.is_ready(waiting)


def test_manifest_levels(spark, tmp_path, rows):
    path = land(tmp_path, MANIFEST)
    assert rows(counts.read_manifest(spark, path, "Storkredse"), "area_id", "parent_id", "name", "file") == [
        ("10", "7", "København", "s10.xml"), ("13", "7", "Bornholm", "s13.xml")
    ]
    assert rows(counts.read_manifest(spark, path, "land"), "area_id", "parent_id", "name") == [
        ("1", None, "Hele landet")
    ]
    assert rows(counts.read_manifest(spark, path, "landsdele"), "name") == [("Hovedstaden",)]
    assert counts.read_manifest(spark, path, "opstillingskredse").count() == 0
    assert rows(counts.read_manifest(spark, path, "storkredse", nth=1), "area_id") == [("13",)]
    assert counts.read_manifest(spark, path, "storkredse", nth=2).count() == 0


@pytest.mark.parametrize(
    ("level", "kind"),
    [("storkredse", "stemme"), ("kommuner", "parti"), ("land", "person"), ("landsdele", "Person")],
)
def test_bad_requests_fail_before_any_job(level, kind):
    with pytest.raises(ValueError):
        counts.check_request(level, kind)


def test_good_requests():
    assert counts.check_request("Storkredse", "Person") == "storkredse"
    assert counts.check_request("LAND", "person", national_persons=True) == "land"


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`@IdParti` INT, `Stemmer.I` INT, `#text` INT, Extra INT")
    out = headers.clean_headers(df, rename={"text": "area", "none": "x"}, drop=["extra", "none"])
    assert out.columns == ["id_parti", "stemmer_i", "area"]
    assert headers.clean_headers(df, snake=False).columns == ["idparti", "stemmeri", "text", "extra"]


def test_alternative_spellings(spark, rows):
    df = spark.createDataFrame([(None, 2), (1, 3)], "a INT, b INT")
    assert rows(headers.coalesce_spellings(df, {"v": ["a", "missing", "b"]})) == [(1,), (2,)]


def test_published_catalogue(spark):
    out = catalogue.published_catalogue(spark, 2029, "landing")
    got = {(r.year, r.type, r.kind): r for r in out.collect()}
    assert len(got) == 2 * (5 + 4)
    row = got[(2024, "EP", "fintælling")]
    assert (row.seats, row.letters, row.link) == (15, "Ø", "landing/Valg2546524/xml/fintal.xml")
    assert got[(2029, "EP", "valgaften")].link is None
    assert got[(2022, "FT", "valgaften")].link == "landing/Valg1968094/xml/valgdag.xml"
    assert got[(2019, "FT", "valgaften")].seats is None


def test_published_tables(spark):
    assert catalogue.constituency_seats(spark).agg(F.sum("seats")).first()[0] == 135
    assert catalogue.region_pool(spark).agg(F.sum("pool")).first()[0] == 40
    sizes = {r.election_id: r["count"] for r in catalogue.alliances(spark).groupBy("election_id").count().collect()}
    assert sizes == {2009: 9, 2014: 8, 2019: 10, 2024: 11}


def test_phase_depends_on_the_given_day(spark):
    df = spark.createDataFrame(
        [("7-6-2009", "valgaften"), ("7-6-2009", "fintælling")], "date STRING, kind STRING"
    )
    for day, kind in ((dt.date(2009, 6, 7), "valgaften"), (dt.date(2009, 6, 8), "fintælling")):
        assert [r.kind for r in catalogue.pick_phase(df, "date", F.lit(day)).collect()] == [kind]


def test_decimal_comma(spark, tmp_path, rows):
    (tmp_path / "t.csv").write_text("TID;INDHOLD\n2024M01;5.961.249\n2024M02;1,5\n")
    out = statistics.read_decimal_comma(spark, str(tmp_path), "TID STRING, INDHOLD DECIMAL(18,2)")
    assert [(a, float(b)) for a, b in rows(out)] == [("2024M01", 5961249.0), ("2024M02", 1.5)]


def test_latest_period(spark, tmp_path, rows):
    info = {
        "id": "T1",
        "variables": [
            {"id": "A", "text": "a", "values": [{"id": "9", "text": "zz"}]},
            {"id": "Tid", "text": "tid", "time": True,
             "values": [{"id": "1", "text": "2024M01"}, {"id": "2", "text": "2024M02"}]},
        ],
    }
    (tmp_path / "t.json").write_text(json.dumps(info))
    assert rows(statistics.latest_period(statistics.read_table_info(spark, str(tmp_path)))) == [
        ("T1", "2024M02")
    ]


def test_multi_line_geojson(spark, tmp_path):
    doc = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"name": "a"},
             "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
        ],
    }
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    features = statistics.read_features(spark, str(tmp_path)).withColumn("name", F.col("properties")["name"])
    points = statistics.ring_points(features, "name").orderBy("i").collect()
    assert [(r.lon, r.lat) for r in points] == [(0, 0), (1, 0), (1, 1), (0, 0)]


def geometry(kind, coordinates):
    return {"type": "Feature", "properties": {"name": kind}, "geometry": {"type": kind, "coordinates": coordinates}}


def test_multi_polygons_and_unknown_geometries(spark, tmp_path):
    triangle = [[0.5, 0], [1, 0], [1, 1], [0.5, 0]]
    doc = [geometry("MultiPolygon", [[triangle, triangle[::-1]], [triangle]]), geometry("Polygon", [triangle]),
           {"type": "Feature", "properties": {"name": "none"}, "geometry": None}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": doc}))
    features = statistics.read_features(spark, str(tmp_path)).withColumn("name", F.col("properties")["name"])
    assert {r["name"]: r.polygons and [len(p) for p in r.polygons] for r in features.collect()} == {
        "MultiPolygon": [2, 1], "Polygon": [1], "none": None,
    }
    points = statistics.ring_points(features, "name").where("i = 0").orderBy("name", "polygon", "ring")
    assert [(r["name"], r.polygon, r.ring, r.lon) for r in points.collect()] == [
        ("MultiPolygon", 0, 0, 0.5), ("MultiPolygon", 0, 1, 0.5), ("MultiPolygon", 1, 0, 0.5), ("Polygon", 0, 0, 0.5),
    ]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [geometry("Point", [1, 2])]}))
    with pytest.raises(Exception, match="unsupported geometry: Point"):
        statistics.read_features(spark, str(tmp_path)).collect()


def test_widened_records(spark):
    df = spark.createDataFrame([((1, "x"), 5)], "league STRUCT<id: INT, name: STRING>, n INT")
    assert matches.widen(df, ["league"]).columns == ["league_id", "league_name", "n"]


def test_snapshot_folders_and_load_time(spark, tmp_path):
    df = spark.createDataFrame([("DK", 1), ("DE", 2)], "country STRING, id INT")
    path = str(tmp_path / "out")
    sinks.write_snapshot(df, path, "country", dt.datetime(2024, 2, 1))
    back = spark.read.parquet(path)
    assert back.where("country = 'DK'").first().loaded_at == dt.datetime(2024, 2, 1)
    assert (tmp_path / "out" / "country=DE").is_dir()


def test_json_sink_writes_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "k STRING, v INT").coalesce(1)
    path = tmp_path / "out"
    sinks.write_json(df, str(path))
    text = "".join(p.read_text() for p in path.glob("*.json"))
    assert json.loads(text) == {"k": "a", "v": None}


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(root)
    written = materialize(spark.range(5))
    assert written.count() == 5
    assert all(root in f for f in written.inputFiles())


def test_places_as_the_gazetteer_names_them(spark):
    from civicspark.sources import matches

    rows = [
        ("RSC Anderlecht", "Brussels", "Park"), ("Home", "Deurne", "Bosuilstadion"), ("Home", None, "Easi Arena"),
        ("Home", "Wurzburger", "Parken"), (None, "Aarhus", "Ceres Park"), ("Home", None, None),
    ]
    out = matches.gazetteer_places(spark.createDataFrame(rows, "home STRING, city STRING, stadium STRING"))
    assert [(r.city, r.stadium) for r in out.collect()] == [
        ("Anderlecht", "Park"), ("Antwerpen", "Bosuilstadion"), ("La Louvière", "Easi Arena"),
        ("Würzburg", "Parken Stadium"), ("Aarhus", "New Vejlby Stadium"), (None, None),
    ]
    names = matches.gazetteer_names(spark.createDataFrame([("Köln",), ("Bonn",), (None,)], "name STRING"))
    assert [r.name for r in names.collect()] == ["Cologne", "Bonn", None]
