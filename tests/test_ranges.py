"""Range scans, hierarchy and manifest: results under skew, and what their plans read."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from civicspark.operators import enrich, geo, grouping, reshape
from civicspark.plans import geography
from civicspark.plans.tables import Tables
from civicspark.sources import counts

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Ranges as on a large table, not put together because these are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def hot_rows(seed, n=3000):
    """19 of 20 rows under one key, a third of all at one time."""
    rng = random.Random(seed)
    return [
        (i, "hot" if rng.random() < 0.95 else rng.choice(["a", None]), 50 if rng.random() < 0.33 else rng.randint(0, 99),
         f"x{i}" if rng.random() < 0.02 else None)
        for i in range(n)
    ]


def test_a_hot_key_is_filled_over_ranges(spark):
    data = hot_rows(3)
    df = spark.createDataFrame(data, "id INT, k STRING, t BIGINT, x STRING").repartition(7)
    placed = grouping.placed_rows(df, ["k"], [F.col("t"), F.col("id")])
    parts = {r["__part"]: r["count"] for r in placed.where("k = 'hot'").groupBy("__part").count().collect()}
    assert len(parts) > 1 and max(parts.values()) < 0.8 * sum(parts.values())
    got = {r.id: r.x for r in enrich.locf(df, ["k"], "t", ["x"], ["id"]).collect()}
    last = {}
    for i, k, _, x in sorted(data, key=lambda r: (r[2], r[0])):
        last[k] = x if x is not None else last.get(k)
        assert got[i] == last[k]


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_a_hot_key_is_joined_over_ranges(spark, direction):
    left = [(i, k, t if i % 50 else None, "l") for i, k, t, _ in hot_rows(5)]
    rng = random.Random(6)
    right = [(k, t, f"{k}{t}") for k in ("hot", "a", None) for t in rng.sample(range(110), 9)] + [("hot", None, "none")]
    out = enrich.asof_join(
        spark.createDataFrame(left, "id INT, k STRING, t BIGINT, side STRING").repartition(5),
        spark.createDataFrame(right, "k STRING, u BIGINT, name STRING"), ["k"], "t", "u", direction,
    )
    assert out.columns == ["id", "k", "t", "side", "u", "name"]
    got = {r.id: (r.k, r.t, r.side, r.u) for r in out.collect()}
    assert len(got) == len(left)
    for i, k, t, side in left:
        fits = [u for key, u, _ in right if key == k and None not in (t, u) and (u >= t if direction == "forward" else u <= t)]
        assert got[i] == (k, t, side, (min(fits) if direction == "forward" else max(fits)) if fits else None)


def test_windows_hold_a_range_of_a_key(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("k"), F.col("id").alias("x"))
    text = plan(enrich.locf(df, ["k"], "id", ["x"]))
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", text)
    assert windows and any("__part" in w for w in windows)
    # The windows over a key alone run on the summaries, one row per range and key.
    assert all("__part" in w or "__last_x" in line for line in text.splitlines() if "Window [" in line
               for w in re.findall(r"\], \[(.*?)\], \[", line))


def test_asof_reads_each_side_once(spark, tmp_path, monkeypatch):
    read = []
    monkeypatch.setattr(enrich, "placed_rows", lambda df, *a: (read.append(plan(df)), grouping.placed_rows(df, *a))[1])
    for name in "lr":
        spark.range(5).select("id", F.col("id").alias("t")).write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / name)) for name in "lr")
    assert enrich.asof_join(left, right.withColumnRenamed("t", "u"), ["id"], "t", "u").count() == 5
    assert len(read) == 1 and len(re.findall(r"FileScan parquet", read[0])) == 2


def test_hierarchy_reads_no_chain_twice(spark):
    t = Tables(spark, SF_DIR)
    table = geo.hierarchy(geography.area_levels(t))
    # each level once for the chain and, below the first, once for its parents' ids
    assert len(re.findall(r"FileScan parquet", plan(table))) == 7
    two = geography.geo_pairs.__wrapped__(t) if hasattr(geography.geo_pairs, "__wrapped__") else geography.geo_pairs(t)
    assert not re.search(r"orders\.parquet|region\.parquet", plan(two))


def test_hierarchy_with_a_childless_area_on_every_level(spark, rows):
    a = spark.createDataFrame([(1,), (2,), (3,)], "a INT")
    b = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 30)], "a INT, b INT")
    c = spark.createDataFrame([(10, "x"), (10, "y"), (99, "z")], "b INT, c STRING")
    want = [(1, 10, "x"), (1, 10, "y"), (1, 11, None), (2, 20, None), (3, None, None)]
    assert rows(geo.hierarchy([a, b, c]), "a", "b", "c") == sorted(want, key=repr)


def test_all_manifest_levels_in_one_parse(spark, tmp_path):
    folder = tmp_path / "election_id=2022"
    folder.mkdir()
    (folder / "m.xml").write_text(
        '<Data><ValgDato>1</ValgDato><Land land_id="1" filnavn="l.xml"> Land </Land><Land land_id="1" filnavn="r.xml">R</Land>'
        '<Landsdele><Landsdel landsdel_id="7" land_id="1" filnavn="d.xml">Del</Landsdel></Landsdele></Data>'
    )
    levels = ["land", "landsdele", "storkredse"]
    areas = counts.read_manifest(spark, str(tmp_path), levels)
    assert len(re.findall(r"FileScan xml", plan(areas))) == 1
    assert sorted(tuple(r) for r in areas.collect()) == [
        (2022, "1", None, "Land", "l.xml"), (2022, "1", None, "R", "r.xml"), (2022, "7", "1", "Del", "d.xml")
    ]
    assert [r.file for r in counts.read_manifest(spark, str(tmp_path), "land", nth=1).collect()] == ["r.xml"]


def test_row_order_of_a_whole_table(spark):
    names = ["Zoe", "Ærø", "Aabenraa", "Ål", "Anna", "Øst"] * 3
    df = spark.createDataFrame([(n,) for n in names], "n STRING").repartition(4)
    out = grouping.split_row_order(df, [reshape.danish_order(F.col("n")), F.col("n")], "place").collect()
    assert sorted(r.place for r in out) == list(range(1, 19))
    assert [r.n for r in sorted(out, key=lambda r: r.place)][::3] == ["Anna", "Zoe", "Ærø", "Øst", "Aabenraa", "Ål"]


def test_nested_matrix_has_the_columns_of_its_key(spark):
    cells = spark.createDataFrame(
        [("k1", 2, "A", "5"), ("k1", 1, "B", "(1) 9"), ("k1", 1, "A", "(2) 8"), ("k2", 1, "C", "3")],
        "k STRING, d INT, party STRING, cell STRING",
    )
    got = {r.k: [(x.d, x.cells) for x in r.rows] for r in reshape.nested_matrix(cells, ["k"], "d", "party", "cell").collect()}
    assert got == {"k1": [(1, {"A": "(2) 8", "B": "(1) 9"}), (2, {"A": "5"})], "k2": [(1, {"C": "3"})]}
