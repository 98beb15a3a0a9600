"""Hierarchy, bridge and polygon queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from civicspark.functions.text import area_name
from civicspark.operators import geo
from civicspark.plans.apportionment import CONSTITUENCY_WON
from civicspark.plans.elections import constituency_seats
from civicspark.plans.registry import query


def area_levels(t):
    """Region, constituency, district (customer) and polling area (order), each with its parent."""
    return [
        t("region").select(F.col("r_regionkey").alias("region_id")),
        t("nation").select(
            F.col("n_regionkey").alias("region_id"), F.col("n_nationkey").alias("constituency_id")
        ),
        t("customer").select(
            F.col("c_nationkey").alias("constituency_id"), F.col("c_custkey").alias("district_id")
        ),
        t("orders").select(
            F.col("o_custkey").alias("district_id"), F.col("o_orderkey").alias("polling_area_id")
        ),
    ]


HIERARCHY = """
SELECT r_regionkey AS region_id, n_nationkey AS constituency_id, c_custkey AS district_id,
       o_orderkey AS polling_area_id
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
     LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey"""


@query("geo_hierarchy", HIERARCHY)
def geo_hierarchy(t):
    return geo.hierarchy(area_levels(t))


@query("geo_pairs", f"SELECT DISTINCT constituency_id, district_id FROM ({HIERARCHY}) h")
def geo_pairs(t):
    _, constituencies, districts, _ = area_levels(t)
    two = geo.hierarchy([constituencies.select("constituency_id"), districts])
    return geo.level_pairs(two, "constituency_id", "district_id")


def districts(t):
    """Every customer as a nomination district with two municipalities."""

    def municipality(offset: int):
        number = (F.col("c_custkey") + offset) % 900 + 100
        code = F.concat(F.lit("0"), number.cast("string"))
        return F.struct(code.alias("kode"), F.concat(F.lit("M"), code).alias("navn"))

    return t("customer").select(
        F.col("c_nationkey").alias("constituency_id"),
        F.array(municipality(0), municipality(450)).alias("kommuner"),
    )


BRIDGE = """
bridge AS (SELECT DISTINCT c_nationkey AS constituency_id,
                  right('0' || CAST((c_custkey + o) % 900 + 100 AS VARCHAR), 3) AS area_code
           FROM customer, (VALUES (0), (450)) x(o))
"""


@query("geo_bridge", f"WITH {BRIDGE} SELECT * FROM bridge")
def geo_bridge(t):
    return geo.area_bridge(districts(t), "kommuner", "kode", ["constituency_id"])


@query("population_rollup", f"""
WITH {BRIDGE},
pop AS (SELECT CAST(s_suppkey * 7 % 1100 + 50 AS VARCHAR) AS area_code, s_suppkey * 11 + 500 AS population FROM supplier)
SELECT constituency_id, sum(population)::BIGINT AS population
FROM pop LEFT JOIN bridge USING (area_code) WHERE constituency_id IS NOT NULL GROUP BY 1""")
def population_rollup(t):
    population = t("supplier").select(
        (F.col("s_suppkey") * 7 % 1100 + 50).cast("string").alias("area_code"),
        (F.col("s_suppkey") * 11 + 500).alias("population"),
    )
    return geo.population_rollup(
        population, geo_bridge(t), "area_code", ["constituency_id"], "population"
    )


def boundaries(t):
    """Every customer as a municipality: a box, every fifth with a square hole, every
    seventh with an island of one by one degree four degrees further north."""
    key = F.col("c_custkey")
    x, y = (key % 340 - 170).cast("double"), (key % 120 - 60).cast("double")
    w, h = (key % 3 + 1).cast("double"), (key % 2 + 1).cast("double")

    def box(x0, y0, width, height, clockwise=False):
        corners = [(x0, y0), (x0 + width, y0), (x0 + width, y0 + height), (x0, y0 + height)]
        closed = [*corners, corners[0]]
        return F.array(*[F.array(*p) for p in (closed[::-1] if clockwise else closed)])

    outer = box(x, y, w, h)
    hole = box(x + 0.25, y + 0.25, F.lit(0.5), F.lit(0.5), clockwise=True)
    island = F.array(box(x, y + 4, F.lit(1.0), F.lit(1.0)))
    main = F.when(key % 5 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return t("customer").select(
        key.alias("area_id"),
        F.col("c_name").alias("name"),
        F.when(key % 7 == 0, F.array(main, island)).otherwise(F.array(main)).alias("polygons"),
    )


BOXES = """
box AS (SELECT c_custkey AS area_id, (c_custkey % 340 - 170)::DOUBLE AS x, (c_custkey % 120 - 60)::DOUBLE AS y,
               (c_custkey % 3 + 1)::DOUBLE AS w, (c_custkey % 2 + 1)::DOUBLE AS h, c_custkey % 5 = 0 AS hole,
               c_custkey % 7 = 0 AS island
        FROM customer)
"""


@query("polygon_area", f"""
WITH {BOXES}
SELECT area_id, round(6371.01 * 6371.01 * (
         radians(w) * (sin(radians(y + h)) - sin(radians(y)))
         - CASE WHEN hole THEN radians(0.5) * (sin(radians(y + 0.75)) - sin(radians(y + 0.25))) ELSE 0 END
         + CASE WHEN island THEN radians(1) * (sin(radians(y + 5)) - sin(radians(y + 4))) ELSE 0 END
       ), 4) AS area_km2 FROM box""")
def polygon_area(t):
    return boundaries(t).select(
        "area_id", F.round(geo.multi_polygon_area_km2(F.col("polygons")), 4).alias("area_km2")
    )


@query("polygon_centroid", f"""
WITH {BOXES},
m AS (SELECT *, w * h AS a, CASE WHEN hole THEN 0.25 ELSE 0 END AS b, CASE WHEN island THEN 1.0 ELSE 0 END AS c FROM box)
SELECT area_id, round((a * (x + w / 2) - b * (x + 0.5) + c * (x + 0.5)) / (a - b + c), 6) AS lon,
       round((a * (y + h / 2) - b * (y + 0.5) + c * (y + 4.5)) / (a - b + c), 6) AS lat FROM m""")
def polygon_centroid(t):
    centre = geo.multi_polygon_centroid(F.col("polygons"))
    return (
        boundaries(t)
        .select("area_id", centre.alias("c"))
        .select("area_id", F.round("c.x", 6).alias("lon"), F.round("c.y", 6).alias("lat"))
    )


@query("choropleth", f"""
WITH {CONSTITUENCY_WON.format(votes="fx_party_votes")},
s AS (SELECT *, won / sum(won) OVER (PARTITION BY election_id, constituency_id) AS share,
             max(won) OVER (PARTITION BY election_id, constituency_id) AS top FROM cwon)
SELECT n_name AS name, n_nationkey AS area_id, election_id, party, won, share
FROM nation LEFT JOIN s ON n_nationkey = constituency_id AND won = top""")
def choropleth(t):
    won = constituency_seats(t.party_votes(), t.seats()).select(
        "election_id", "constituency_id", "party", "won"
    )
    cell = ["election_id", "constituency_id"]
    shares = won.withColumn(
        "share", F.try_divide(F.col("won"), F.sum("won").over(Window.partitionBy(*cell)))
    )
    top = F.max("won").over(Window.partitionBy(*cell))
    titles = t("nation").select(
        F.col("n_nationkey").alias("constituency_id"),
        F.concat("n_name", F.lit("s Storkreds")).alias("title"),
    )
    leading = (
        shares.withColumn("top", top)
        .where(F.col("won") == F.col("top"))
        .join(titles, "constituency_id")
        .withColumn("name", area_name(F.col("title")))
        .select("name", "election_id", "party", "won", "share")
    )
    shapes = t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("area_id"))
    return shapes.join(leading, "name", "left")


@query("area_name_clean", """
SELECT c_custkey AS area_id, c_name || 's Storkreds' AS title, c_name AS name FROM customer""")
def area_name_clean(t):
    titled = t("customer").select(
        F.col("c_custkey").alias("area_id"), F.concat("c_name", F.lit("s Storkreds")).alias("title")
    )
    return titled.withColumn("name", area_name(F.col("title")))
