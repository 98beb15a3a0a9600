"""Official statistics: table descriptions (JSON), decimal-comma CSV and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_INFO_SCHEMA = (
    "id STRING, variables ARRAY<STRUCT<id: STRING, text: STRING, time: BOOLEAN, "
    "values: ARRAY<STRUCT<id: STRING, text: STRING>>>>"
)
POLYGON = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
FEATURE_SCHEMA = (
    "type STRING, features ARRAY<STRUCT<type: STRING, properties: MAP<STRING, STRING>, "
    "geometry: STRUCT<type: STRING, coordinates: STRING>>>"
)


def read_table_info(spark: SparkSession, path: str) -> DataFrame:
    """Table descriptions, one JSON document per line."""
    return spark.read.schema(TABLE_INFO_SCHEMA).json(path)


def latest_period(info: DataFrame) -> DataFrame:
    """Largest value text of each table's time variable."""
    variables = info.select("id", F.explode("variables").alias("v")).where(F.col("v.time"))
    periods = variables.select("id", F.explode("v.values").alias("p"))
    return periods.groupBy("id").agg(F.max("p.text").alias("period"))


def read_decimal_comma(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``;`` separated text with ``.`` thousands and a decimal comma."""
    return (
        spark.read.schema(schema)
        .option("sep", ";")
        .option("header", "true")
        .option("locale", "da-DK")
        .csv(path)
    )


def read_features(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Features with their properties and polygons, each an array of rings.

    A ``Polygon`` is one polygon, a ``MultiPolygon`` any number; a feature without geometry
    has none (null), other geometries raise an error. ``multi_line=False`` reads one
    collection per line, which splits large files.
    """
    collections = (
        spark.read.schema(FEATURE_SCHEMA).option("multiLine", str(multi_line).lower()).json(path)
    )
    return collections.select(F.explode("features").alias("f")).select(
        F.col("f.properties").alias("properties"), _polygons(F.col("f.geometry")).alias("polygons")
    )


def _polygons(geometry: Column) -> Column:
    """Polygons of a geometry, whose coordinates nest three or four levels deep by its type."""
    kind, coordinates = geometry["type"], geometry["coordinates"]
    unknown = F.raise_error(F.concat(F.lit("unsupported geometry: "), F.coalesce(kind, F.lit("no type"))))
    return (
        F.when(kind == "Polygon", F.array(F.from_json(coordinates, POLYGON)))
        .when(kind == "MultiPolygon", F.from_json(coordinates, f"ARRAY<{POLYGON}>"))
        .when(geometry.isNotNull(), unknown)
    )


def ring_points(features: DataFrame, key: str) -> DataFrame:
    """One row per point with its polygon, ring and position."""
    return (
        features.select(key, F.posexplode("polygons").alias("polygon", "rings"))
        .select(key, "polygon", F.posexplode("rings").alias("ring", "points"))
        .select(key, "polygon", "ring", F.posexplode("points").alias("i", "point"))
        .select(key, "polygon", "ring", "i", F.col("point")[0].alias("lon"), F.col("point")[1].alias("lat"))
    )
