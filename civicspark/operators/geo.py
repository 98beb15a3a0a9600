"""Geography: hierarchy, bridges, roll-ups and polygon measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: mean earth radius in kilometres.
EARTH_RADIUS_KM = 6371.01


def hierarchy(levels: Sequence[DataFrame]) -> DataFrame:
    """Join levels top-down on their shared id, keeping areas without children.

    Neighbouring levels share exactly one column, the parent's id. Which areas have
    children is known from the ids alone: the distinct parent ids of the next level. The others
    share a placeholder, a row without ids that the next level is given, so each level is one
    inner join: a small side can be broadcast and a hot parent split, which an outer join that
    keeps the areas would not allow. Rows of a level without a parent id drop out.
    """
    chain = levels[0]
    for lower in levels[1:]:
        shared = [c for c in lower.columns if c in chain.columns]
        if len(shared) != 1:
            raise ValueError(f"levels must share one id column, found {shared}")
        (parent,) = shared
        own = [c for c in lower.columns if c != parent]
        parents = lower.select(F.col(parent).alias("__parent")).distinct()
        keyed = chain.join(parents, chain[parent] == parents["__parent"], "left")
        placeholder = lower.sparkSession.range(1).select(
            F.lit(None).cast(lower.schema[parent].dataType).alias("__child_of"),
            *[F.lit(None).cast(lower.schema[c].dataType).alias(c) for c in own],
        )
        children = (
            lower.where(F.col(parent).isNotNull())
            .select(F.col(parent).alias("__child_of"), *own)
            .unionByName(placeholder)
        )
        chain = keyed.join(children, keyed["__parent"].eqNullSafe(children["__child_of"])).drop(
            "__parent", "__child_of"
        )
    return chain


def level_pairs(table: DataFrame, *columns: str) -> DataFrame:
    """Distinct ids of the chosen levels."""
    return table.select(*columns).distinct()


def area_bridge(
    districts: DataFrame, municipalities: str, code: str, keep: Sequence[str]
) -> DataFrame:
    """District to municipality pairs out of an array column, keyed by the code's last
    three characters."""
    return (
        districts.select(*keep, F.explode(municipalities).alias("__m"))
        .select(*keep, F.right(F.col(f"__m.{code}"), F.lit(3)).alias("area_code"))
        .distinct()
    )


def population_rollup(
    population: DataFrame, bridge: DataFrame, on: str, to: Sequence[str], value: str
) -> DataFrame:
    """Sum a statistic to the bridge's areas; codes without a bridge row drop out."""
    return population.join(bridge, on).groupBy(*to).agg(F.sum(value).alias(value))


def _edges(ring: Column) -> Column:
    """Pairs (point, next point) of a closed ring."""
    follow = F.slice(ring, 2, F.size(ring) - 1)
    return F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), follow.alias("b"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def ring_area_km2(ring: Column) -> Column:
    """Signed area of a closed lon/lat ring on the sphere, counter-clockwise positive."""
    parts = F.transform(
        _edges(ring),
        lambda e: F.radians(e["b"][0] - e["a"][0])
        * (2 + F.sin(F.radians(e["a"][1])) + F.sin(F.radians(e["b"][1]))),
    )
    return _sum(parts) * F.lit(-(EARTH_RADIUS_KM**2) / 2)


def polygon_area_km2(rings: Column) -> Column:
    """Area of a polygon: its first ring minus the holes, whatever their direction.

    The whole polygon is one value, so there is no shuffle.
    """
    areas = F.transform(rings, lambda r, i: F.when(i == 0, 1).otherwise(-1) * F.abs(ring_area_km2(r)))
    return _sum(areas)


def _ring_moments(ring: Column) -> Column:
    """Doubled area and first moments of a ring, in one walk along its edges."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = a[0] * b[1] - b[0] * a[1]
        return F.struct(
            (acc["w"] + cross).alias("w"),
            (acc["x"] + cross * (a[0] + b[0])).alias("x"),
            (acc["y"] + cross * (a[1] + b[1])).alias("y"),
        )

    return F.aggregate(_edges(ring), zero, step)


def polygon_centroid(rings: Column) -> Column:
    """Planar centroid ``struct(x, y)``; holes subtract whatever their direction."""
    return multi_polygon_centroid(F.array(rings))


def multi_polygon_area_km2(polygons: Column) -> Column:
    """Area of all polygons of one place."""
    return _sum(F.transform(polygons, polygon_area_km2))


def multi_polygon_centroid(polygons: Column) -> Column:
    """Planar centroid ``struct(x, y)`` of all polygons of one place, weighted by their areas."""

    def total(moments: Column, part: str) -> Column:
        def of_polygon(polygon: Column) -> Column:
            return _sum(
                F.transform(
                    polygon,
                    lambda m, i: F.when(i == 0, 1).otherwise(-1) * F.signum(m["w"]) * m[part],
                )
            )

        return _sum(F.transform(moments, of_polygon))

    def centre(moments: Column) -> Column:
        weight = 3 * total(moments, "w")
        return F.struct(
            F.try_divide(total(moments, "x"), weight).alias("x"),
            F.try_divide(total(moments, "y"), weight).alias("y"),
        )

    # a one-element array binds the moments, so that they are computed once
    moments = F.array(F.transform(polygons, lambda p: F.transform(p, _ring_moments)))
    return F.element_at(F.transform(moments, centre), 1)
