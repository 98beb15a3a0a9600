"""Lookups, patches and order-dependent fills."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.operators.grouping import carry_last, group_max_rows, placed_rows


def _lookup(df: DataFrame, lookup: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    right = lookup.select(
        *on, *[F.col(c).alias(f"__new_{c}") for c in cols], F.lit(True).alias("__hit")
    )
    return df.join(right, list(on), "left")


def patch_nulls(
    df: DataFrame, lookup: DataFrame, on: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Fill only the NULLs of ``cols`` from a lookup with one row per key."""
    order = df.columns
    filled = {c: F.coalesce(F.col(c), F.col(f"__new_{c}")) for c in cols}
    return _lookup(df, lookup, on, cols).withColumns(filled).select(*order)


def update_rows(
    df: DataFrame, patch: DataFrame, on: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Overwrite ``cols`` of the rows whose key is in ``patch``, also with NULL."""
    order = df.columns
    new = {c: F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in cols}
    return _lookup(df, patch, on, cols).withColumns(new).select(*order)


def value_recode(column: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep the others."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), column)


def rule_recode(rules: Sequence[tuple[Column, str, str]], default: Column) -> Column:
    """First rule whose pattern occurs in the lower-cased column wins."""
    out = None
    for column, needle, value in rules:
        hit = F.contains(F.lower(column), F.lit(needle))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return default if out is None else out.otherwise(default)


def locf(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    tiebreak: Sequence[str] = (),
    bucket: Column | None = None,
) -> DataFrame:
    """Carry the last non-NULL value forward within each key, NULL keys being one key.

    The table is cut into ranges of key and ``order``, so a hot key spans as many tasks as its
    rows need. ``bucket`` was the way to split a key by hand; it is no longer needed, changes nothing
    and is taken for the sake of older calls only.
    """
    placed = placed_rows(df, keys, [F.col(c).asc_nulls_first() for c in (order, *tiebreak)])
    return carry_last(placed, keys, columns).select(*df.columns)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    direction: str = "forward",
    bucket: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """For each left row the closest right row of the same key in time.

    ``forward`` takes the earliest right time at or after the left time, ``backward`` the
    latest at or before it. Both sides are merged into ranges of key and time, running
    towards the wanted direction; a left row takes the last right row before it in its range, or
    the one carried over from the ranges before. No pairs are built, each side is read once
    and no key or time is held by one task. NULL keys match NULL keys, a NULL time matches
    nothing. Of several right rows with one key and time the smallest is taken. ``bucket``
    changes nothing and is taken for the sake of older calls only.
    """
    on = list(on)
    payload = [c for c in right.columns if c not in on]
    rest = [c for c in left.columns if c not in on]
    best = (
        right.where(F.col(right_time).isNotNull())
        .groupBy(*on, F.col(right_time).alias("__t"))
        .agg(F.min(F.struct(*payload)).alias("__row"))
    )
    own = left.select(*on, F.col(left_time).alias("__t"), F.struct(*rest).alias("__own"))
    none = F.lit(None)
    merged = own.withColumn("__row", none.cast(best.schema["__row"].dataType)).unionByName(
        best.withColumn("__own", none.cast(own.schema["__own"].dataType))
    )
    time = F.col("__t").desc_nulls_last() if direction == "forward" else F.col("__t").asc_nulls_first()
    # a right row comes before a left row of the same time, whichever way the time runs
    placed = placed_rows(merged, on, [time, F.col("__own").isNotNull().asc()])
    found = carry_last(placed, on, ["__row"]).where(F.col("__own").isNotNull())
    row = F.when(F.col("__t").isNotNull(), F.col("__row"))
    return found.select(
        *[F.col(c) if c in on else F.col("__own")[c].alias(c) for c in left.columns],
        *[row[c].alias(c) for c in payload],
    )


def dedup_gazetteer(
    cities: DataFrame, used: DataFrame, name: str = "name", population: str = "population"
) -> DataFrame:
    """The most populous place of each name in use, ties kept."""
    wanted = cities.join(used.select(name).distinct(), name, "left_semi")
    return group_max_rows(wanted, [name], population)


def unmatched_keys(df: DataFrame, dimension: DataFrame, column: str, key: str) -> DataFrame:
    """Distinct non-NULL values of ``column`` that the dimension does not have."""
    wanted = df.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct()
    return wanted.join(dimension.select(key), key, "left_anti")


def upsert_dimension(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append new dimension rows, without exact repeats."""
    return old.unionByName(new, allowMissingColumns=True).distinct()


def official_names(
    places: DataFrame, name: str, status: str, secondary: str, official: str = "officielt"
) -> DataFrame:
    """The official name of each place: the primary one if official, else each official
    secondary name. Places without any keep a row with NULL."""
    alternatives = places.withColumn("__alt", F.explode_outer(secondary))
    chosen = F.when(F.col(status) == official, F.col(name)).when(
        F.col("__alt.navnstatus") == official, F.col("__alt.navn")
    )
    return alternatives.withColumn(name, chosen).drop("__alt", secondary, status)


def countdown(
    df: DataFrame, keys: Sequence[str], period: str, value: str, target: int
) -> DataFrame:
    """What the value of the latest period lacks to the target."""
    latest = F.max_by(value, period)
    return df.groupBy(*keys).agg(
        F.max(period).alias(period), (F.lit(target) - latest).cast("bigint").alias("missing")
    )
