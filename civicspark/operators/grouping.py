"""Group-wise operators that never hold one group in one task.

Window functions put a whole group into a single task. That is fine where a group is
bounded by a catalogue (parties of an election), not where it grows with the rows. The
operators here aggregate with map-side combine and join the small result back, which
AQE can split when a key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.rank import ordered
from civicspark.session import materialize


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join in which NULL keys match NULL keys; key columns come from the left."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in on], *[c for c in right.columns if c not in on]
    )
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in on]
    )
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in on])


def with_group_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add whole-group aggregates to every row (partial aggregation, then a join)."""
    stats = df.groupBy(*keys).agg(*[column.alias(name) for name, column in aggs.items()])
    return null_safe_join(df, stats, keys)


def group_max_rows(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows that hold their group's maximum, ties kept.

    The join is on key and value, so a hot key spreads over its values.
    """
    top = df.groupBy(*keys).agg(F.max(column).alias(column))
    return null_safe_join(df, top, [*keys, column], "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a declared total order, by map-side combined minimum."""
    rest = [c for c in df.columns if c not in keys]
    lead = list(order) + [c for c in rest if c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*lead)).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def duplicate_flag(df: DataFrame, keys: Sequence[str], row_id: str, flag: str) -> DataFrame:
    """True for the second and later rows of a key, in ``row_id`` order.

    Rows with a NULL key count as duplicates of each other.
    """
    marked = with_group_stats(df, keys, __first=F.min(row_id))
    return marked.withColumn(flag, F.col(row_id) > F.col("__first")).drop("__first")


def topk_per_group(
    df: DataFrame, keys: Sequence[str], order: str, k: int, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """The k first rows per key by ``order`` descending.

    A literal k lets Spark cut each partition to k rows per key before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(ordered(order), *tiebreak)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` cut into ranges of keys and ``order``, numbered by ``__part`` and written.

    The ranges hold about equally many rows whatever the values, so a hot key spans as many
    of them as it needs. The written table fixes which row is in which range.
    """
    by = [*(ordered(k, ascending=True) for k in keys), *order]
    return materialize(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))


def _sums_before(
    placed: DataFrame, keys: Sequence[str], order: Sequence[Column], **values: Column
) -> DataFrame:
    """Adds the sums over all rows of the group that come before the row.

    Each range is summed up by itself and shifted by the totals of the ranges before it, of
    which a group has at most as many as there are partitions.
    """
    keys = list(keys)
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(*before)
    ranges = Window.partitionBy(*keys).orderBy("__part").rowsBetween(*before)
    zero = F.lit(0).cast("bigint")
    totals = placed.groupBy("__part", *keys).agg(
        *[F.sum(value).alias(f"__all_{name}") for name, value in values.items()]
    )
    shifts = totals.select(
        "__part",
        *keys,
        *[F.coalesce(F.sum(f"__all_{n}").over(ranges), zero).alias(f"__shift_{n}") for n in values],
    )
    local = placed.withColumns(
        {n: F.coalesce(F.sum(value).over(inside), zero) for n, value in values.items()}
    )
    shifted = null_safe_join(local, shifts, ["__part", *keys])
    return shifted.withColumns({n: F.col(n) + F.col(f"__shift_{n}") for n in values}).drop(
        "__part", *[f"__shift_{n}" for n in values]
    )


def split_rank(
    df: DataFrame, keys: Sequence[str], column: str, prefix: str = "rank"
) -> DataFrame:
    """Exact descending ranks by a column for groups of any size.

    Adds ``<prefix>_min``, ``<prefix>_avg`` and ``<prefix>_dense``; NULL values rank NULL.
    Equal values are counted first (map-side combine), so a hot value is one row; the counts
    are summed up in ranges, and the ranks joined back on key and value.
    """
    keys = list(keys)
    order = [ordered(column)]
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(
        F.count(F.lit(1)).alias("__n")
    )
    one = F.lit(1).cast("bigint")
    summed = _sums_before(_ranges(counts, keys, order), keys, order, __rows=F.col("__n"), __values=one)
    low = F.col("__rows") + 1
    ranks = summed.select(
        *keys,
        column,
        low.alias(f"{prefix}_min"),
        (low + (F.col("__n") - 1) / 2).alias(f"{prefix}_avg"),
        (F.col("__values") + 1).alias(f"{prefix}_dense"),
    )
    return null_safe_join(df, ranks, [*keys, column])


def split_row_number(
    df: DataFrame, keys: Sequence[str], column: str, row_id: str, out: str
) -> DataFrame:
    """Exact row numbers for groups of any size: largest value first, then ``row_id``.

    ``row_id`` is unique, so the ranges cut through a hot key and through a hot value too.
    """
    order = [ordered(column), ordered(row_id, ascending=True)]
    one = F.lit(1).cast("bigint")
    numbered = _sums_before(_ranges(df, keys, order), keys, order, **{out: one})
    return numbered.withColumn(out, F.col(out) + 1)


def split_row_order(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Row numbers of a whole table in a total order, such as a collation with a tiebreak."""
    placed = _ranges(df, [], order)
    one = F.lit(1).cast("bigint")
    return _sums_before(placed, [], order, **{out: one}).withColumn(out, F.col(out) + 1)


def placed_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` in ranges of keys and ``order``, with ``__pos``, a number that rises with both, and
    the range ``__part``; written, so that later readers agree. Rows alike in all of them are
    spread over ranges too."""
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order, F.col("__spread")]
    return materialize(
        df.withColumn("__spread", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("__spread")
        .withColumn("__pos", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__pos", 33))
    )


def carry_last(placed: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fills NULLs of ``columns`` with the last value before them in their key, over ``placed_rows``.

    Each range is filled by itself; what enters a range comes from a summary with one row per
    range and key, of which a key has at most as many as there are ranges.
    """
    keys = list(keys)
    summary = placed.groupBy("__part", *keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__pos"))).alias(f"__last_{c}") for c in columns]
    )
    ranges = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    entering = summary.select(
        "__part", *keys, *[F.last(f"__last_{c}", ignorenulls=True).over(ranges).alias(f"__in_{c}") for c in columns]
    )
    inside = Window.partitionBy("__part", *keys).orderBy("__pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = placed.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})
    joined = null_safe_join(filled, entering, ["__part", *keys])
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__in_{c}")) for c in columns}).drop(
        "__part", "__pos", *[f"__in_{c}" for c in columns]
    )
