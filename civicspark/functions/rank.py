"""Ranks as column expressions, for groups whose size is bounded by a catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ordered(column: str | Column, ascending: bool = False) -> Column:
    """Sort expression that keeps NULL behind every value."""
    column = F.col(column) if isinstance(column, str) else column
    return column.asc_nulls_last() if ascending else column.desc_nulls_last()


def avg_rank(column: str | Column, keys: Sequence[str], ascending: bool = False) -> Column:
    """Rank where tied rows share the mean of their positions; NULL ranks NULL.

    Both terms use one window specification, so the plan has one sort.
    """
    value = F.col(column) if isinstance(column, str) else column
    window = Window.partitionBy(*keys).orderBy(ordered(value, ascending))
    upto = window.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(
        value.isNotNull(), (F.rank().over(window) + F.count(F.lit(1)).over(upto)) / 2
    )


def tie_rank(
    column: str | Column,
    keys: Sequence[str],
    ties: str = "average",
    tiebreak: Sequence[str | Column] = (),
    ascending: bool = False,
) -> Column:
    """Rank with a chosen treatment of ties: ``average``, ``dense``, ``min`` or ``first``."""
    value = F.col(column) if isinstance(column, str) else column
    if ties == "average":
        return avg_rank(value, keys, ascending)
    window = Window.partitionBy(*keys).orderBy(ordered(value, ascending))
    if ties == "dense":
        rank = F.dense_rank().over(window)
    elif ties == "min":
        rank = F.rank().over(window)
    elif ties == "first":
        window = Window.partitionBy(*keys).orderBy(ordered(value, ascending), *tiebreak)
        rank = F.row_number().over(window)
    else:
        raise ValueError(f"unknown ties: {ties}")
    return F.when(value.isNotNull(), rank)
