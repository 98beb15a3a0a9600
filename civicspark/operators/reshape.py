"""Reshaping for report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quotient_matrix(
    cells: DataFrame, rows: Sequence[str], column: str, value: str, names: Sequence
) -> DataFrame:
    """Wide table with one column per named value (the names are given, so Spark needs
    no extra pass to find them). A value that is not named fails the query."""
    known = F.col(column).isin(list(names)) | F.col(column).isNull()
    message = F.concat(F.lit("no column for "), F.col(column).cast("string"))
    cells = cells.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(message)))
    return cells.groupBy(*rows).pivot(column, list(names)).agg(F.first(value))


def winning_cells(cells: DataFrame, row: Column, column: Column, won: str = "won") -> DataFrame:
    """Positions of the winning cells, kept long instead of searching a wide matrix."""
    return cells.where(F.col(won)).withColumn("row", row).withColumn("col", column)


def marked_quotient(won: Column, rank: Column, quotient: Column) -> Column:
    """``(rank) quotient`` for winners, the quotient alone otherwise."""
    return F.when(won, F.concat(F.lit("("), rank, F.lit(") "), quotient)).otherwise(quotient)


def nested_matrix(
    cells: DataFrame, keys: Sequence[str], row: str, column: str, value: str, out: str = "rows"
) -> DataFrame:
    """One row per key with its own table: ``out`` is an array of (row, cells) in row order.

    ``cells`` maps the key's columns to values, in column order, so that each key has only the
    columns it uses. Meant for keys whose table a ballot bounds, such as a constituency.
    """
    pair = F.sort_array(F.collect_list(F.struct(column, value)))
    lines = cells.groupBy(*keys, row).agg(F.map_from_entries(pair).alias("cells"))
    return lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(row, "cells")), _by_first(row)).alias(out))


def _by_first(name: str):
    """Structs in the order of one field; maps beside it cannot be compared."""
    return lambda a, b: F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(0)


def totals_row(
    df: DataFrame, group: str, label: str, sums: Mapping[str, str], keys: Sequence[str] = ()
) -> DataFrame:
    """Rows per group plus one labelled total row per key, in one aggregation."""
    keys = list(keys)
    sets = [[F.col(c) for c in [*keys, group]], [F.col(c) for c in keys]]
    grouped = df.groupingSets(sets, *keys, group).agg(
        F.grouping(group).alias("__total"),
        *[F.sum(source).alias(name) for name, source in sums.items()],
    )
    return grouped.withColumn(
        group, F.when(F.col("__total") == 1, F.lit(label)).otherwise(F.col(group))
    ).drop("__total")


def member_text(
    df: DataFrame, keys: Sequence[str], member: str, out: str = "members", distinct: bool = True
) -> DataFrame:
    """Members of each group in one line, in name order, and their number.

    ``distinct=False`` keeps a name as often as it comes, for namesakes. A group's line is one
    value: meant for groups of a bounded number of members, such as a party's elected persons.
    """
    members = df.select(*keys, member)
    members = members.distinct() if distinct else members
    grouped = members.groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("__names"))
    return grouped.select(
        *keys,
        F.array_join("__names", ", ").alias(out),
        F.size("__names").alias(f"n_{out}"),
    )


def group_lines(members: DataFrame, group: str, text: str, separator: str = "<br>") -> DataFrame:
    """All groups in one text, ``group: members`` per line in group order."""
    lines = F.sort_array(F.collect_list(F.struct(group, text)))
    joined = F.transform(lines, lambda x: F.concat_ws(": ", x[group], x[text]))
    return members.agg(F.array_join(joined, separator).alias("lines"))


def selected_first(column: Column, selected: Sequence) -> Column:
    """Sort key that puts the listed values first, in their order."""
    position = F.array_position(F.array(*[F.lit(s) for s in selected]), column)
    return F.when(position > 0, position).otherwise(len(selected) + 1)


def danish_order(column: Column) -> Column:
    """Sort expression in Danish alphabetical order."""
    return F.collate(column, "da")


def danish_rank(column: str, keys: Sequence[str]) -> Column:
    """Place in Danish alphabetical order within a key whose size a catalogue bounds, such as a
    ballot; names that collate alike go by their code points. For whole tables see
    ``grouping.split_row_order``."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(danish_order(F.col(column)), column))


def scalar_column(df: DataFrame, name: str, scalar: DataFrame) -> DataFrame:
    """Attach a one-row, one-column aggregate to every row as a scalar subquery."""
    return df.withColumn(name, scalar.scalar())


def repeat_rows(df: DataFrame, times: Column, index: str) -> DataFrame:
    """Repeat each row ``times`` times with a running index from 1."""
    return df.withColumn(index, F.explode(F.when(times >= 1, F.sequence(F.lit(1), times))))


def nest(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """One row per key with the other columns as an array of structs.

    Meant for keys with few rows each, such as the parties of a constituency.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias(out))


def unnest(df: DataFrame, column: str) -> DataFrame:
    """Undo ``nest``."""
    keys = [c for c in df.columns if c != column]
    return df.select(*keys, F.inline(column))
