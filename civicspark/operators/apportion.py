"""Seat apportionment: highest averages, alliances and largest remainders.

Inputs are tallies (one row per unit of a group), so a window over a group sees as many
rows as the ballot has parties, however many raw rows were counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.rank import tie_rank
from civicspark.operators.grouping import null_safe_join


def _column(value: int | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def divisor_table(
    df: DataFrame, keys: Sequence[str], count: int | str | Column, step: int | str = 1
) -> DataFrame:
    """Divisors 1, 1+step, 1+2*step, … for each key, ``count`` of them."""
    step = _column(step)
    last = (1 + step * (_column(count) - 1)).cast("int")
    numbers = F.when(last >= 1, F.sequence(F.lit(1), last, step))
    return df.select(*keys, F.explode(numbers).alias("divisor"))


def divisors_needed(
    votes: Column, total: Column, units: Column, seats: Column, step: int, rounded: bool
) -> Column:
    """How many divisors of a unit can reach a seat.

    At the level m = V / (step*S + P) all units together have more than S quotients, so
    no quotient below m wins. Rounding moves a quotient by at most a half on both sides
    of the cut, hence the level one lower. One spare divisor covers float error.
    """
    level = F.try_divide(total.cast("double"), seats * step + units)
    if rounded:
        level = level - 1
    reach = F.floor((F.try_divide(votes.cast("double"), level) + (step - 1)) / step) + 1
    bounded = F.when(level > 0, F.least(reach, seats)).otherwise(seats)
    return F.greatest(bounded, F.lit(1)).cast("int")


def highest_averages(
    df: DataFrame,
    keys: Sequence[str],
    unit: str | Sequence[str],
    votes: str,
    seats: int | str,
    step: int = 1,
    round_quotient: bool = False,
    ties: str = "average",
    prune: bool = True,
    detail: bool = False,
    divisors: int | str | None = None,
) -> DataFrame:
    """Divisor apportionment of ``seats`` within each key group.

    ``ties="average"`` gives tied quotients their mean rank, so a two-way tie for the
    last seat leaves it open; ``"first"`` breaks ties by votes and unit and always fills.
    ``detail`` returns every quotient with ``divisor``, ``quotient``, ``rank``, ``won``;
    otherwise one row per unit with ``won``. ``divisors`` sets the number of divisors
    per unit outright (full ranking tables).
    """
    keys = list(keys)
    unit = [unit] if isinstance(unit, str) else list(unit)
    seat_count = _column(seats).cast("int")
    group = Window.partitionBy(*keys)
    if divisors is not None:
        count = F.greatest(_column(divisors).cast("int"), F.lit(1))
    elif prune:
        count = divisors_needed(
            F.col(votes),
            F.sum(votes).over(group),
            F.count(F.lit(1)).over(group),
            seat_count,
            step,
            round_quotient,
        )
    else:
        count = F.greatest(seat_count, F.lit(1))
    numbers = F.sequence(F.lit(1), 1 + step * (count - 1), F.lit(step))
    quotient = F.col(votes) / F.col("divisor")
    if round_quotient:
        quotient = F.bround(quotient, 0)
    ranked = (
        df.withColumn("__divisors", numbers)
        .withColumn("divisor", F.explode("__divisors"))
        .drop("__divisors")
        .withColumn("quotient", quotient)
        .withColumn(
            "rank", tie_rank("quotient", keys, ties, [F.col(votes).desc(), *unit])
        )
        .withColumn("won", F.col("rank") <= seat_count)
    )
    if detail:
        return ranked
    kept = [c for c in df.columns if c not in (*keys, *unit)]
    # grouping by a superset of the window keys reuses the window's partitioning
    return ranked.groupBy(*keys, *unit).agg(
        *[F.first(c).alias(c) for c in kept],
        F.coalesce(F.sum(F.col("won").cast("int")), F.lit(0)).cast("int").alias("won"),
    )


def seats_and_share(
    df: DataFrame, keys: Sequence[str], unit: Sequence[str], votes: str, won: str = "won"
) -> DataFrame:
    """Roll quotient rows up to seats per unit, with the share of the group's votes."""
    units = df.groupBy(*keys, *unit).agg(
        F.max(votes).alias(votes),
        F.coalesce(F.sum(F.col(won).cast("int")), F.lit(0)).cast("int").alias("seats"),
    )
    share = F.try_divide(F.col(votes), F.sum(votes).over(Window.partitionBy(*keys)))
    return units.withColumn("share", share)


def alliance_seats(
    df: DataFrame,
    keys: Sequence[str],
    alliance: str,
    votes: str,
    seats: int | str,
    ties: str = "average",
    detail: bool = False,
) -> DataFrame:
    """First stage: pool the votes of each alliance (NULL is one pool) and apportion."""
    carried = [F.max(seats).alias(seats)] if isinstance(seats, str) else []
    pooled = df.groupBy(*keys, alliance).agg(F.sum(votes).alias("alliance_votes"), *carried)
    return highest_averages(
        pooled, keys, alliance, "alliance_votes", seats, ties=ties, detail=detail,
        prune=not detail,
    )


def alliance_party_quotients(
    df: DataFrame,
    keys: Sequence[str],
    party: str,
    alliance: str,
    votes: str,
    seats: int | str,
    ties: str = "average",
    full: bool = True,
) -> DataFrame:
    """Second stage: quotients inside each alliance for the seats it won.

    With ``full`` every party gets as many divisors as the election's largest alliance
    has seats (the complete ranking); otherwise only those that can win.
    """
    first = alliance_seats(df, keys, alliance, votes, seats, ties).select(
        *keys, alliance, "alliance_votes", F.col("won").alias("alliance_seats")
    )
    upto = None
    if full:
        first = first.withColumn(
            "__upto", F.max("alliance_seats").over(Window.partitionBy(*keys))
        )
        upto = "__upto"
    parties = null_safe_join(df, first, [*keys, alliance])
    return highest_averages(
        parties, [*keys, alliance], party, votes, "alliance_seats", ties=ties, detail=True,
        divisors=upto,
    ).drop("__upto")


def alliance_party_seats(
    df: DataFrame,
    keys: Sequence[str],
    party: str,
    alliance: str,
    votes: str,
    seats: int | str,
    ties: str = "average",
) -> DataFrame:
    """Seats and vote share per party after both stages."""
    quotients = alliance_party_quotients(df, keys, party, alliance, votes, seats, ties, full=False)
    return seats_and_share(quotients, keys, [alliance, party], votes)


def seat_order(quotients: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order in which seats were won, from second-stage quotients with ``rank``."""
    order_key = F.try_divide(F.col("alliance_votes"), F.col("rank"))
    return quotients.withColumn("order_key", order_key).withColumn(
        "overall_rank", tie_rank("order_key", keys, "dense")
    )


def alliance_effect(
    df: DataFrame,
    keys: Sequence[str],
    party: str,
    alliance: str,
    votes: str,
    seats: int | str,
    ties: str = "average",
) -> DataFrame:
    """Seats per party with and without alliances, and whether they differ."""
    pooled = alliance_party_seats(df, keys, party, alliance, votes, seats, ties).select(
        *keys, party, "share", F.col("seats").alias("with_alliance")
    )
    alone = highest_averages(df, keys, party, votes, seats, ties=ties).select(
        *keys, party, F.col("won").alias("without_alliance")
    )
    return pooled.join(alone, [*keys, party], "left").withColumn(
        "differs", F.col("with_alliance") != F.col("without_alliance")
    )


def largest_remainder(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    weight: str,
    seats: int | str,
    ties: str = "average",
    detail: bool = False,
    out: str = "seats",
) -> DataFrame:
    """Hare quota: whole quotas first, the rest by largest fraction.

    ``ties`` picks the rank of equal fractions: ``average`` and ``dense`` may leave a
    seat open or overfill, ``first`` (by weight, unit) always fills exactly.
    """
    keys = list(keys)
    group = Window.partitionBy(*keys)
    total = _column(seats)
    quota = F.try_divide(F.sum(weight).over(group).cast("double"), total.cast("double"))
    exact = df.withColumn("exact", F.try_divide(F.col(weight).cast("double"), quota))
    split = (
        exact.withColumn("floor", F.floor("exact").cast("int"))
        .withColumn("fraction", F.col("exact") - F.col("floor"))
        .withColumn("rest", (total - F.sum("floor").over(group)).cast("int"))
        .withColumn(
            "fraction_rank",
            tie_rank("fraction", keys, ties, [F.col(weight).desc(), F.col(unit)]),
        )
    )
    extra = (F.col("fraction_rank") <= F.col("rest")).cast("int")
    done = split.withColumn(out, F.coalesce(F.col("floor") + extra, F.lit(0)).cast("int"))
    return done if detail else done.drop("exact", "floor", "fraction", "rest", "fraction_rank")


def nested_remainder(
    df: DataFrame,
    keys: Sequence[str],
    region: str,
    unit: str,
    weight: str,
    seats: int | str,
    ties: tuple[str, str] = ("dense", "dense"),
) -> DataFrame:
    """Largest remainder over regions, then inside each region over its units."""
    keys = list(keys)
    carried = [F.max(seats).alias(seats)] if isinstance(seats, str) else []
    regions = df.groupBy(*keys, region).agg(F.sum(weight).alias("region_weight"), *carried)
    upper = largest_remainder(
        regions, keys, region, "region_weight", seats, ties[0], out="region_seats"
    ).select(*keys, region, "region_weight", "region_seats")
    return largest_remainder(
        df.join(upper, [*keys, region]), [*keys, region], unit, weight, "region_seats", ties[1]
    )


def largest_remainder_with_floor(
    df: DataFrame,
    keys: Sequence[str],
    region: str,
    unit: str,
    weight: str,
    seats: int,
    minimum: int,
    guarded: Sequence | None = None,
    ties: tuple[str, str] = ("dense", "dense"),
) -> DataFrame:
    """Nested remainder where a unit below ``minimum`` gets the minimum up front.

    The other units share what is left, once. ``guarded`` limits the guarantee to the
    listed units. Groups without such a unit keep the first result.
    """
    keys = list(keys)
    first = nested_remainder(df, keys, region, unit, weight, seats, ties)
    short = F.col("seats") < minimum
    if guarded is not None:
        short = short & F.col(unit).isin(list(guarded))
    flagged = first.select(*keys, region, unit, weight, short.alias("guaranteed")).withColumn(
        "__seats",
        F.lit(seats)
        - minimum * F.sum(F.col("guaranteed").cast("int")).over(Window.partitionBy(*keys)),
    )
    others = nested_remainder(
        flagged.where(~F.col("guaranteed")), keys, region, unit, weight, "__seats", ties
    )
    fixed = flagged.where("guaranteed").select(
        *keys, region, unit, weight, "guaranteed", F.lit(minimum).alias("seats")
    )
    return others.select(*fixed.columns).unionByName(fixed)


def apportion_weight(
    df: DataFrame,
    population: str = "population",
    voters: str = "voters",
    area_km2: str = "area_km2",
    area_factor: int = 20,
    out: str = "weight",
) -> DataFrame:
    """Weight of an area: population + voters + factor × square kilometres."""
    return df.withColumn(out, F.col(population) + F.col(voters) + area_factor * F.col(area_km2))


def levelling_pool(
    df: DataFrame,
    keys: Sequence[str],
    region: str,
    unit: str,
    weight: str,
    total_seats: int,
    unit_seats: int,
) -> DataFrame:
    """Compensatory seats per region: its share of all seats minus its units' seats."""
    keys = list(keys)
    placed = nested_remainder(df, keys, region, unit, weight, unit_seats)
    below = placed.groupBy(*keys, region).agg(F.sum("seats").cast("int").alias("unit_seats"))
    regions = df.groupBy(*keys, region).agg(F.sum(weight).alias("region_weight"))
    return (
        largest_remainder(regions, keys, region, "region_weight", total_seats, out="region_seats")
        .join(below, [*keys, region], "left")
        .withColumn("pool", F.col("region_seats") - F.col("unit_seats"))
    )
