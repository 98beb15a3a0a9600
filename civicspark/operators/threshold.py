"""Electoral thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _above(left, right, inclusive: bool):
    return left >= right if inclusive else left > right


def seat_rule(won: DataFrame, keys: Sequence[str], party: str) -> DataFrame:
    """Rule 1: the party has at least one constituency seat (``won`` per row)."""
    seats = F.sum("won").cast("int")
    return won.groupBy(*keys, party).agg(
        (seats > 0).alias("seat_rule"), seats.alias("constituency_seats")
    )


def region_rule(
    regional: DataFrame,
    region_seats: DataFrame,
    keys: Sequence[str],
    region: str,
    party: str,
    min_regions: int = 2,
    inclusive: bool = False,
) -> DataFrame:
    """Rule 2: above the region's votes per constituency seat in enough regions."""
    total = F.sum("votes").over(Window.partitionBy(*keys, region))
    per_seat = regional.withColumn("__total", total).join(region_seats, region, "left")
    bar = F.try_divide(F.col("__total"), F.col("region_seats"))
    over = F.coalesce(_above(F.col("votes"), bar, inclusive), F.lit(False))
    return per_seat.groupBy(*keys, party).agg(
        F.count_if(over).cast("int").alias("regions_over")
    ).withColumn("region_rule", F.col("regions_over") >= min_regions)


def share_rule(
    national: DataFrame,
    keys: Sequence[str],
    share: float = 2.0,
    inclusive: bool = False,
) -> DataFrame:
    """Rule 3: national vote share above ``share`` per cent."""
    total = F.sum("votes").over(Window.partitionBy(*keys))
    percent = F.try_divide(F.col("votes"), total) * 100
    over = F.coalesce(_above(F.col("share_pct"), F.lit(share), inclusive), F.lit(False))
    return national.withColumn("share_pct", percent).withColumn("share_rule", over)


def threshold(
    national: DataFrame,
    regional: DataFrame,
    won: DataFrame,
    region_seats: DataFrame,
    keys: Sequence[str],
    region: str = "region_id",
    party: str = "party",
    share: float = 2.0,
    min_regions: int = 2,
    inclusive: bool = False,
) -> DataFrame:
    """Every party with its three rule results and ``qualified``, true if any holds.

    A rule without input for a party counts as not met, so each party is over or under.
    """
    on = [*keys, party]
    rules = ["seat_rule", "region_rule", "share_rule"]
    merged = (
        share_rule(national, keys, share, inclusive)
        .join(seat_rule(won, keys, party), on, "left")
        .join(
            region_rule(regional, region_seats, keys, region, party, min_regions, inclusive),
            on,
            "left",
        )
        .withColumns({r: F.coalesce(r, F.lit(False)) for r in rules})
        .withColumns(
            {c: F.coalesce(c, F.lit(0)) for c in ("constituency_seats", "regions_over")}
        )
    )
    return merged.withColumn(
        "qualified", F.col("seat_rule") | F.col("region_rule") | F.col("share_rule")
    )
