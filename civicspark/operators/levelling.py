"""Compensatory seats: party totals, placement in regions and in constituencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.rank import avg_rank


def entitlement(
    qualified: DataFrame, keys: Sequence[str], total_seats: int, won: str = "constituency_seats"
) -> DataFrame:
    """Exact entitlement of each qualifying party and whether it already holds more.

    ``triggered`` is true for the whole group as soon as one party holds more
    constituency seats than its rounded-down entitlement.
    """
    group = Window.partitionBy(*keys)
    quota = F.try_divide(F.sum("votes").over(group).cast("double"), F.lit(float(total_seats)))
    return (
        qualified.withColumn("quota", quota)
        .withColumn("entitled", F.try_divide(F.col("votes").cast("double"), F.col("quota")))
        .withColumn("over_represented", F.col(won) > F.floor("entitled"))
        .withColumn("triggered", F.bool_or("over_represented").over(group))
    )


def overhang_requota(
    entitled: DataFrame, keys: Sequence[str], total_seats: int, won: str = "constituency_seats"
) -> DataFrame:
    """Second quota without the parties that already hold their entitlement.

    Exclusion uses at-least, the trigger more-than. Untriggered groups keep the quota.
    """
    group = Window.partitionBy(*keys)
    full = F.col("triggered") & (F.col(won) >= F.floor("entitled"))
    left_votes = F.sum(F.when(~F.col("excluded"), F.col("votes"))).over(group).cast("double")
    held = F.coalesce(F.sum(F.when(F.col("excluded"), F.col(won))).over(group), F.lit(0))
    return (
        entitled.withColumn("excluded", full)
        .withColumn("held", held.cast("int"))
        .withColumn(
            "quota2",
            F.when(
                F.col("triggered"),
                F.try_divide(left_votes, (F.lit(total_seats) - F.col("held")).cast("double")),
            ).otherwise(F.col("quota")),
        )
        .withColumn(
            "entitled2",
            F.when(
                ~F.col("excluded"), F.try_divide(F.col("votes").cast("double"), F.col("quota2"))
            ),
        )
    )


def levelling_remainder(
    requota: DataFrame, keys: Sequence[str], total_seats: int
) -> DataFrame:
    """Whole entitlements, and the seats left over to the largest fractions."""
    group = Window.partitionBy(*keys)
    return (
        requota.withColumn("whole", F.floor("entitled2").cast("int"))
        .withColumn("fraction", F.col("entitled2") - F.col("whole"))
        .withColumn(
            "rest",
            (
                F.lit(total_seats)
                - F.col("held")
                - F.coalesce(F.sum("whole").over(group), F.lit(0))
            ).cast("int"),
        )
        .withColumn("fraction_rank", avg_rank("fraction", keys))
        .withColumn("remainder_seat", F.col("fraction_rank") <= F.col("rest"))
    )


def party_totals(remainder: DataFrame, won: str = "constituency_seats") -> DataFrame:
    """Compensatory seats per party (0 for excluded parties) and the total."""
    seats = F.col("whole") + F.col("remainder_seat").cast("int") - F.col(won)
    return remainder.withColumn(
        "levelling_seats", F.coalesce(seats, F.lit(0)).cast("int")
    ).withColumn("total_seats", (F.col("levelling_seats") + F.col(won)).cast("int"))


def levelling_totals(
    qualified: DataFrame, keys: Sequence[str], total_seats: int, won: str = "constituency_seats"
) -> DataFrame:
    """All four steps from qualifying parties to their compensatory and total seats."""
    steps = entitlement(qualified, keys, total_seats, won)
    steps = overhang_requota(steps, keys, total_seats, won)
    return party_totals(levelling_remainder(steps, keys, total_seats), won)


def divisor_count(
    used: str, owed: Column, bound: str, by: Sequence[str], divisors: str = "sufficient"
) -> Column:
    """How many divisors a party gets in an area.

    ``sufficient``: as many as it used and can still get there. ``reference``: the
    largest ``bound`` of any party in the area, where a leading party has none left to
    be placed with.
    """
    if divisors == "sufficient":
        return F.col(used) + owed
    if divisors == "reference":
        return F.max(bound).over(Window.partitionBy(*by))
    raise ValueError(f"unknown divisors: {divisors}")


def placement_quotients(
    votes: DataFrame,
    keys: Sequence[str],
    used: str,
    count: str | Column,
    step: int,
) -> DataFrame:
    """Quotients votes / (1, 1+step, …), ``count`` per row, the first ``used`` struck.

    Quotients of one party and area fall with the divisor, so the struck ones are the
    first ``used`` divisors and no ranking is needed. A struck quotient is NULL.
    """
    count = F.col(count) if isinstance(count, str) else count
    numbers = F.when(count >= 1, F.sequence(F.lit(1), count.cast("int")))
    return (
        votes.withColumn("__count", numbers)
        .withColumn("ordinal", F.explode("__count"))
        .drop("__count")
        .withColumn("divisor", 1 + step * (F.col("ordinal") - 1))
        .withColumn("struck", F.col("ordinal") <= F.col(used))
        .withColumn("quotient", F.when(~F.col("struck"), F.col("votes") / F.col("divisor")))
    )


def capped_greedy(
    cand: DataFrame,
    keys: Sequence[str],
    quotient: str,
    row: str,
    row_cap: str,
    col: str,
    col_cap: str,
    total: int | str,
    payload: Sequence[str] = (),
) -> DataFrame:
    """Award ``total`` seats one by one to the largest quotient whose caps are open.

    Caps only tighten, so one pass in falling quotient order awards the same seats as
    searching the maximum again each time. The pass is a fold over the sorted candidates
    of a group; a group holds areas × parties × open divisors, a size the ballot bounds,
    and groups run in parallel. At most min(row cap, column cap) quotients of one
    (row, column) pair can win, so the others are cut before they are collected. The
    result has the awarded rows with ``award_no``.
    """
    keys = list(keys)
    limit = (F.col(total) if isinstance(total, str) else F.lit(total)).cast("int")
    open_rows = cand.where(
        F.col(quotient).isNotNull() & (F.col(row_cap) > 0) & (F.col(col_cap) > 0)
    )
    by_pair = Window.partitionBy(*keys, row, col).orderBy(F.col(quotient).desc(), *payload)
    open_rows = open_rows.withColumn("__nth", F.row_number().over(by_pair)).where(
        F.col("__nth") <= F.least(F.col(row_cap), F.col(col_cap))
    )
    group = Window.partitionBy(*keys)
    numbered = (
        open_rows.withColumn("__row", F.dense_rank().over(group.orderBy(row)))
        .withColumn("__col", F.dense_rank().over(group.orderBy(col)))
        .withColumn("__order", -F.col(quotient))
    )
    # the sort key leads the struct: falling quotient, then row, column, payload
    entry = F.struct(
        "__order",
        F.col(row).alias("row"),
        F.col(col).alias("col"),
        *payload,
        F.col(row_cap).cast("int").alias("row_cap"),
        F.col(col_cap).cast("int").alias("col_cap"),
        F.col("__row").alias("r"),
        F.col("__col").alias("c"),
        limit.alias("limit"),
    )
    grouped = numbered.groupBy(*keys).agg(
        F.sort_array(F.collect_list(entry)).alias("__cand"),
        F.max("__row").alias("__rows"),
        F.max("__col").alias("__cols"),
    )
    none_won = F.filter("__cand", lambda x: F.lit(False))
    start = F.struct(
        F.array_repeat(F.lit(0), F.col("__rows")).alias("rows"),
        F.array_repeat(F.lit(0), F.col("__cols")).alias("cols"),
        none_won.alias("won"),
    )

    def bump(counts: Column, at: Column) -> Column:
        return F.transform(counts, lambda n, i: F.when(i == at - 1, n + 1).otherwise(n))

    def step(acc: Column, x: Column) -> Column:
        is_open = (
            (F.element_at(acc["rows"], x["r"]) < x["row_cap"])
            & (F.element_at(acc["cols"], x["c"]) < x["col_cap"])
            & (F.size(acc["won"]) < x["limit"])
        )
        taken = F.struct(
            bump(acc["rows"], x["r"]).alias("rows"),
            bump(acc["cols"], x["c"]).alias("cols"),
            F.array_append(acc["won"], x).alias("won"),
        )
        return F.when(is_open, taken).otherwise(acc)

    won = grouped.select(
        *keys, F.aggregate("__cand", start, step, lambda acc: acc["won"]).alias("__won")
    )
    return won.select(*keys, F.posexplode("__won").alias("__at", "__x")).select(
        *keys,
        F.col("__x.row").alias(row),
        F.col("__x.col").alias(col),
        *[F.col(f"__x.{p}").alias(p) for p in payload],
        (-F.col("__x.__order")).alias(quotient),
        (F.col("__at") + 1).alias("award_no"),
    )


def award_progress(awards: DataFrame, keys: Sequence[str], row: str, col: str) -> DataFrame:
    """Awards so far of the party and of the region at each step."""
    keys = list(keys)

    def so_far(*by: str) -> Column:
        window = Window.partitionBy(*keys, *by).orderBy("award_no")
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.count(F.lit(1)).over(upto).cast("int")

    return awards.withColumn("party_awards", so_far(col)).withColumn("region_awards", so_far(row))


def constituency_placement(
    votes: DataFrame,
    keys: Sequence[str],
    region: str,
    constituency: str,
    party: str,
    used: str,
    awards: str,
    divisors: str = "sufficient",
) -> DataFrame:
    """Place a party's compensatory seats of a region in its constituencies.

    ``votes`` has one row per (constituency, party) with the seats already won there and
    the region's awards of the party. ``divisors="reference"`` stops at the largest
    award count of any party in the constituency's region, which can leave seats open.
    """
    keys = list(keys)
    count = divisor_count(used, F.col(awards), awards, [*keys, constituency], divisors)
    cells = placement_quotients(votes, keys, used, count, step=3)
    ranked = cells.withColumn("rank", avg_rank("quotient", [*keys, region, party]))
    return ranked.withColumn(
        "placed", F.coalesce(F.col("rank") <= F.col(awards), F.lit(False))
    )
