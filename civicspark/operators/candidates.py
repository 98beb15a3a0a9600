"""Candidate selection from open and ordered lists.

Windows here are per party list, whose length the ballot bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.rank import avg_rank
from civicspark.operators.grouping import null_safe_join


def list_type(
    candidates: DataFrame,
    hierarchy: DataFrame,
    keys: Sequence[str],
    district: str,
    constituency: str,
    party: str,
    party_allotted: str,
    candidate_allotted: str,
) -> DataFrame:
    """Parties on an ordered list, per constituency.

    A party is on an ordered list in a district if some candidate was allotted all of
    the party's list votes there, and in a constituency if it is in one of its districts: one
    row a list. ``hierarchy`` maps districts to constituencies.
    """
    whole = (F.col(party_allotted) == F.col(candidate_allotted)) & (F.col(party_allotted) > 0)
    flags = candidates.groupBy(*keys, district, party).agg(
        F.bool_or(F.coalesce(whole, F.lit(False))).alias("ordered_list")
    )
    pairs = hierarchy.select(district, constituency).distinct()
    return (
        flags.join(pairs, district, "left")
        .groupBy(*keys, constituency, party)
        .agg(F.bool_or("ordered_list").alias("ordered_list"))
    )


def list_type_from_catalogue(
    parties: DataFrame, catalogue: DataFrame, keys: Sequence[str], letter: str, letters: str
) -> DataFrame:
    """Ordered-list flag by membership of the party letter in a string of letters."""
    known = F.array_contains(F.split(F.col(letters), ""), F.col(letter))
    return (
        parties.join(catalogue, list(keys), "left")
        .withColumn("ordered_list", F.coalesce(known, F.lit(False)))
        .drop(letters)
    )


def droop_quota(votes: Column, seats: Column, variant: str = "european") -> Column:
    """Votes that guarantee a seat: floor(v/(s+1))+1, or floor(v/(s+1)+1)."""
    share = votes / (seats + 1)
    return (F.floor(share) + 1) if variant == "european" else F.floor(share + 1)


def open_list(
    candidates: DataFrame,
    keys: Sequence[str],
    candidate: str,
    votes: str,
    seats: str,
    ties: str = "first",
) -> DataFrame:
    """Rank by personal votes; the first ``seats`` are elected."""
    if ties == "average":
        rank = avg_rank(votes, keys)
    else:
        rank = F.row_number().over(
            Window.partitionBy(*keys).orderBy(F.col(votes).desc_nulls_last(), candidate)
        )
    return candidates.withColumn("rank", rank).withColumn("elected", F.col("rank") <= F.col(seats))


def substitute_order(
    ranked: DataFrame, keys: Sequence[str], elected_order: str | None = None
) -> DataFrame:
    """Order among the elected and among the substitutes of each list.

    ``elected_order`` takes the elected's order from a column (the list position of
    ordered lists) instead of their rank.
    """
    within = avg_rank("rank", [*keys, "elected"], ascending=True)
    elected = F.col(elected_order).cast("double") if elected_order else within
    return ranked.withColumn("elected_rank", F.when(F.col("elected"), elected)).withColumn(
        "substitute_rank", F.when(~F.col("elected"), within)
    )


def list_waterfall(
    df: DataFrame, keys: Sequence[str], position: str, need: str, pool: str, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Hand a party's list votes down its list until the pool is empty.

    Each candidate is topped up to the quota; what is left after the needs above is the
    pool minus their running sum, so no step-by-step pass is needed. A surplus over the
    total need stays unallocated. ``tiebreak`` orders candidates who share a position.
    """
    above = Window.partitionBy(*keys).orderBy(position, *tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(pool) - F.coalesce(F.sum(need).over(above), F.lit(0))
    return df.withColumn("allotted", F.least(F.col(need), F.greatest(left, F.lit(0))))


def list_winners(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    personal: str,
    quota: str,
    seats: str,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Ordered-list winners: those who reach the quota, then the largest totals."""
    by_total = Window.partitionBy(*keys).orderBy(F.col("total").desc(), position, *tiebreak)
    return (
        df.withColumn("total", F.col(personal) + F.col("allotted"))
        .withColumn("rank", F.row_number().over(by_total))
        .withColumn(
            "elected", (F.col("total") >= F.col(quota)) | (F.col("rank") <= F.col(seats))
        )
    )


def ordered_list(
    candidates: DataFrame,
    keys: Sequence[str],
    position: str,
    personal: str,
    party_votes: str,
    seats: str,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Quota, waterfall and winners of ordered lists in one go.

    ``party_votes`` counts all votes of the list; those not given to a person form the
    pool.
    """
    personal_sum = F.sum(personal).over(Window.partitionBy(*keys))
    prepared = (
        candidates.withColumn("pool", F.col(party_votes) - personal_sum)
        .withColumn("quota", droop_quota(F.col(party_votes), F.col(seats)))
        .withColumn("need", F.greatest(F.col("quota") - F.col(personal), F.lit(0)))
    )
    topped = list_waterfall(prepared, keys, position, "need", "pool", tiebreak)
    return list_winners(topped, keys, position, personal, "quota", seats, tiebreak)


def list_order_interleaved(
    candidates: DataFrame,
    keys: Sequence[str],
    position: str,
    votes: str,
    seats: str,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """National ordered lists: number those over the quota and the rest separately by
    list position, then interleave the two numberings, over-quota first."""
    total = F.sum(votes).over(Window.partitionBy(*keys))
    flagged = candidates.withColumn(
        "quota", droop_quota(total, F.col(seats), "national")
    ).withColumn("over_quota", F.col(votes) > F.col("quota"))
    nth = F.row_number().over(Window.partitionBy(*keys, "over_quota").orderBy(position, *tiebreak))
    order = Window.partitionBy(*keys).orderBy("__nth", F.col("over_quota").desc())
    return (
        flagged.withColumn("__nth", nth)
        .withColumn("rank", F.row_number().over(order).cast("double"))
        .drop("__nth")
    )


def merge_list_types(open_lists: DataFrame, ordered_lists: DataFrame) -> DataFrame:
    """All candidates again: the two list types are disjoint halves."""
    return open_lists.unionByName(ordered_lists, allowMissingColumns=True)


def seat_labels(
    ranked: DataFrame,
    keys: Sequence[str],
    votes: str,
    won: str,
    total: str,
    reverse_labels: bool = True,
) -> DataFrame:
    """``1K``… for constituency seats, ``1T``… for compensatory seats, substitute numbers.

    With ``reverse_labels`` the smallest vote total among the compensatory seats is 1T.
    """
    keys = list(keys)
    flagged = ranked.withColumn("elected", F.col("rank") <= F.col(total)).withColumn(
        "seat_rank", avg_rank("rank", [*keys, "elected"], ascending=True)
    )
    direct = F.col("elected") & (F.col("seat_rank") <= F.col(won))
    placed = flagged.withColumn(
        "constituency_seat", F.when(direct, F.concat(rank_text(F.col("seat_rank")), F.lit("K")))
    ).withColumn("__levelling", F.col("elected") & F.col("constituency_seat").isNull())
    by_votes = avg_rank(
        F.when(F.col("__levelling"), F.col(votes)),
        [*keys, "__levelling"],
        ascending=reverse_labels,
    )
    return (
        placed.withColumn(
            "levelling_seat",
            F.when(F.col("__levelling"), F.concat(rank_text(by_votes), F.lit("T"))),
        )
        .withColumn("substitute_rank", F.when(~F.col("elected"), F.col("seat_rank")))
        .drop("__levelling")
    )


def rank_text(rank: Column) -> Column:
    """A rank as text: whole ranks without decimals, shared ranks with ``.5``."""
    whole = F.floor(rank)
    return F.when(rank == whole, whole.cast("string")).otherwise(rank.cast("string"))


def person_seat_order(
    persons: DataFrame, seats: DataFrame, keys: Sequence[str], party: str
) -> DataFrame:
    """The n-th elected of a party gets the party's n-th seat in award order.

    ``seats`` holds the won seats with ``overall_rank``; ``persons`` has ``elected_rank``.
    """
    nth = Window.partitionBy(*keys, party).orderBy("overall_rank")
    numbered = seats.select(
        *keys, party, "overall_rank", F.row_number().over(nth).cast("double").alias("elected_rank")
    )
    return null_safe_join(persons, numbered, [*keys, party, "elected_rank"])


def nth_place(places: str, rank: str) -> Column:
    """The place at a rank (from 1) of a nested list of places; NULL for shared ranks and beyond its end."""
    nth = F.floor(rank)
    return F.when(F.col(rank) == nth, F.get(F.col(places), (nth - 1).cast("int")))


def candidate_enrich(
    candidates: DataFrame,
    seats: DataFrame,
    list_types: DataFrame,
    on: Sequence[str],
    list_on: Sequence[str],
) -> DataFrame:
    """Add seats and list type to candidates; parties without seats get 0."""
    return (
        candidates.join(seats, list(on), "left")
        .join(list_types, list(list_on), "left")
        .withColumns(
            {c: F.coalesce(c, F.lit(0)) for c in seats.columns if c not in on}
        )
    )


def elected_table(
    labelled: DataFrame, keys: Sequence[str], area: str, candidate: str, votes: str, out: str = "elected"
) -> DataFrame:
    """The elected of each party as a nested table, from the rows of ``seat_labels``.

    One row per key with ``n_<out>`` and ``<out>``, an array of (area, candidate, votes, label): by
    area, then most votes, then name. Namesakes stay, each with an area and label of their own. A key
    without an elected candidate has no row; a party's seats bound the array.
    """
    label = F.coalesce("constituency_seat", "levelling_seat")
    entry = F.struct(
        F.col(area).alias("area"), (-F.col(votes)).alias("order"), F.col(candidate).alias("candidate"), label.alias("label")
    )
    grouped = labelled.where("elected").groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("__rows"))
    rows = F.transform(
        "__rows",
        lambda x: F.struct(
            x["area"].alias(area), x["candidate"].alias(candidate), (-x["order"]).alias(votes), x["label"].alias("label")
        ),
    )
    return grouped.select(*keys, F.size("__rows").alias(f"n_{out}"), rows.alias(out))
