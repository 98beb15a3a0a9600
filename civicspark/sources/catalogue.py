"""Election catalogue, count phases and the published reference tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.sources import fixed_values as fixed


def expand_catalogue(
    elections: DataFrame,
    codes: Mapping[tuple[str, int], str],
    seats: Mapping[int, int],
    letters: Mapping[int, str],
    base: str,
) -> DataFrame:
    """One row per election (``year``, ``type``) and count kind, with file link, seats
    and ordered-list letters. Elections without a code have a NULL link."""

    def lookup(values: Mapping, key: Column, kind: str) -> Column:
        if not values:
            return F.lit(None).cast(kind)
        pairs = [F.lit(x) for pair in values.items() for x in pair]
        return F.element_at(F.create_map(*pairs), key)

    code = lookup(
        {f"{kind}{year}": value for (kind, year), value in codes.items()},
        F.concat("type", F.col("year").cast("string")),
        "string",
    )
    european = F.col("type") == "EP"
    kinds = F.array(*[F.lit(k) for k in fixed.COUNT_KINDS])
    return elections.select(
        "year",
        "type",
        F.explode(kinds).alias("kind"),
        code.alias("__code"),
        F.when(european, lookup(seats, F.col("year"), "int")).alias("seats"),
        F.when(european, lookup(letters, F.col("year"), "string")).alias("letters"),
    ).withColumn(
        "link",
        F.concat(
            F.lit(base.rstrip("/") + "/"),
            "__code",
            F.lit("/"),
            lookup(fixed.COUNT_FILES, F.col("kind"), "string"),
        ),
    ).drop("__code")


def published_catalogue(spark: SparkSession, until: int, base: str) -> DataFrame:
    """The published European and national elections up to a year."""
    european = spark.range(1).select(
        F.explode(
            F.sequence(
                F.lit(fixed.EUROPEAN_FIRST_YEAR), F.lit(until), F.lit(fixed.EUROPEAN_INTERVAL)
            )
        ).alias("year"),
        F.lit("EP").alias("type"),
    )
    national = spark.createDataFrame([(y, "FT") for y in fixed.NATIONAL_YEARS], "year INT, type STRING")
    return expand_catalogue(
        european.unionByName(national),
        fixed.ELECTION_CODES,
        fixed.EUROPEAN_SEATS,
        fixed.ORDERED_LIST_LETTERS,
        base,
    )


def alliances(spark: SparkSession) -> DataFrame:
    """Party letters and their alliance per year."""
    rows = [
        (year, letter, alliance)
        for year, names in fixed.ALLIANCES.items()
        for alliance in names
        for letter in alliance.split("_")
    ]
    return spark.createDataFrame(rows, "election_id INT, letter STRING, alliance STRING")


def constituency_seats(spark: SparkSession) -> DataFrame:
    """Published seats per constituency."""
    return spark.createDataFrame(
        list(fixed.CONSTITUENCY_SEATS.items()), "constituency_id STRING, seats INT"
    )


def region_pool(spark: SparkSession) -> DataFrame:
    """Published compensatory seats per region."""
    rows = [(i, fixed.REGION_NAMES[i], n) for i, n in fixed.REGION_LEVELLING_SEATS.items()]
    return spark.createDataFrame(rows, "region_id STRING, region_name STRING, pool INT")


def pick_phase(catalogue: DataFrame, date: str, as_of: Column, pattern: str = "d-M-yyyy") -> DataFrame:
    """Keep the final count of past elections and the election-night count of others.

    ``as_of`` is given by the caller, so a rerun picks the same rows.
    """
    held = F.to_date(F.col(date), pattern)
    wanted = F.when(held < as_of, "fintælling").otherwise("valgaften")
    return catalogue.withColumn("held_on", held).where(F.col("kind") == wanted)
