"""Result writers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshot(
    schedule: DataFrame, path: str, country: str, loaded_at: dt.datetime, mode: str = "overwrite"
) -> None:
    """Parquet folders per country with the load time.

    Readers of one country read only its folder. The rows of a country may be spread
    over many files, so a large country is not one task.
    """
    moment = F.to_timestamp_ntz(F.lit(loaded_at.isoformat()))
    stamped = schedule.withColumn("loaded_at", moment)
    stamped.write.mode(mode).partitionBy(country).parquet(path)


def write_json(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; NULL fields are written."""
    table.write.mode(mode).option("ignoreNullFields", "false").json(path)
