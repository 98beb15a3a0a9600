"""Column names and alternative spellings."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_name(name: str, snake: bool = True) -> str:
    """A header without ``#``, ``@`` and ``.``, in snake or plain lower case."""
    bare = re.sub(r"[#@.]", "", name)
    if snake:
        bare = re.sub(r"(?<=[a-zæøå0-9])(?=[A-ZÆØÅ])", "_", bare)
        bare = re.sub(r"\W+", "_", bare).strip("_")
    return bare.lower()


def clean_headers(
    df: DataFrame,
    snake: bool = True,
    rename: Mapping[str, str] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Normalise all headers, then drop and rename those that exist."""
    named = df.toDF(*[clean_name(c, snake) for c in df.columns])
    return named.drop(*drop).withColumnsRenamed(dict(rename or {}))


def coalesce_spellings(df: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column per field out of its alternative spellings, first non-NULL wins.

    Spellings the data does not have are ignored.
    """
    merged = {
        field: F.coalesce(*[F.col(c) for c in spellings if c in df.columns])
        for field, spellings in fields.items()
    }
    used = {c for spellings in fields.values() for c in spellings} - set(fields)
    return df.withColumns(merged).drop(*used)
