"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.session import materialize

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step of a Python task handles (or one longer text).
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is 0 modulo 5.

    A missing id is never learnt from.
    """
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def share_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it.

    A cluster that installs the package elsewhere is not affected: the folder is only added.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def arrow_rows(
    df: DataFrame, schema: T.StructType, text: str, build: Callable[..., pa.RecordBatch]
) -> DataFrame:
    """``df`` through ``build(batch, data, offsets)``, in slices of about ``CHUNK_BYTES`` of text.

    ``data`` holds the UTF-8 bytes of the slice's texts, ``offsets`` their borders; a null
    text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text):
                yield build(part, *utf8(part.column(text)))

    share_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the border of each row; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, borders, data = column.buffers()
    offsets = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_order(df: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """``df`` with ``row_no``, the place of each row (from 0) in the order of ``keys``, and the row count.

    The rows are cut into ranges of the keys and sorted there; the written table fixes
    range and place, so later readers agree. Only the number of rows of each range, one
    row a partition, is summed up in one task.
    """
    columns = df.columns
    placed = materialize(
        df.repartitionByRange(*(F.col(k).asc_nulls_first() for k in keys))
        .sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in keys))
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33))
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select(
        "_part",
        F.sum("_rows")
        .over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        .alias("_before"),
    )
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    row_no = F.coalesce("_before", F.lit(0)) + F.col("_place").bitwiseAND((1 << 33) - 1)
    # One row a partition: small however large the table.
    return placed.join(F.broadcast(before), "_part").select(*columns, row_no.alias("row_no")), total


#: Bits of a sieve: 2 MB, however many keys there are.
SIEVE_BITS = 1 << 24


def sieve(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that every value of ``keys`` passes, and few others as long as the keys are few.

    One bit a key in a table of fixed size, which Spark hands to all tasks as a scalar. It
    only spares a join rows that it would drop; beyond some 10^7 keys it spares less.
    """
    spark = keys.sparkSession

    def slot(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS)).cast("int")

    def bit(column: Column) -> Column:
        return slot(column).bitwiseAND(63)

    ones = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    words = keys.groupBy(F.shiftright(slot(F.col(key)), 6).alias("w")).agg(
        F.bit_or(F.get(ones, bit(F.col(key)))).alias("bits")
    )
    dense = spark.range(SIEVE_BITS // 64).select(F.col("id").cast("int").alias("w"))
    table = materialize(
        dense.join(words, "w", "left")
        .agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("s"))
        .select(F.transform("s", lambda x: x["bits"]).alias("bits"))
    ).scalar()
    return lambda column: F.getbit(F.get(table, F.shiftright(slot(column), 6)), bit(column)) == 1
