"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm.common import WORD, share_package
from civicspark.session import materialize

#: A document is taken this many times at most, and so is a source.
MOST_COPIES = 2


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(df: DataFrame, within: list[str], cap: Column, weight: Column, total: Column) -> DataFrame:
    """``df`` with ``share``: ``total`` dealt by ``weight``, but no row above its ``cap``.

    What a capped row leaves is dealt again to the others, until none is above. The rows
    that end capped are those with the least cap for their weight, so a running sum in that
    order finds them at once. The groups named by ``within`` are small tables of statistics
    (sources, or size classes of a source), never documents.
    """
    order = Window.partitionBy(*within).orderBy("_ratio", "_cap", "_weight")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*within)
    # What a unit of weight gets once all rows before this one are capped. From the first row
    # that stays below its cap on it falls, so the largest such level holds.
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    columns = df.columns
    return (
        df.withColumns({"_cap": cap.cast("double"), "_weight": weight.cast("double"), "_total": total.cast("double")})
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("_open", F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(whole))
        .select(*columns, F.least("_cap", F.coalesce(F.col("_open") * F.col("_weight"), F.col("_cap"))).alias("share"))
    )


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, get the weights in turn. A target stops at
    ``MOST_COPIES`` times its source's size.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("_w", F.get(F.array(*map(F.lit, weights)), place % len(weights)))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    dealt = fill(ranked.withColumn("_all", total), [], F.col("source_size") * MOST_COPIES, F.col("_w"), F.col("_all"))
    return dealt.select("source", "source_size", F.col("share").alias("target"))


def _uniform(key: int) -> Column:
    """A number strictly between 0 and 1 from the document's id."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(key), "doc_id", "_crc"), 11).cast("double") + 0.5) / F.lit(float(2**53))


def _running(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """Words so far of the same source within this partition, which is sorted by source."""
    last, total = object(), 0
    for rows in batches:
        sums = rows["size"].to_numpy().cumsum()
        source = rows["_s"].to_numpy()
        start = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
        base = np.r_[0, sums][start]
        if len(start) and source[0] == last:
            base[0] -= total
        before = sums - rows["size"].to_numpy() - np.repeat(base, np.diff(np.r_[start, len(sums)]))
        if len(source):
            last, total = source[-1], int(before[-1] + rows["size"].iloc[-1])
        yield rows.assign(_before=before)


def mix(df: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), key: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of (doc_id, source, text).

    Size counts words. A source's target is dealt among its documents in proportion to
    1 + log2(size) copies each, so longer documents are likelier, and never more than
    ``MOST_COPIES``. The whole copies of that are certain; the rest is the chance of one more.
    For it, documents are ranked by the odds of a random number over the odds of their chance
    (Pareto order sampling), and the first ones are taken as long as the source's target holds
    them. One more document, whose size fits best, closes the gap.

    Randomness is a hash of key, doc_id and text, so reruns agree. Null texts and those
    without words have size 0 and are never taken; a null source is a source; null and
    repeated ids are documents like others, rows equal in id and text being drawn one by one. The
    ranking is by ranges and partial sums: no source is gathered in one task.
    """
    share_package(df.sparkSession)
    docs = materialize(
        df.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            n_words(F.col("text")).alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_crc"),
        )
    )
    sizes = materialize(
        targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights)
    )
    # Chances by size class (powers of two), of which a source has 63 at most.
    level = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")))).cast("int")
    classed = docs.withColumn("_class", level)
    words = classed.filter("size > 0").groupBy(F.col("source").alias("s"), "_class").agg(F.sum("size").alias("_words"))
    chance = materialize(
        fill(
            words.join(sizes, F.col("s").eqNullSafe(F.col("source"))),
            ["s"],
            F.col("_words") * MOST_COPIES,
            F.col("_words") * (1 + F.col("_class")),
            F.col("target"),
        ).select(
            F.col("s"),
            F.col("_class").alias("c"),
            "source_size",
            "target",
            (F.col("share") / F.col("_words")).alias("_copies"),
            F.col("share").alias("_share"),
            F.col("_words"),
        )
    )
    # Words that the certain copies leave to be drawn.
    whole = F.floor(F.col("_copies") + 1e-9)
    left = chance.groupBy("s").agg(F.sum(F.col("_share") - whole * F.col("_words")).alias("_left"))
    u, p = F.col("_u"), F.col("_p")
    ranked = (
        classed.filter("size > 0")
        .join(chance.select("s", "c", "_copies"), F.col("source").eqNullSafe(F.col("s")) & (F.col("_class") == F.col("c")))
        .withColumn("_whole", whole)
        .withColumn("_p", F.greatest(F.col("_copies") - F.col("_whole"), F.lit(0.0)))
        .withColumn("_u", _uniform(key))
        .withColumn("_rank", F.when(p > 1e-9, (u / (1 - u)) / (p / (1 - p))).otherwise(F.lit(float("inf"))))
        .withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
        .select("doc_id", "source", "size", "_crc", "_whole", "_p", "_rank", "_s")
    )
    keys = ["_s", "_rank", "doc_id", "_crc"]
    sorted_rows = ranked.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("_before", T.LongType())])
    # The written number tells rows apart that are equal in everything else.
    placed = materialize(
        sorted_rows.mapInPandas(_running, schema)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    parts = placed.groupBy(F.col("_part").alias("part"), F.col("_s").alias("ps")).agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("ps").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", "ps", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    drawn = materialize(
        placed.join(offsets, (F.col("_part") == F.col("part")) & (F.col("_s") == F.col("ps")))
        .join(left, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("_in", (F.col("_p") > 1e-9) & (F.col("_offset") + F.col("_before") + F.col("size") <= F.col("_left")))
        .select("doc_id", "source", "size", "_crc", "_whole", "_p", "_rank", "_left", "_in", "_row")
    )
    # The words still missing are less than the next document has; the one that fits best follows.
    gap = drawn.groupBy(F.col("source").alias("s")).agg(
        (F.first("_left") - F.sum(F.when(F.col("_in"), F.col("size")).otherwise(0))).alias("_gap")
    )
    off = F.abs(F.col("size") - F.col("_gap"))
    last = (
        drawn.filter(~F.col("_in") & (F.col("_p") > 1e-9))
        .join(gap, F.col("source").eqNullSafe(F.col("s")))
        .filter(off < F.col("_gap"))
        .groupBy("s")
        .agg(F.min(F.struct(off.alias("off"), "_rank", "doc_id", "_crc", "_row")).alias("one"))
        .select("s", F.col("one._row").alias("last_row"))
    )
    is_last = F.coalesce(F.col("_row") == F.col("last_row"), F.lit(False))
    drawn = drawn.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "doc_id", "source", "size", (F.col("_whole").cast("int") + (F.col("_in") | is_last).cast("int")).alias("copies")
    )
    empty = docs.filter("size = 0").select("doc_id", "source", "size", F.lit(0).alias("copies"))
    named = sizes.select(F.col("source").alias("s"), "source_size", "target")
    return (
        drawn.unionByName(empty)
        .join(named, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "size", "source_size", "target", "copies")
    )
