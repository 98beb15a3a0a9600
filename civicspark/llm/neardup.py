"""Near-duplicate documents: circulant MinHash, banding, exact verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm import shingles
from civicspark.llm.common import arrow_rows, sieve
from civicspark.llm.links import compare_sets, linked_components
from civicspark.session import materialize

#: 32 bands of 6 coordinates find a pair of similarity 0.85 but for a chance of 3 in 10^7.
BANDS, ROWS, WIDTH = 32, 6, 5

SIGNATURE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
ITEMS = T.StructType(
    [T.StructField("node", T.LongType()), T.StructField("content", T.ArrayType(T.LongType()))]
)


def _sign(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    hashes, borders = shingles.sets(*shingles.word_shingles(data, offsets, WIDTH))
    node = shingles.set_keys(hashes, borders)
    sizes = np.diff(borders)
    keys = shingles.bands(shingles.circulant_minhash(hashes, borders, BANDS * ROWS), ROWS)
    keys = keys[sizes > 0]
    cuts = np.r_[0, np.cumsum((sizes > 0) * BANDS)].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes), pa.array(node),
         pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.ravel()))],
        schema=_arrow(SIGNATURE),
    )


def _items(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    hashes, borders = shingles.sets(*shingles.word_shingles(data, offsets, WIDTH))
    node = shingles.set_keys(hashes, borders)
    lists = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(hashes.view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(node), lists], schema=_arrow(ITEMS))


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    A text's set are its distinct runs of five words (A-Z lowered); with fewer words the whole
    sequence; without words or with a null text it is empty and linked with nothing. Texts are
    linked if 100 * intersection >= percent * union; ``component_id`` is the least doc_id
    reachable and ``kept`` marks its rows. Rows repeating a doc_id and text get the same
    result each. A row without doc_id takes part in links and has no component of its own (null).
    It is kept if it is linked with nothing, or only with others without doc_id of which its
    text has the least hash. Other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(arrow_rows(docs.withColumn("text_hash", F.xxhash64("text")), SIGNATURE, "text", _sign))
    # Equal sets are one node; its first document stands for it.
    nodes = materialize(
        signed.filter("n_shingles > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("first"), F.min("text_hash").alias("least_hash"), F.first("bands").alias("bands"))
    )

    def content(asked: DataFrame) -> DataFrame:
        ids = materialize(nodes.join(asked, "node", "left_semi").select("first").distinct())
        wanted = docs.filter(sieve(ids, "first")(F.col("doc_id")))
        texts = wanted.join(ids, wanted["doc_id"].eqNullSafe(ids["first"]), "left_semi")
        found = arrow_rows(texts, ITEMS, "text", _items).join(asked, "node", "left_semi")
        return found.groupBy("node").agg(F.first("content").alias("content"))

    def items(contents: DataFrame) -> DataFrame:
        return contents.withColumnRenamed("content", "items")

    labels = linked_components(nodes.select("node", "bands"), content, compare_sets, items, percent)
    classed = nodes.select("node", "first", "least_hash").join(labels, "node", "left")
    least = classed.withColumn("class", F.coalesce("component", "node"))
    ids = least.groupBy("class").agg(F.min("first").alias("component_id"), F.min("least_hash").alias("class_hash"))
    named = materialize(least.join(ids, "class").select("node", "component_id", "class_hash"))
    own = F.coalesce("component_id", "doc_id")
    # Where no row of the class has a doc_id, the least text stands for it.
    lone = own.isNull() & (F.col("class_hash").isNull() | (F.col("text_hash") == F.col("class_hash")))
    return signed.join(named, "node", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), (lone | (own.isNotNull() & own.eqNullSafe(F.col("doc_id")))).alias("kept")
    )
