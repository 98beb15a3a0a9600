"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import SPACES, sieve
from civicspark.session import materialize

WIDTH = 5
#: Least hash values kept of an item. Of an item contained to 0.8, all are missing from the
#: document with a chance of 0.2^8, 3 in 10^6.
SKETCH = 8
#: An item is found in a document that holds this percentage of its shingles.
PERCENT = 80


def _shingles(text: Column) -> Column:
    """Distinct hashes of the runs of five words, lowered; of fewer words, their whole sequence."""

    def runs(words: Column) -> Column:
        n = F.size(words)
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(n - (WIDTH - 1), F.lit(1))),
                lambda i: F.xxhash64(F.slice(words, i, WIDTH)),
            )
        )

    words = F.transform(F.filter(F.split(F.lower(text), SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    # An array of one element binds the words, so that each run does not split the text anew.
    return F.array_distinct(F.get(F.transform(F.array(words), runs), F.lit(0)))


def _rank(h: Column) -> Column:
    """The place of a shingle in the permutation that MinHash reads: non-negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(17), h), 1)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): each item that a document holds to ``percent`` or more.

    n_item counts the item's distinct shingles of five words, n_shared those of them that the
    document has, anywhere in its whole text. An item of fewer words has one shingle, its
    whole sequence, which only a document of just these words shares; an item or document
    without words is never found. Null texts have no words. Rows repeating an id are one
    document or item with all their shingles searched alike: the best row counts. Null ids are
    ids like others. Other columns are ignored.

    Items fall into partitions by size (powers of two of their shingles). Each item is known
    by its ``SKETCH`` least shingles in one random order, and each partition by the largest of
    these: a document looks up only its own shingles up to that ceiling, in the partitions
    whose items are small enough to fit into it. So long documents send a fixed share of their
    shingles for any size of item, and no item is missed for being short. What is found is
    verified on all shingles.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    item = materialize(
        items.select(F.col(item_col).alias("item_id"), _shingles(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("whole"))
        .withColumn("n_item", F.size("whole"))
        .filter("n_item > 0")
        .withColumn("least", F.slice(F.sort_array(F.transform("whole", _rank)), 1, SKETCH))
        .withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
    )
    sketches = materialize(item.select("item_id", "n_item", F.explode("least").alias("rank")))
    # One row for each power of two: 31 at most.
    classes = (
        item.groupBy("size_class")
        .agg(F.min("n_item").alias("smallest"), F.max(F.element_at("least", -1)).alias("ceiling"))
        .orderBy("size_class")
        .collect()
    )
    set_of = F.col("set")
    ceiling = F.greatest(
        F.lit(-1).cast("long"),
        F.lit(-1).cast("long"),
        *(F.when(F.size(set_of) * 100 >= F.lit(c.smallest * percent), F.lit(c.ceiling)) for c in classes),
    )
    in_index = sieve(sketches, "rank")
    probes = (
        texts.filter("text is not null")
        .select("doc_id", _shingles(F.col("text")).alias("set"))
        .select("doc_id", F.size("set").alias("n"), F.struct(ceiling.alias("top"), F.transform("set", _rank).alias("ranks")).alias("p"))
        .select("doc_id", "n", F.explode(F.filter("p.ranks", lambda r: r <= F.col("p.top"))).alias("rank"))
        .filter(in_index(F.col("rank")))
    )
    found = materialize(
        probes.join(sketches, "rank").filter(F.col("n") * 100 >= F.col("n_item") * percent).select("doc_id", "item_id").distinct()
    )
    ids = materialize(found.select(F.col("doc_id").alias("found_id")).distinct())
    wanted = texts.filter(F.col("text").isNotNull() & sieve(ids, "found_id")(F.col("doc_id")))
    sets = wanted.join(ids, wanted["doc_id"].eqNullSafe(ids["found_id"]), "left_semi").select(
        F.col("doc_id").alias("set_id"), _shingles(F.col("text")).alias("set")
    )
    checked = (
        found.join(item.select(F.col("item_id").alias("of_item"), "n_item", "whole"), F.col("item_id").eqNullSafe(F.col("of_item")))
        .join(sets, F.col("doc_id").eqNullSafe(F.col("set_id")))
        .select("doc_id", "item_id", "n_item", F.size(F.array_intersect("whole", "set")).alias("n_shared"))
    )
    return (
        checked.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_shared", "n_item")).alias("best"))
        .select("doc_id", "item_id", "best.n_item", "best.n_shared")
    )


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold an item; all their columns and other rows stay.

    Rows that share ``id_col`` (or have none) are one document: a key of each row and its text
    decides on each text alone.
    """
    held = contained_items(docs, items, id_col, percent=percent).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(held, docs[id_col].eqNullSafe(held["_held"]), "left_anti")
