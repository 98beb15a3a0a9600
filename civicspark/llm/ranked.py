"""Ranked lexical search: term at a time, rarest first, with a limit on new accumulators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm import shingles
from civicspark.llm.common import arrow_rows, in_order, share_package
from civicspark.session import materialize

#: Term bytes: digits, letters and every byte of a code point beyond ASCII.
IS_TERM = np.ones(256, bool)
IS_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
#: Items that one pass over the index ranks; their terms go to every task.
BLOCK_ITEMS = 1000
#: Bits of the table by which a task leaves out terms that no item has: 2 MB for any number of items.
TERM_BITS = 1 << 24
#: Parts in which the best of all tasks are first compared.
MERGE_PARTS = 64

POSTINGS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.LongType())),
        T.StructField("tfs", T.ArrayType(T.LongType())),
    ]
)
FOUND = T.StructType(
    [T.StructField("item", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]
)


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of each text (A-Z lowered), in their order, and the texts' borders."""
    inside = IS_TERM[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.flatnonzero(inside & (breaks[:-1] | np.r_[True, ~inside[:-1]]))
    ends = np.flatnonzero(inside & (breaks[1:] | np.r_[~inside[1:], True])) + 1
    hashes = shingles.span_hashes(shingles.LOWER[data], starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS.bit_length() + 1)).astype(np.int64)


def _postings(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, bits: np.ndarray | None) -> pa.RecordBatch:
    """Number of terms of each text, and how often each term comes that the items may have."""
    hashes, borders = text_terms(data, offsets)
    counts = np.diff(borders)
    owner = np.repeat(np.arange(len(counts)), counts)
    if bits is not None:
        slots = _slots(hashes)
        asked = (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
        hashes, owner = hashes[asked], owner[asked]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    cuts = pa.array(np.searchsorted(owner[at], np.arange(len(counts) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(counts.astype(np.int64)),
            pa.ListArray.from_arrays(cuts, pa.array(hashes[at].view(np.int64))),
            pa.ListArray.from_arrays(cuts, pa.array(np.diff(np.r_[at, len(hashes)]).astype(np.int64))),
        ],
        names=POSTINGS.names,
    )


def postings(docs: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row of ``docs`` (doc_id, text)."""
    return arrow_rows(docs.select("doc_id", "text"), POSTINGS, "text", partial(_postings, bits=bits))


def _bits(terms: DataFrame) -> np.ndarray:
    """One bit for the slot of each term."""
    byte = F.shiftright(F.shiftrightunsigned("term", 64 - TERM_BITS.bit_length() + 1), 3)
    bit = F.shiftrightunsigned("term", 64 - TERM_BITS.bit_length() + 1).bitwiseAND(7).cast("int")
    ones = F.array(*(F.lit(1 << i) for i in range(8)))
    out = np.zeros(TERM_BITS // 8, np.uint8)
    # At most TERM_BITS / 8 rows, however many items there are.
    for row in terms.groupBy(byte.cast("int").alias("at")).agg(F.bit_or(F.get(ones, bit)).alias("b")).collect():
        out[row.at] = row.b
    return out


class Best:
    """The k best of one item so far, as (score, doc_id): higher scores, then lower ids, null last."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.nulls = np.zeros(0, bool)

    def least(self) -> int:
        """A score that k documents have reached; 0 as long as there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = np.r_[self.scores, scores], np.r_[self.ids, ids], np.r_[self.nulls, nulls]
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


def accumulate(segment: list, bounds: np.ndarray, size: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows with an accumulator and their exact scores, and the number of terms that made new ones.

    ``segment``: (rows, gains) of each term of an item, rarest first; ``bounds``: the largest
    gain of each. Once all terms left together stay below a score that k documents have, a
    row without an accumulator cannot come among them, not even by a tie: no more are made
    and the others get the rest of their scores.
    """
    partial_scores = np.zeros(size, np.int64)
    seen = np.zeros(size, bool)
    left = np.r_[np.cumsum(bounds[::-1])[::-1], 0]
    makers, n_seen = len(segment), 0
    for t, (rows, gains) in enumerate(segment):
        if makers == len(segment):
            if n_seen >= k and left[t] >= least:
                scores = partial_scores[seen]
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            if left[t] < least:
                makers = t
        if t < makers:
            n_seen += len(rows) - int(np.count_nonzero(seen[rows]))
            seen[rows] = True
        else:
            known = seen[rows]
            rows, gains = rows[known], gains[known]
        partial_scores[rows] += gains
    found = np.flatnonzero(seen)
    return found, partial_scores[found], makers


def _ranked(batches: Iterator[pa.RecordBatch], items: list, vocabulary: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of a task for each item; every batch is a segment with its own postings."""
    best = [Best(k) for _ in items]
    for batch in batches:
        lists, tfs = batch.column("terms"), batch.column("tfs")
        lengths = np.diff(lists.offsets.to_numpy())
        hashes = lists.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(batch.num_rows), lengths)
        # Terms as numbers of the block's vocabulary, others dropped.
        number = np.searchsorted(vocabulary, hashes)
        known = vocabulary[np.minimum(number, len(vocabulary) - 1)] == hashes
        number, rows, tf = number[known], rows[known], tfs.flatten().to_numpy(zero_copy_only=False)[known]
        n = batch.column("n").to_numpy()
        m = 25 + 75 * n * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[rows])
        order = np.argsort(number, kind="stable")
        rows, impact = rows[order], impact[order]
        cuts = np.searchsorted(number[order], np.arange(len(vocabulary) + 1))
        ids = batch.column("doc_id")
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        for item, (_, terms, weights) in enumerate(items):
            here = [(cuts[t], cuts[t + 1], w) for t, w in zip(terms, weights, strict=True) if cuts[t] < cuts[t + 1]]
            segment = [(rows[a:b], impact[a:b] * w) for a, b, w in here]
            bounds = np.array([int(g.max()) for _, g in segment], np.int64)
            found, scores, _ = accumulate(segment, bounds, batch.num_rows, k, best[item].least())
            good = (scores > 0) & (scores >= best[item].least())
            if good.any():
                found, scores = found[good], scores[good]
                best[item].add(scores, ids[found], nulls[found])
    for (name, *_), b in zip(items, best, strict=True):
        if len(b.scores):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(b.scores), name, np.int64)), pa.array(b.ids, mask=b.nulls), pa.array(b.scores)],
                names=FOUND.names,
            )


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of every item, all if fewer.

    Terms are runs of digits, letters and anything beyond ASCII, with A-Z lowered; a document's
    score sums w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included, with
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 25 + (75 n N) div L in 64-bit integers: n the terms of the
    document, L those of all, N the documents with any. Only scores above 0 count. Equal scores go by
    doc_id, null ones last; documents that repeat an id are ranked each. Null texts have no
    terms and are in no result; an item without a term, or one that no document has, has no rows.
    Every row of ``items`` is an item of its own, also where item_id repeats or is null. Other
    columns are ignored.

    One pass over the texts writes, for each document, the items' terms in it. The items are
    then ranked in blocks of ``BLOCK_ITEMS``, whose terms (bounded by the length of their texts) go
    to all tasks. A task turns each Arrow batch into postings and works through an item's terms from
    the rarest on (``accumulate``); its k best so far are the threshold for its next batches.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col("text").alias("text"))
    numbered, n_items = in_order(asked, "item_id", "text")
    own = postings(numbered.select(F.col("row_no").alias("doc_id"), "text")).withColumnRenamed("doc_id", "item")
    wanted = materialize(own.select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item", "t.terms", "t.tfs"))
    wanted = wanted.select("item", F.col("terms").alias("term"), F.col("tfs").alias("times"))
    bits = _bits(wanted)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = materialize(postings(rows, bits).filter("n > 0"))
    n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
    frequency = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighted = materialize(wanted.join(frequency, "term").withColumn("block", F.floor(F.col("item") / BLOCK_ITEMS)))

    share_package(spark)
    found = None
    for block in range(-(-n_items // BLOCK_ITEMS) if n_docs else 0):
        terms = weighted.filter(F.col("block") == block).select("item", "term", "times", "df").toPandas()
        if not len(terms):
            continue
        terms = terms.sort_values(["item", "df", "term"])
        vocabulary = np.unique(terms["term"].to_numpy())
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in terms["df"]], np.int64)
        numbers, gain = np.searchsorted(vocabulary, terms["term"]), weight * terms["times"].to_numpy()
        first = np.flatnonzero(np.r_[True, np.diff(terms["item"]) != 0])
        lists = list(zip(terms["item"].to_numpy()[first], np.split(numbers, first[1:]), np.split(gain, first[1:]), strict=True))
        best = index.select(*POSTINGS.names).mapInArrow(
            partial(_ranked, items=lists, vocabulary=vocabulary, n_docs=n_docs, n_terms=n_terms, k=k), FOUND
        )
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], FOUND)

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = (F.monotonically_increasing_id() % MERGE_PARTS).alias("part")
    for by in (["item", "part"], ["item"]):
        if "part" in by:
            found = found.withColumn("part", part)
        window = Window.partitionBy(*by).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    names = numbered.select(F.col("row_no").alias("item"), "item_id")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
