"""Fuzzy line deduplication: MinHash of character shingles, exact check, components."""

from __future__ import annotations

from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm import shingles
from civicspark.llm.common import _slices, arrow_rows, in_order, share_package, sieve, utf8
from civicspark.llm.links import components_of_spokes, spokes_of_bands
from civicspark.session import discard, materialize

#: 12 bands of 4 coordinates find a pair of similarity 0.9 but for a chance of 3 in 10^6, one
#: of 0.85 but for 1 in 10^4, one of just 0.8 but for 2 in 10^3.
BANDS, ROWS = 12, 4
#: Slots of ``variety``.
SLOTS = 512
#: Lines that are compared by runs of code points are signed by longer runs, which unlike lines share more
#: rarely, the more the more runs they have: (slots filled from, and up to, code points more than compared,
#: bands, coordinates a band). Linked lines fill numbers of slots within a fifth of each other or so, so
#: they have a class in common. With runs of three, a pair of 0.8 is missed with a chance of 7 in 10^5
#: in the first class and 2 in 10^3 in the second; in the third with 6 in 100 if single letters change at even distances, fewer
#: if changes lie together, and 7 in 10^3 at 0.85.
CLASSES = ((0, 40, 0, 24, 5), (28, 110, 1, 24, 5), (75, SLOTS, 5, 16, 3))
LEAST_COUNTED = CLASSES[1][0]
#: Bytes of text that are hashed and signed at a time: what is made of them stays in the processor's cache.
CACHED_BYTES = 500_000
#: Bits of the sketch of a line.
SKETCH_BITS = 512

LINES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("node", T.LongType()),
        T.StructField("slice", T.LongType()),
        T.StructField("content", T.StringType()),
    ]
)
LINES_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("line_no", pa.int32()),
        ("node", pa.int64()),
        ("slice", pa.int64()),
        ("content", pa.string()),
    ]
)
#: A-Z lowered, all white space but line feeds as spaces.
PLAIN = bytes(32 if c in b"\t\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def plain_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lines of the texts, A-Z lowered, runs of white space as one space, none at the ends.

    Returns them with the text of each line and its number in it.
    """
    raw = data.tobytes()
    lines_of = np.diff(np.searchsorted(np.flatnonzero(data == 10), offsets)) + 1
    cuts = offsets.tolist()
    plain = b"\n".join([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]).translate(PLAIN)
    while b"  " in plain:
        plain = plain.replace(b"  ", b" ")
    plain = plain.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ")
    owner = np.repeat(np.arange(len(lines_of)), lines_of)
    first = np.r_[0, np.cumsum(lines_of)]
    return plain.split(b"\n"), owner, np.arange(first[-1]) - first[owner]


def _shingles(data: np.ndarray, offsets: np.ndarray, points: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``points`` code points, or of eight bytes without it."""
    return shingles.point_shingles(data, offsets, points) if points else shingles.char_shingles(data, offsets)


def _filled(points: np.ndarray, at: np.ndarray, slots: int) -> np.ndarray:
    """Which of the slots the runs of three code points of each text fill."""
    place = np.repeat(np.arange(len(at) - 1) * slots, np.diff(at))
    place += shingles.point_marks(points, at, 3) >> np.uint32(33 - slots.bit_length())
    filled = np.zeros((len(at) - 1) * slots, bool)
    filled[place] = True
    return filled.reshape(-1, slots)


def _variety(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    counts = np.diff(at)
    # Texts with fewer code points are in the first class alone, whatever their runs.
    few = np.minimum(counts, LEAST_COUNTED - 1)
    return np.where(counts < LEAST_COUNTED, few, np.count_nonzero(_filled(points, at, SLOTS), axis=1))


def variety(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of ``SLOTS`` slots the runs of three code points of each text fill."""
    return _variety(*shingles.code_points(data, offsets))


def _band_keys(data: np.ndarray, offsets: np.ndarray, points: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of some lines, and the line of each."""
    if not points:
        keys = shingles.bands(shingles.linear_minhash(*shingles.char_shingles(data, offsets), BANDS * ROWS), ROWS)
        return np.repeat(np.arange(len(keys)), BANDS), keys.ravel()
    numbers, at = shingles.code_points(data, offsets)
    counts, filled = np.diff(at), _variety(numbers, at)
    owners, found = [], []
    for low, high, more, bands, width in CLASSES:
        inside = (filled >= low) & (filled <= high)
        cuts = np.r_[0, np.cumsum(counts[inside])]
        marks = shingles.point_marks(numbers[np.repeat(inside, counts)], cuts, points + more)
        found.append(shingles.bands(shingles.minima_of_marks(marks, cuts, bands * width), width).ravel() ^ more)
        owners.append(np.repeat(np.flatnonzero(inside), bands))
    return np.concatenate(owners), np.concatenate(found)


def _strings(rows: list[bytes]) -> pa.StringArray:
    cuts = np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int32)
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(cuts.tobytes()), pa.py_buffer(b"".join(rows)))


def _split(batch: pa.RecordBatch, number_of_slice: int) -> pa.RecordBatch:
    plain, owner, number = plain_lines(*utf8(batch.column("text")))
    node = np.frombuffer(b"".join([blake2b(x, digest_size=8).digest() for x in plain]), np.int64)
    empty = np.fromiter(map(len, plain), np.int64, len(plain)) == 0
    full = np.flatnonzero(~empty)
    # A line that comes again in this slice is kept once.
    _, once = np.unique(node[full], return_index=True)
    once = np.sort(full[once])
    place = np.zeros(len(node), np.int64)
    place[once] = np.arange(len(once))
    first = np.zeros(len(node), bool)
    first[once] = True
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(pa.array(owner)),
            pa.array(number.astype(np.int32)),
            pa.array(node, mask=empty),
            pa.array(np.full(len(node), number_of_slice)),
            _strings([plain[i] for i in once.tolist()]).take(pa.array(place, mask=~first)),
        ],
        schema=LINES_ARROW,
    )


def _split_lines(docs: DataFrame) -> DataFrame:
    """Every line; those that are the first of their kind in their slice of the texts with content."""

    def run(batches):
        task, slices = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in _slices(batch, "text"):
                yield _split(part, (task << 33) + slices)
                slices += 1

    share_package(docs.sparkSession)
    return docs.mapInArrow(run, LINES)


def line_spokes(contents: DataFrame, points: int | None) -> DataFrame:
    """(band, hub, node) of the lines (node, content) that have a band in common with others."""

    def sign(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for part in _slices(batch, "content", CACHED_BYTES):
                owner, keys = _band_keys(*utf8(part.column("content")), points)
                yield keys, nodes[: part.num_rows][owner]
                nodes = nodes[part.num_rows :]

    return spokes_of_bands(contents.select("node", "content"), sign)


#: Slots of the sets of a pair; more would only spare more exact comparisons.
PAIR_SLOTS = 1024


def _slots(hashes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Which of ``PAIR_SLOTS`` slots each set fills."""
    filled = np.zeros((len(borders) - 1) * PAIR_SLOTS, bool)
    owner = np.repeat(np.arange(len(borders) - 1) * PAIR_SLOTS, np.diff(borders))
    filled[owner + (hashes >> np.uint64(54)).astype(np.int64)] = True
    return filled.reshape(-1, PAIR_SLOTS)


def _maybe_alike(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, percent: int) -> np.ndarray:
    """Rows whose sets may be alike: every slot that one of them fills alone holds an element of it alone."""
    apart = (_slots(x, xs) ^ _slots(y, ys)).sum(1)
    return np.flatnonzero(apart * (100 + percent) <= (100 - percent) * (np.diff(xs) + np.diff(ys)))


def _distinct(hashes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The distinct hashes of each set, sorted: the number of the set (less than 2^20) and 44 bits of a hash."""
    once = np.sort(np.repeat(np.arange(len(borders) - 1, dtype=np.uint64) << np.uint64(44), np.diff(borders)) | hashes >> np.uint64(20))
    return once[np.r_[True, once[1:] != once[:-1]]] if len(once) else once


def _sizes(once: np.ndarray, sets: int) -> np.ndarray:
    return np.bincount((once >> np.uint64(44)).astype(np.int64), minlength=sets)


def compare_lines(pairs: DataFrame, percent: int, points: int | None = None) -> DataFrame:
    """(a, b, linked) of pairs (a, b, x, y) of lines, by the exact similarity of their shingle sets."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "x", CACHED_BYTES):
                x, y = (_distinct(*_shingles(*utf8(part.column(c)), points)) for c in ("x", "y"))
                both = np.sort(np.concatenate([x, y]))
                shared = _sizes(both[1:][both[1:] == both[:-1]], part.num_rows)
                union = _sizes(both, part.num_rows) - shared
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(shared * 100 >= percent * union)], names=["a", "b", "linked"]
                )

    share_package(pairs.sparkSession)
    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _line_items(contents: DataFrame, points: int | None = None) -> DataFrame:
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])

    def build(batch, data, offsets):
        hashes, borders = shingles.sets(*_shingles(data, offsets, points))
        lists = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(hashes.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "items"])

    return arrow_rows(contents.select("node", "content"), schema, "content", build)


def _sketched(contents: DataFrame, points: int | None) -> DataFrame:
    """(node, n, sketch, content) of lines: the size of the set, and the slots that it fills as one bit each."""
    words = SKETCH_BITS // 64

    def build(batch, data, offsets):
        hashes, borders = _shingles(data, offsets, points)
        once = _distinct(hashes, borders)
        lines, slots = (once >> np.uint64(44)).astype(np.int64), (once >> np.uint64(44 - 9)).astype(np.int64) & (SKETCH_BITS - 1)
        bits = np.zeros(batch.num_rows * SKETCH_BITS, bool)
        bits[lines * SKETCH_BITS + slots] = True
        sketch = np.packbits(bits, bitorder="little").view(np.int64)
        sketch = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * words), pa.array(sketch))
        return pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(_sizes(once, batch.num_rows)), sketch, batch.column("content")],
            names=["node", "n", "sketch", "content"],
        )

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "content", CACHED_BYTES):
                yield build(part, *utf8(part.column("content")))

    share_package(contents.sparkSession)
    return contents.select("node", "content").mapInArrow(run, "node long, n long, sketch array<long>, content string")


def duplicate_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, points: int | None = None
) -> DataFrame:
    """(doc_id, line_no, class_doc, class_line, kept) of every line of every text.

    Lines are told apart by line feeds and numbered from 0. They are compared with A-Z lowered
    and white space collapsed, as sets of runs of ``points`` code points, or of eight bytes without
    it (a shorter line is one run); two are linked if 100 * intersection >= percent * union. The least (doc_id, line_no) of
    a linked component names its class and is kept, all its other lines are not. Empty lines
    are linked with nothing and kept. A null text has one empty line. Null ids come first in
    the order; a row that repeats id and text is kept or dropped like the other one. Other
    columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    split = materialize(_split_lines(docs), codec="zstd")
    # One row of each distinct line, of its first slice.
    first_rows = split.filter("content is not null")
    repeated = materialize(
        first_rows.groupBy("node").agg(F.min("slice").alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    likely = sieve(repeated, "node")(F.col("node"))
    again = first_rows.filter(likely).join(repeated, "node", "left").filter("keep is null or keep = slice").drop("keep")
    distinct = first_rows.filter(~likely).unionByName(again)
    spokes = materialize(line_spokes(distinct, points))
    members = materialize(spokes.select("node").union(spokes.select("hub")).distinct())
    asked = sieve(members, "node")(F.col("node"))
    contents = distinct.select("node", "content").filter(asked).join(members, "node", "left_semi")
    contents = materialize(_sketched(contents, points), codec="zstd")
    lines = materialize(split.select("doc_id", "line_no", "node"))
    again_in_slice = materialize(split.filter("node is not null and content is null").select("node").distinct())
    discard(split)
    labels = components_of_spokes(
        spokes, contents, partial(compare_lines, points=points), partial(_line_items, points=points), percent
    )
    place = F.struct("doc_id", "line_no")
    # Lines that come once and are linked with nothing stand for themselves.
    several = materialize(again_in_slice.select("node").union(repeated.select("node")).union(labels.select("node")).distinct())
    headed = sieve(several, "node")(F.col("node"))
    some = lines.filter("node is not null").filter(headed).join(several, "node", "left_semi")
    first = some.groupBy("node").agg(F.min(place).alias("first"))
    named = first.join(labels, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = named.groupBy("class").agg(F.min("first").alias("head"))
    heads = materialize(named.join(least, "class").select("node", "head"))
    alone = lines.filter(~headed).withColumn("head", F.lit(None).cast(heads.schema["head"].dataType))
    own = F.coalesce(F.col("head"), place)
    return lines.filter(headed).join(heads, "node", "left").unionByName(alone).select(
        "doc_id",
        "line_no",
        own["doc_id"].alias("class_doc"),
        own["line_no"].alias("class_line"),
        (own["doc_id"].eqNullSafe(F.col("doc_id")) & (own["line_no"] == F.col("line_no"))).alias("kept"),
    )


def drop_duplicate_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, points: int | None = None
) -> DataFrame:
    """(doc_id, text) of every row, with the lines left that ``duplicate_lines`` keeps, in their order.

    Rows are taken one by one, in the order of id and text, null ids first: of rows that share an
    id, or have none, each keeps its own lines that no earlier row has. A row all of whose lines an
    earlier one has is left out; empty lines stay, so an empty or null text gives an empty one.
    """
    rows, _ = in_order(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    kept = duplicate_lines(rows, "row_no", "text", percent, points).filter("kept").select(
        F.col("doc_id").alias("row_no"), "line_no"
    )
    line = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")
    left = rows.select("row_no", "doc_id", line).join(kept, ["row_no", "line_no"], "left_semi")
    lines = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return left.groupBy("row_no", "doc_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text")
    ).drop("row_no")
