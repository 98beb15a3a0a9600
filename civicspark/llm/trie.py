"""Conversation prefix trie: double arrays per prefix shard, shared upper nodes merged globally."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm.common import share_package
from civicspark.llm.shingles import mix
from civicspark.session import materialize

#: Turns that a shard gets on the average, where the session's shuffle partitions are too few for that.
SHARD_TURNS = 200_000
#: A node through which more than a shard's sequences over this go is an upper one.
UPPER_PARTS = 4
#: Free slots at which a node with several children is tried before it goes behind the last one.
TRIED_SLOTS = 1024
FREE = -1

TURNS = "array<struct<a:bigint,b:bigint,size:bigint>>"
PATHS = "conv_id long, end_a long, end_b long, a array<long>, b array<long>, size array<long>, path_a array<long>, path_b array<long>"
NODES = (
    "upper boolean, a long, b long, depth long, parent_a long, parent_b long, conv_id long, parent_conv_id long, "
    "n_convs long, size long, n_children long, n_leaves long, saved long"
)
NODE = ["a", "b"]
PARENT = ["parent_a", "parent_b"]


def sequences(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in their order, as 128 bits of role and text and the text's size.

    Turns without a number come first; turns equal in number go by their hash. A null role or
    text is empty. Rows without conv_id belong to no conversation. A conversation is one
    row of 24 bytes a turn; no text is shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(
        F.col(turn_col).cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"),
        F.char_length(text).cast("long").alias("size"),
    )
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("turn")).filter("conv_id is not null")
    ordered = F.sort_array(F.collect_list("turn"))
    return rows.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["a"], t["b"], t["size"])).cast(TURNS).alias("turns")
    )


def branched(convs: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """Conversations that begin alike, as an assistant's users would branch them.

    Conversation c gets the first h turns of conversation c - c % ``block`` (all if it has fewer,
    none if there is none) and its own turns after its first h, with h = crc32 of c % (``most`` + 1).
    """
    heads = convs.filter(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    head = F.slice(F.coalesce("_head", F.array().cast(TURNS)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.size("turns"))
    base = F.col("conv_id") - F.col("conv_id") % block
    return convs.withColumn("_base", base).join(heads, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sequence with a 128-bit hash of every prefix; that of the whole names its end."""
    for batch in batches:
        turns = batch.column("turns")
        cuts = turns.offsets.to_numpy().astype(np.int64)
        flat = turns.flatten()
        cuts = cuts - cuts[0]
        lengths = np.diff(cuts)
        keys = [flat.field(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in ("a", "b")]
        paths = [np.zeros(cuts[-1], np.uint64) for _ in keys]
        ends = [np.zeros(len(lengths), np.uint64) for _ in keys]
        active, depth = np.flatnonzero(lengths > 0), 0
        while len(active):
            at = cuts[active] + depth
            for side, (key, path, end) in enumerate(zip(keys, paths, ends, strict=True)):
                path[at] = end[active] = mix(mix(end[active] + np.uint64(2 * side + 1)) + key[at])
            depth += 1
            active = active[lengths[active] > depth]
        borders = pa.array(cuts.astype(np.int32))
        lists = [pa.ListArray.from_arrays(borders, pa.array(x.view(np.int64))) for x in keys]
        sizes = pa.ListArray.from_arrays(borders, flat.field("size"))
        lists += [sizes, *(pa.ListArray.from_arrays(borders, pa.array(x.view(np.int64))) for x in paths)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *(pa.array(x.view(np.int64)) for x in ends), *lists],
            names=["conv_id", "end_a", "end_b", "a", "b", "size", "path_a", "path_b"],
        )


class DoubleArray:
    """A trie over sequences of dense turn ids: the child of state s by id i is BASE[s] + i if CHECK has s there.

    ``keys``: turn ids from 0, one sequence after the other; ``cuts``: the sequences' borders.
    The ids are numbered anew, level by level, such that the children of a state mostly get neighbouring ones.
    """

    def __init__(self, keys: np.ndarray, cuts: np.ndarray):
        self.n_keys = int(keys.max()) + 1 if len(keys) else 0
        self.dense = np.zeros(self.n_keys, np.int64)
        self.base = np.zeros(16, np.int64)
        self.check = np.full(16, FREE, np.int64)
        self.check[0] = 0
        self._low, self._top, used = 1, 0, 0
        lengths = np.diff(cuts)
        state = np.zeros(len(lengths), np.int64)
        active, depth = np.flatnonzero(lengths > 0), 0
        while len(active):
            key = keys[cuts[active] + depth]
            pairs = np.unique(state[active] * self.n_keys + key)
            parent, label = np.divmod(pairs, self.n_keys)
            fresh = label[self.dense[label] == 0]
            new, first = np.unique(fresh, return_index=True)
            self.dense[new[np.argsort(first)]] = used + 1 + np.arange(len(new))
            used += len(new)
            self._place(parent, self.dense[label])
            state[active] = self.base[state[active]] + self.dense[key]
            depth += 1
            active = active[lengths[active] > depth]

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, FREE, np.int64)]

    def _free(self, n: int) -> np.ndarray:
        """The first ``n`` free slots."""
        self._grow(self._top + n + 2)
        found, at = [], self._low
        while n > 0:
            part = at + np.flatnonzero(self.check[at : at + 4 * n + 1024] == FREE)[:n]
            found.append(part)
            n -= len(part)
            at += 4 * n + 1024 if n else 0
            if n and at >= len(self.check):
                self._grow(at + n + 1)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _take(self, slots: np.ndarray, parent: np.ndarray | int) -> None:
        self.check[slots] = parent
        self._top = max(self._top, int(slots.max()))

    def _place(self, parent: np.ndarray, label: np.ndarray) -> None:
        """Slots for the children (parent, label), sorted by parent."""
        order = np.lexsort((label, parent))
        parent, label = parent[order], label[order]
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        count = np.diff(np.r_[first, len(parent)])
        for f, c in zip(first[count > 1], count[count > 1], strict=True):
            offsets = label[f : f + c] - label[f]
            slot = self._top + 1
            if c <= 64:
                tried = self._free(TRIED_SLOTS)
                self._grow(int(tried[-1] + offsets[-1]) + 1)
                fits = np.ones(len(tried), bool)
                for o in offsets[1:]:
                    fits &= self.check[tried + o] == FREE
                if fits.any():
                    slot = int(tried[np.argmax(fits)])
            self._grow(slot + int(offsets[-1]) + 1)
            self.base[parent[f]] = slot - label[f]
            self._take(slot + offsets, parent[f])
        single = first[count == 1]
        slots = self._free(len(single))
        self.base[parent[single]] = slots - label[single]
        if len(single):
            self._take(slots, parent[single])
        while self._low < len(self.check) and self.check[self._low] != FREE:
            taken = np.flatnonzero(self.check[self._low : self._low + 4096] == FREE)
            self._low += int(taken[0]) if len(taken) else min(4096, len(self.check) - self._low)

    def walk(self, keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The state after each turn of each sequence; -1 from the first one on that the trie does not have."""
        lengths = np.diff(cuts)
        state = np.zeros(len(lengths), np.int64)
        out = np.full(len(keys), -1, np.int64)
        active, depth = np.flatnonzero(lengths > 0), 0
        while len(active):
            key = keys[cuts[active] + depth]
            known = (key >= 0) & (key < self.n_keys)
            active, key = active[known], key[known]
            slot = self.base[state[active]] + self.dense[key]
            there = (slot > 0) & (slot < len(self.check)) & (self.dense[key] > 0)
            there[there] = self.check[slot[there]] == state[active][there]
            active, slot = active[there], slot[there]
            state[active] = out[cuts[active] + depth] = slot
            depth += 1
            active = active[lengths[active] > depth]
        return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard's sequences, with their sums over the shard.

    Sums of upper nodes leave out what upper nodes add themselves, which depends on all shards.
    """
    whole = [batch for batch in batches if batch.num_rows]
    if not whole:
        return
    table = pa.Table.from_batches(whole).combine_chunks()

    def column(name: str) -> np.ndarray:
        return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)

    def flat(name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    cuts = table.column("a").combine_chunks().offsets.to_numpy().astype(np.int64)
    cuts = cuts - cuts[0]
    lengths = np.diff(cuts)
    pairs = np.empty(cuts[-1], [("a", np.int64), ("b", np.int64)])
    pairs["a"], pairs["b"] = flat("a"), flat("b")
    _, keys = np.unique(pairs, return_inverse=True)
    trie = DoubleArray(keys, cuts)
    states = trie.walk(keys, cuts)

    # Traversal: slots in use, with what each sequence that goes through them brings.
    used = np.flatnonzero(trie.check != FREE)
    row_of = np.zeros(len(trie.check), np.int64)
    row_of[used] = np.arange(len(used))
    at = np.r_[np.zeros(len(lengths), np.int64), row_of[states]]
    owner = np.r_[np.arange(len(lengths)), np.repeat(np.arange(len(lengths)), lengths)]
    level = np.arange(cuts[-1]) - np.repeat(cuts[:-1], lengths) + 1
    n_convs = np.zeros(len(used), np.int64)
    np.add.at(n_convs, at, column("n")[owner])
    conv = np.full(len(used), np.iinfo(np.int64).max)
    np.minimum.at(conv, at, column("conv_id")[owner])
    depth, size, a, b = (np.zeros(len(used), np.int64) for _ in range(4))
    inner = at[len(lengths) :]
    depth[inner], size[inner], a[inner], b[inner] = level, flat("size"), flat("path_a"), flat("path_b")
    upper = np.zeros(len(used), bool)
    upper[0] = True
    upper[inner] = level <= np.repeat(column("n_upper"), lengths)
    parent = row_of[trie.check[used]]

    below = parent[1:]
    n_children = np.zeros(len(used), np.int64)
    np.add.at(n_children, below[~upper[1:]], 1)
    n_leaves = np.where(upper, 0, n_children == 0).astype(np.int64)
    saved = np.where(upper, 0, (n_convs - 1) * size)
    by_depth = np.argsort(depth, kind="stable")
    borders = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
    for d in range(int(depth.max()), 0, -1):
        nodes = by_depth[borders[d] : borders[d + 1]]
        np.add.at(n_leaves, parent[nodes], n_leaves[nodes])
        np.add.at(saved, parent[nodes], saved[nodes])
    columns = {
        "upper": pa.array(upper), "a": pa.array(a), "b": pa.array(b), "depth": pa.array(depth),
        "parent_a": pa.array(a[parent]), "parent_b": pa.array(b[parent]), "conv_id": pa.array(conv),
        "parent_conv_id": pa.array(conv[parent], mask=upper[parent]), "n_convs": pa.array(n_convs), "size": pa.array(size),
        "n_children": pa.array(n_children), "n_leaves": pa.array(n_leaves), "saved": pa.array(saved),
    }
    yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=50_000)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (end, conv_id) rows with one end, as the joined ids."""
    for batch in batches:
        a, b, ids = (batch.column(n).to_numpy() for n in ("end_a", "end_b", "conv_id"))
        if not len(ids):
            continue
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        text = [",".join(map(str, part)) for part in np.split(ids, first[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[first]), pa.array(b[first]), pa.array(ids[first]), pa.array(text, pa.string())],
            names=["a", "b", "first", "ids"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each end's joined runs, which come sorted; no end's ids are ever held together."""
    end, sha = None, None
    for batch in batches:
        found = []
        for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "ids")), strict=True):
            if (a, b) == end:
                sha.update(b",")
            else:
                if sha:
                    found.append((*end, sha.hexdigest()))
                end, sha = (a, b), hashlib.sha256()
            sha.update(ids.encode())
        yield _digest_batch(found)
    if sha:
        yield _digest_batch([(*end, sha.hexdigest())])


def _digest_batch(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, text = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.string())], names=["a", "b", "ends_sha256"]
    )


def _member_digests(members: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of each end: ids in order over ranges, so that a hot end is cut into several."""
    ranges = members.select("end_a", "end_b", "conv_id").repartitionByRange("end_a", "end_b", "conv_id")
    runs = ranges.sortWithinPartitions("end_a", "end_b", "conv_id").mapInArrow(_chunks, "a long, b long, first long, ids string")
    dealt = runs.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return dealt.mapInArrow(_digests, "a long, b long, ends_sha256 string")


def _subtree_sums(upper: DataFrame) -> DataFrame:
    """(a, b, leaves_above, saved_above): ``own_leaf`` and ``own_saved`` summed over the upper nodes of each subtree.

    By pointer doubling: what lies less than 2^k below a node is joined by what lies that far
    below the nodes 2^k below it, so the rounds grow with the logarithm of the depth only.
    """
    here = F.col("depth") > 0
    state = upper.select(
        *NODE, F.when(here, F.col("parent_a")).alias("up_a"), F.when(here, F.col("parent_b")).alias("up_b"),
        F.col("own_leaf").alias("leaf"), F.col("own_saved").alias("save"),
    )
    deepest = upper.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        state = materialize(state)
        sums = state.filter("up_a is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
            F.sum("leaf").alias("leaf2"), F.sum("save").alias("save2")
        )
        jump = state.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("up_a").alias("up_a2"), F.col("up_b").alias("up_b2"))
        state = (
            state.join(sums, NODE, "left")
            .join(jump, ["up_a", "up_b"], "left")
            .select(
                *NODE, F.col("up_a2").alias("up_a"), F.col("up_b2").alias("up_b"),
                (F.col("leaf") + F.coalesce("leaf2", F.lit(0))).alias("leaf"),
                (F.col("save") + F.coalesce("save2", F.lit(0))).alias("save"),
            )
        )
    return state.select(*NODE, F.col("leaf").alias("leaves_above"), F.col("save").alias("saved_above"))


def prefix_trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``convs`` (conv_id, turns) as ``sequences`` gives them, one row per conv_id. Each distinct
    sequence of the first d turns is a node at depth d, from the root without turns; conversations that
    begin with it are its members, one without turns is a member of the root only. ``conv_id`` is
    the least member, ``parent_conv_id`` the parent's (null for the root), ``n_leaves`` the childless
    nodes of the subtree, itself included, ``saved_tokens`` the sum over the subtree of (members - 1)
    times code points of the node's last text, ``ends_sha256`` the hash of the sorted ids of members with d turns.
    No conversation gives no node.

    Equal sequences become one with a count. A node with more sequences than a fraction of a
    shard is an upper one; below the upper nodes a subtree lies in one shard. A shard packs its sequences,
    upper part included, into a double array, whose traversal gives the nodes; upper nodes, which
    several shards have, are then added up. A prefix that many share is cut further down, so no
    shard gets it whole.
    """
    spark = convs.sparkSession
    share_package(spark)
    members = materialize(convs.select("conv_id", "turns").mapInArrow(_paths, PATHS))
    lists = ["a", "b", "size", "path_a", "path_b"]
    distinct = materialize(
        members.groupBy("end_a", "end_b").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first(F.struct(*lists)).alias("x")
        ).select("end_a", "end_b", "conv_id", "n", "x.*")
    )
    n_sequences, n_turns = distinct.agg(F.count("*"), F.sum(F.size("a"))).first()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n_turns or 0) // SHARD_TURNS))
    light = max(1, n_sequences // (UPPER_PARTS * shards))
    steps = distinct.select("end_a", "end_b", F.explode(F.arrays_zip("path_a", "path_b")).alias("p")).select(
        "end_a", "end_b", "p.path_a", "p.path_b"
    )
    heavy = materialize(steps.groupBy("path_a", "path_b").agg(F.count("*").alias("n")).filter(F.col("n") > light).drop("n"))
    # What leads to an upper node is upper as well: their number is the depth to which a sequence is.
    n_upper = steps.join(heavy, ["path_a", "path_b"], "left_semi").groupBy("end_a", "end_b").agg(F.count("*").alias("n_upper"))
    cut = [F.coalesce(F.get(f"path_{x}", F.col("n_upper").cast("int")), F.col(f"end_{x}")).alias(f"cut_{x}") for x in "ab"]
    dealt = (
        distinct.join(n_upper, ["end_a", "end_b"], "left")
        .withColumn("n_upper", F.coalesce("n_upper", F.lit(0)))
        .select("conv_id", "n", "n_upper", *lists, *cut)
        .repartition(shards, "cut_a", "cut_b")
    )
    nodes = materialize(dealt.drop("cut_a", "cut_b").mapInArrow(_pack, NODES))

    upper = nodes.filter("upper").groupBy("depth", *NODE, *PARENT).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("size").alias("size"),
        F.sum("n_children").alias("lower"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
    )
    upper = materialize(upper)
    kids = upper.filter("depth > 0").groupBy(*(F.col(p).alias(n) for p, n in zip(PARENT, NODE, strict=True))).agg(F.count("*").alias("kids"))
    upper = upper.join(kids, NODE, "left").withColumn("n_children", F.col("lower") + F.coalesce("kids", F.lit(0)))
    upper = materialize(
        upper.withColumn("own_leaf", (F.col("n_children") == 0).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("size"))
    )
    above = upper.select(*(F.col(n).alias(p) for p, n in zip(PARENT, NODE, strict=True)), F.col("conv_id").alias("above"))
    parent = F.when(F.col("depth") > 0, F.col("above")).alias("parent_conv_id")
    shown = [*NODE, "conv_id", "depth", parent, "n_convs", "n_children"]
    merged = upper.join(_subtree_sums(upper), NODE).join(above, PARENT, "left").select(
        *shown, (F.col("n_leaves") + F.col("leaves_above")).alias("n_leaves"),
        (F.col("saved") + F.col("saved_above")).alias("saved_tokens"),
    )
    lower = nodes.filter("not upper")
    tops = lower.filter("parent_conv_id is null").drop("parent_conv_id").join(above, PARENT)
    inner = lower.filter("parent_conv_id is not null").withColumnRenamed("parent_conv_id", "above")
    rest = inner.select(*tops.columns).unionByName(tops).select(*shown, "n_leaves", F.col("saved").alias("saved_tokens"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        merged.unionByName(rest)
        .join(_member_digests(members), NODE, "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", none))
        .drop(*NODE)
    )
