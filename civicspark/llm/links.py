"""From MinHash bands to linked components, without listing the pairs of a bucket.

A bucket of m nodes gives m - 1 pairs, each node with the bucket's hub, and hubs differ from
band to band. All pairs are verified on whole sets. Where a hub turns out not to be linked to
a member, the other members might be: such buckets, if their members are not in one component
by then, are searched again exactly, by the rarest items that two linked sets must share
(prefix filter), and only across components. So hot buckets of true copies cost one pair a
member, and buckets that share a common passage without being alike fall apart on their rare
items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import share_package, sieve
from civicspark.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the least node reachable.

    Alternating large-star and small-star steps: every step is a grouped minimum and a join,
    so no component is gathered anywhere, and each round's edges are a written table.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # Larger neighbours go to the least of the neighbourhood.
        large = (
            both.join(least, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        edges = materialize(small)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == before:
            break
        before = tuple(row)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _alike(percent: int, shared: Column, a: Column, b: Column) -> Column:
    return shared * 100 >= percent * (a + b - shared)


def compare_sets(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b, x, y) with the whole sets x and y."""
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b", _alike(percent, shared, F.size("x"), F.size("y")).alias("linked"))


def _with_content(pairs: DataFrame, content: DataFrame) -> DataFrame:
    left = content.select(F.col("node").alias("a"), F.col("content").alias("x"))
    right = content.select(F.col("node").alias("b"), F.col("content").alias("y"))
    return pairs.join(left, "a").join(right, "b")


def _across(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``sets`` in different components that may be linked: all of them.

    Two sets that share ``need`` items share one among the rarest n - need + 1 of each, and
    ``need`` is t n for any partner, more for a partner of known size. Per item, the nodes
    outside its largest component meet all others.
    """
    nodes = (
        sets.join(labels, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"), F.size("items").alias("n"), "items")
    )
    items = nodes.select("node", "component", "n", F.explode("items").alias("item"))
    seen = items.groupBy("item").agg(F.count("*").alias("seen"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    rare = (
        items.join(seen, "item")
        .groupBy("node", "component", "n")
        .agg(F.sort_array(F.collect_list(F.struct("seen", "item"))).alias("ranked"))
        .select("node", "component", "n", F.posexplode(F.slice("ranked", 1, first.cast("int"))).alias("pos", "r"))
        .filter("r.seen > 1")
        .select("node", "component", "n", (F.col("pos") + 1).alias("pos"), F.col("r.item").alias("item"))
    )
    rare = materialize(rare)
    largest = (
        rare.groupBy("item", "component")
        .agg(F.count("*").alias("c"))
        .groupBy("item")
        .agg(F.max(F.struct("c", "component")).getField("component").alias("largest"), F.count("*").alias("parts"))
        .filter("parts > 1")
        .drop("parts")
    )
    shared = rare.join(largest, "item")
    some = shared.filter("component <> largest").select(
        "item", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa")
    )
    other = shared.select(
        "item", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"),
        (F.col("component") == F.col("largest")).alias("big"),
    )
    # Linked sets of these sizes share so many items that the first common one stands this far ahead.
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(percent) / F.lit(100 + percent))
    # What they can share at most, up to this item and after it.
    room = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    near = (F.col("pa") + need <= F.col("na") + 1) & (F.col("pb") + need <= F.col("nb") + 1) & (room >= need)
    return (
        some.join(other, "item")
        .filter(F.col("ca") != F.col("cb"))
        .filter(F.col("big") | (F.col("a") < F.col("b")))  # two small components meet once
        .filter(near)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def linked_components(
    signatures: DataFrame,
    content: Callable[[DataFrame], DataFrame],
    compare: Callable[[DataFrame, int], DataFrame],
    items: Callable[[DataFrame], DataFrame],
    percent: int,
) -> DataFrame:
    """(node, component) of all nodes linked with another one.

    ``signatures``: (node, bands) of the distinct sets; a repeated row does no harm.
    ``content(nodes)``: (node, content) of the asked nodes, one row each. ``compare``: from
    pairs with both contents x and y to (a, b, linked). ``items``: from contents to (node,
    items). Two sets are linked if 100 * intersection >= percent * union.
    """
    keyed = signatures.select("node", F.explode("bands").alias("band"))
    # The exclusive or with the band's key makes another node the least one in each band.
    turned = F.col("node").bitwiseXOR(F.col("band"))
    buckets = materialize(
        keyed.groupBy("band")
        .agg(F.min(turned).alias("least"), F.max(turned).alias("most"))
        .filter("least <> most")
        .select("band", F.col("least").bitwiseXOR(F.col("band")).alias("hub"))
    )
    shared_band = sieve(buckets, "band")
    members = materialize(keyed.filter(shared_band(F.col("band"))).join(buckets, "band").distinct())
    pairs = materialize(
        members.filter("node <> hub")
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    contents = materialize(content(materialize(asked)))
    checked = materialize(compare(_with_content(pairs, contents), percent))
    labels = components(checked.filter("linked").select("a", "b"))

    # Bands with a hub that is not linked to every member, whose members are not one component.
    refused = checked.filter("not linked").select("a", "b")
    spokes = members.filter("node <> hub").select(
        "band", F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    )
    open_bands = spokes.join(refused, ["a", "b"]).select("band").distinct()
    label = F.coalesce("component", "node")
    torn = (
        members.join(open_bands, "band")
        .join(labels, "node", "left")
        .groupBy("band")
        .agg(F.min(label).alias("low"), F.max(label).alias("high"), F.count("*").alias("size"))
        .filter("low <> high and size > 2")
        .select("band")
    )
    left_over = materialize(members.join(torn, "band", "left_semi").select("node").distinct())
    if left_over.isEmpty():
        return labels
    again = items(contents.join(left_over, "node", "left_semi"))
    more = materialize(_across(again, labels, percent))
    found = compare(_with_content(more, contents), percent).filter("linked").select("a", "b")
    # The components so far stand for their links.
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))


#: Bytes of a band's key that are shuffled, the upper ones: two other bands have them in common once in 2^48.
KEY_BYTES = 6
#: Keys that a task holds before it looks for equal ones.
HELD = 1 << 20


def _packed(keys: np.ndarray, nodes: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """The keys and nodes of each part, a range of keys: all first bytes of its keys, all second, ..., then the nodes."""
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    cuts = np.searchsorted(keys >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
    upper = (keys >> np.uint64(64 - 8 * KEY_BYTES)).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    for part in np.flatnonzero(np.diff(cuts)):
        of = slice(cuts[part], cuts[part + 1])
        yield int(part), upper[of].T.tobytes() + nodes[of].tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (KEY_BYTES + 8)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :KEY_BYTES] = np.frombuffer(data, np.uint8, n * KEY_BYTES).reshape(KEY_BYTES, n).T
    return keys.view(np.int64).ravel(), np.frombuffer(data[n * KEY_BYTES :], np.int64)


def _spokes(rows: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, hubs and nodes: every node but the first of its key. Held are the first ones and a part of the others."""
    keys, hubs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, count = [], 0

    def settle():
        nonlocal keys, hubs
        all_keys = np.concatenate([keys, *(k for k, _ in held)])
        all_nodes = np.concatenate([hubs, *(n for _, n in held)])
        order = np.argsort(all_keys, kind="stable")
        all_keys, all_nodes = all_keys[order], all_nodes[order]
        first = np.r_[True, all_keys[1:] != all_keys[:-1]]
        keys, hubs = all_keys[first], all_nodes[first]
        spoke = np.flatnonzero(~first)
        return all_keys[spoke], hubs[np.cumsum(first)[spoke] - 1], all_nodes[spoke]

    for data in rows:
        held.append(_unpacked(data))
        count += len(held[-1][0])
        if count >= max(HELD, len(keys)):
            yield settle()
            held, count = [], 0
    if count:
        yield settle()


def spokes_of_bands(
    rows: DataFrame, sign: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]
) -> DataFrame:
    """(band, hub, node): of the nodes that have a band in common one is its hub, each other one gives a row.

    ``sign`` makes arrays of band keys, and of the node of each, from ``rows``; a node has a key once.
    Keys and nodes are shuffled as packed arrays by ranges of the keys, one range a partition.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        def rows_of(signed):
            keys, nodes = (np.concatenate(x) for x in zip(*signed, strict=True))
            part, data = zip(*_packed(keys, nodes, parts), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

        signed, count = [], 0
        for keys, nodes in sign(batches):
            if len(keys):
                signed.append((keys, nodes))
                count += len(keys)
            if count >= HELD // 2:
                yield rows_of(signed)
                signed, count = [], 0
        if signed:
            yield rows_of(signed)

    def meet(batches):
        for found in _spokes(x.as_py() for batch in batches for x in batch.column("data")):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["band", "hub", "node"])

    share_package(spark)
    packed = rows.mapInArrow(pack, "part int, data binary").repartitionById(parts, F.col("part"))
    return packed.select("data").mapInArrow(meet, "band long, hub long, node long")


#: Buckets with so many pairs of a node outside the largest component and another one, or fewer, are searched pair by pair.
PAIRS = 1 << 20


def _may_link(percent: int, a: str, b: str) -> Column:
    """Whether two sets may be linked, by their sizes and sketches: a slot that one of them fills alone holds an element of it alone."""
    (na, nb), (sa, sb) = (f"n{a}", f"n{b}"), (f"sketch{a}", f"sketch{b}")
    apart = sum(F.bit_count(F.get(sa, F.lit(i)).bitwiseXOR(F.get(sb, F.lit(i)))) for i in range(8))
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return sizes & (apart * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent))


def components_of_spokes(
    spokes: DataFrame,
    contents: DataFrame,
    compare: Callable[[DataFrame, int], DataFrame],
    items: Callable[[DataFrame], DataFrame],
    percent: int,
) -> DataFrame:
    """(node, component) of all nodes linked with another one of a common bucket.

    ``spokes``: (band, hub, node) of buckets of two nodes and more; ``contents``: (node, n, sketch, content)
    of their nodes, n the size of the set, sketch 512 slots that it fills or not; the others as for
    ``linked_components``. Every member meets its bucket's hub. Where the members are not one component
    then, all outside the largest one meet the members of other components. Buckets where these are more than
    ``PAIRS`` pairs get up to four more hubs, and if they are still torn the members that were no hub are searched
    exactly, each bucket by itself, by the rarest items inside it: no two linked members of a bucket end in
    different components, and work grows with the members.
    Pairs that cannot be linked by their sketches are left out before any content is fetched.
    """
    sketches = contents.select("node", "n", "sketch")

    def sketch(end: str) -> DataFrame:
        return sketches.select(*(F.col(c).alias(c if c == "node" else c + end) for c in sketches.columns))

    pair = F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")

    def linked(pairs: DataFrame) -> DataFrame:
        return compare(_with_content(materialize(pairs), contents), percent).filter("linked").select("a", "b")

    def met(rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of ``rows`` (node, hub) that may be linked."""
        both = rows.select(*pair).distinct().join(sketch("_a").withColumnRenamed("node", "a"), "a")
        both = both.join(sketch("_b").withColumnRenamed("node", "b"), "b")
        return both.filter(_may_link(percent, "_a", "_b")).select("a", "b")

    labels = components(linked(met(spokes)))

    def torn(rows: DataFrame, found: DataFrame) -> DataFrame:
        """``rows`` (band, node) of the bands with several components, with the component, the largest one and the pairs to search."""
        named = rows.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
        parts = named.groupBy("band", "component").agg(F.count("*").alias("c"))
        several = parts.groupBy("band").agg(
            F.max_by("component", "c").alias("largest"),
            F.count("*").alias("parts"),
            ((F.sum("c") - F.max("c")) * F.sum("c")).alias("pairs"),
        )
        return materialize(named.join(several.filter("parts > 1").drop("parts"), "band"))

    # The hub has met all others, so only its spokes can still be apart.
    rest = torn(spokes.select("band", "node"), labels)
    if rest.isEmpty():
        return labels
    few = rest.filter(F.col("pairs") <= PAIRS).drop("pairs").join(sketches, "node")
    one, other = (few.select("band", *(F.col(c).alias(c + end) for c in few.columns if c != "band")) for end in ("_a", "_b"))
    pairs = (
        one.filter("component_a <> largest_a")
        .join(other, "band")
        .filter("component_a <> component_b and (component_b = largest_b or node_a < node_b)")
        .filter(_may_link(percent, "_a", "_b"))
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    )
    many = rest.filter(F.col("pairs") > PAIRS).select("band", "node", "component")
    larger = not many.isEmpty()
    if larger:
        by, otherwise, one = F.xxhash64("node", "band"), F.xxhash64("band", "node"), F.struct("node", "component")
        picks = [f(one, turned) for f in (F.min_by, F.max_by) for turned in (by, otherwise)]
        hubs = many.groupBy("band").agg(F.array_distinct(F.array(*picks)).alias("hubs"))
        hubs = hubs.select("band", F.explode("hubs").alias("h")).select(
            "band", F.col("h.node").alias("hub"), F.col("h.component").alias("hub_component")
        )
        hubs = materialize(hubs)
        pairs = pairs.unionByName(met(many.join(hubs, "band").filter("component <> hub_component")))
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = components(known.unionByName(linked(pairs.distinct())))
    if not larger:
        return labels

    rest = many.join(hubs.select("band", F.col("hub").alias("node")), ["band", "node"], "left_anti").select("band", "node")
    rest = torn(rest, labels).select("band", "node", "component")
    if rest.isEmpty():
        return labels
    # A node stands for itself in each of its torn buckets, and so do its items.
    rest = rest.withColumn("own", F.xxhash64("band", "node"))
    sets = items(contents.join(rest.select("node").distinct(), "node", "left_semi"))
    sets = rest.join(sets, "node").select(
        F.col("own").alias("node"), F.transform("items", lambda x: F.xxhash64("band", x)).alias("items")
    )
    more = _across(sets, rest.select(F.col("own").alias("node"), "component"), percent)
    left, right = (rest.select(F.col("own").alias(c), F.col("node").alias(f"{c}_node")) for c in "ab")
    more = more.join(left, "a").join(right, "b").select(F.col("a_node").alias("node"), F.col("b_node").alias("hub"))
    found = linked(met(more))
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
