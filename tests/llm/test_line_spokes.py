"""How lines with a common band meet: packed keys, sketches, and buckets that several components share."""

from __future__ import annotations

import random
from functools import partial

import numpy as np
import pytest

from civicspark.llm import lines, links


def test_spokes_of_packed_keys(monkeypatch):
    monkeypatch.setattr(links, "HELD", 50)
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63, 90)[rng.integers(0, 90, 700)]
    nodes = rng.permutation(10**6)[:700]
    parts, want = {}, {}
    for a in range(0, 700, 70):
        packed = list(links._packed(keys[a : a + 70], nodes[a : a + 70], 5))
        assert sum(len(data) for _, data in packed) == 14 * 70
        for part, data in packed:
            parts.setdefault(part, []).append(data)
    for key, node in zip((keys.view(np.uint64) >> np.uint64(16)).tolist(), nodes.tolist(), strict=True):
        want.setdefault(key, set()).add(node)
    got, count = {}, 0
    for data in parts.values():
        for band, hub, node in links._spokes(data):
            count += len(node)
            for b, h, n in zip(band.tolist(), hub.tolist(), node.tolist(), strict=True):
                assert got.setdefault(b, {h})
                got[b].add(n)
    assert {k: v for k, v in want.items() if len(v) > 1} == got
    assert count == sum(len(v) - 1 for v in got.values())


def bucket():
    """Lines of one bucket: two groups of near copies, and lines that share a passage without being alike."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, texts = word(60), []
    for size in (25, 9):
        line = word(200)
        texts += [line[:at] + "#" + line[at + 1 :] for at in rng.sample(range(200), size)]
    return texts + [passage + word(80) for _ in range(12)]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_torn_bucket(spark, monkeypatch, most):
    monkeypatch.setattr(links, "PAIRS", most)
    texts = bucket()
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    contents = lines._sketched(spark.createDataFrame(list(enumerate(texts)), "node long, content string"), 3)
    rows = contents.collect()
    assert {r.node: r.n for r in rows} == {i: len(s) for i, s in enumerate(sets)}
    assert all(len(r.sketch) == 8 for r in rows)
    # The hub is a line that is like no other one.
    hub = len(texts) - 1
    spokes = spark.createDataFrame([(7, hub, i) for i in range(hub)], "band long, hub long, node long")
    items = partial(lines._line_items, points=3)

    def no_items(_):
        raise AssertionError("every run of every line of a small bucket is listed")

    found = links.components_of_spokes(spokes, contents, partial(lines.compare_lines, points=3), no_items if most else items, 80)
    head = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if head[i] != head[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((head[i], head[j]))
                head = [low if h == high else h for h in head]
    want = {i: h for i, h in enumerate(head) if head.count(h) > 1}
    assert len(want) == 34 and len(set(want.values())) == 2
    assert {r.node: r.component for r in found.collect()} == want


def test_plain_lines_like_python():
    rng = random.Random(2)
    texts = ["", "\n", " \n ", "A\t\tB\r\n C ", "\x0b\x0c", "Ä  É\n\n"]
    texts += ["".join(rng.choice(" \t\n\r\x0b\x0cAbÉ\x85 ") for _ in range(rng.randrange(30))) for _ in range(300)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got, owner, number = lines.plain_lines(data, np.r_[0, np.cumsum([len(t.encode()) for t in texts])])
    want = [(i, k, b" ".join(x.lower().split())) for i, t in enumerate(texts) for k, x in enumerate(t.encode().split(b"\n"))]
    assert list(zip(owner.tolist(), number.tolist(), got, strict=True)) == want


def test_compared_by_whole_sets(spark):
    pairs = [(0, 1, "abcdefghij", "abcdefghij"), (2, 3, "abcdefghijk", "abcdefghij"), (4, 5, "aaaa", "aaaaaaa"), (6, 7, "ab", "abc"), (8, 9, "abcdefg", "tuvwxyz")]
    df = spark.createDataFrame(pairs, "a long, b long, x string, y string")
    got = {r.a: r.linked for r in lines.compare_lines(df, 80, 3).collect()}
    assert got == {0: True, 2: True, 4: True, 6: False, 8: False}
