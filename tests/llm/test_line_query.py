"""The line query against plain Python over every line of a small table, and its parts."""

from __future__ import annotations

import re

import numpy as np

from civicspark.llm import lines, queries, shingles
from civicspark.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def classes(sets):
    """line -> the least line reachable from it over pairs of 0.8 and more."""
    head = {line: line for line in sets}

    def find(line):
        while head[line] != line:
            line = head[line]
        return line

    order = sorted(sets, key=lambda line: len(sets[line]))
    for i, one in enumerate(order):
        for other in order[i + 1 :]:
            if 100 * len(sets[one]) < 80 * len(sets[other]):
                break
            shared = len(sets[one] & sets[other])
            if 100 * shared >= 80 * (len(sets[one]) + len(sets[other]) - shared):
                low, high = sorted((find(one), find(other)))
                head[high] = low
    return {line: find(line) for line in sets}


def test_every_line_of_the_table(spark):
    places, sets = {}, {}
    for r in table(spark, SF_DIR, "documents").collect():
        for number, raw in enumerate((r.text or "").split("\n")):
            line = " ".join(re.findall(r"[^\x20\x09-\x0D]+", raw.translate(LOWER)))
            places[r.doc_id, number] = line
            if line:
                width = queries.LINE_POINTS
                sets[line] = {line[i : i + width] for i in range(max(len(line) - width + 1, 1))}
    head, least = classes(sets), {}
    for place, line in sorted(places.items()):
        least.setdefault(head[line] if line else place, place)
    want = {(*place, *(least[head[line]] if line else place)) for place, line in places.items()}
    rows = queries.op9_fuzzy_line_dedup(spark, SF_DIR).collect()
    assert {(r.doc_id, r.line_no, r.class_doc, r.class_line) for r in rows} == want
    assert len(rows) == len(places)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_doc, r.class_line)) for r in rows)


def test_lines_of_one_letter_repeated(spark, tmp_path):
    texts = ["aaa", "aaaa", "a" * 60, "ha " * 9 + "ha", "ha " * 99 + "ha", "b", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_doc for r in queries.op9_fuzzy_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}


def test_rejected_pairs_are_never_alike():
    rng = np.random.default_rng(5)
    for size in (1, 30, 400, 3000):
        sets = [rng.integers(0, 2**64, size, dtype=np.uint64) for _ in range(20)]
        other = [np.r_[x[: size - k], rng.integers(0, 2**64, k, dtype=np.uint64)] for k, x in zip(np.linspace(0, size, 20).astype(int), sets)]
        x, y = np.concatenate(sets), np.concatenate(other)
        cuts = np.arange(21) * size
        kept = set(lines._maybe_alike(x, cuts, y, cuts, 80).tolist())
        for i, (a, b) in enumerate(zip(sets, other)):
            shared = len(np.intersect1d(a, b))
            assert i in kept or 100 * shared < 80 * (2 * size - shared)


def test_variety_counts_runs():
    texts = ["", "ab", "x" * 500, "".join(chr(200 + i) for i in range(60))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    filled = lines.variety(data, offsets)
    assert filled[:3].tolist() == [0, 2, 1] and 45 <= filled[3] <= 58
    assert len(shingles.point_shingles(data, offsets, 3)[1]) == 5
