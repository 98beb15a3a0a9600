"""Lines that differ by one letter, in ASCII and in other scripts, as the query compares them."""

from __future__ import annotations

import random

import numpy as np
import pytest

from civicspark.llm import queries, shingles


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ", "日本語文字列処理検索重複行"])
def test_one_letter_edits(spark, tmp_path, letters):
    rng = random.Random(3)
    rows, want = [], {}
    for n in range(30, 81):
        line = "".join(rng.choice(letters) for _ in range(n))
        at = n // 2
        other = next(c for c in letters if c not in line[at - 3 : at + 4])
        edited = line[:at] + other + line[at + 1 :]
        have, with_edit = ({x[i : i + queries.LINE_POINTS] for i in range(n - queries.LINE_POINTS + 1)} for x in (line, edited))
        near = 100 * len(have & with_edit) >= 80 * len(have | with_edit)
        rows += [(2 * n, line), (2 * n + 1, edited)]
        want |= {2 * n: 2 * n, 2 * n + 1: 2 * n if near else 2 * n + 1}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_doc for r in queries.op9_fuzzy_line_dedup(spark, str(tmp_path)).collect()}
    assert got == want
    if len(letters) > 20:
        assert all(want[2 * n + 1] == 2 * n for n in range(30, 81))


def test_code_point_runs():
    texts = ["", "é", "日本", "abc", "aé日b", "xyzé"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    hashes, borders = shingles.point_shingles(data, offsets, 3)
    assert np.diff(borders).tolist() == [0, 1, 1, 1, 2, 2]
    assert len(set(hashes.tolist())) == len(hashes)
    none, cuts = shingles.point_shingles(data[:0], np.array([0, 0]), 3)
    assert len(none) == 0 and cuts.tolist() == [0, 0]
