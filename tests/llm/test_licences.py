"""Licence scans: frequencies of all terms, and directories of the query."""

from __future__ import annotations

import zlib

import pytest

from civicspark.llm import queries
from civicspark.llm.licences import scan, templates


@pytest.mark.parametrize("n", [40, 4000])
def test_common_words_around_a_notice(spark, n):
    """Words that most files hold weigh little at any number of files."""
    rows = [(i, f"s/{i}", "it was a long way to the sea") for i in range(n)]
    rows.append((n, "t/x", "It was released under the MIT License.\n" + "\n".join(f"w{i} v{i}" for i in range(20))))
    files = spark.createDataFrame(rows, "file_id long, path string, text string").repartition(4)
    got = {r.file_id: r for r in scan(files, templates(spark)).filter("licence is not null").collect()}
    assert set(got) == {n} and got[n].licence == "MIT" and got[n].found_in == "header"
    assert got[n].cosine > 0.95


def test_files_inherit_over_several_levels(spark, tmp_path):
    level = {i: zlib.crc32(str(i).encode()) % 10 for i in range(1000, 6000)}
    top = next(i for i in level if i >= 5000 and level[i] == 0)
    middle = next(i for i in level if 2000 <= i < 3000 and level[i] == 1)
    low = next(i for i in level if 1000 <= i < 2000 and level[i] > 1)
    other = next(i for i in level if 2000 <= i < 3000 and level[i] > 1)
    rows = [
        (top, "Released under the MIT License.", "a"), (low, "plain words", "a"), (middle, "Licensed under CC BY 4.0.", "a"),
        (other, "plain words", "a"), (other + 1000, "plain words", "b"), (None, "plain words", "a"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.licence, r.found_in, r.licence_dir) for r in queries.op6_licence_scan(spark, str(tmp_path)).collect()}
    assert got == {
        top: ("MIT", "file", "a"), low: ("MIT", "directory", "a"), middle: ("CC-BY-4.0", "file", "a/2"),
        other: ("CC-BY-4.0", "directory", "a/2"), other + 1000: (None, None, None), None: (None, None, None),
    }
