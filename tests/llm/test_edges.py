"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from civicspark.llm.decontam import contained_items, decontaminate
from civicspark.llm.gam import quality_scores
from civicspark.llm.imatch import fingerprints
from civicspark.llm.licences import scan, templates
from civicspark.llm.lines import drop_duplicate_lines, duplicate_lines
from civicspark.llm.mixing import mix
from civicspark.llm.neardup import near_duplicates
from civicspark.llm.sharding import shard
from civicspark.llm.tokens import token_counts
from civicspark.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, source string, node long, size long, score double, path string"
LONG = " ".join(f"word{i}" for i in range(30_000))
SAME = "one two three four five six seven eight nine ten"
ROWS = [
    (1, SAME, "a"), (1, SAME, "a"), (2, SAME + " ", "a"), (3, None, "a"), (4, "", None), (5, " \n\t", "b"),
    (6, LONG, "b"), (None, SAME, None), (None, "alone", "b"), (7, "two words", "a"), (8, "Two\nwords", "c"),
    (-9, "é 日本 <|endoftext|> it's  12\n\n x", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, 7, 0.5, "p") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 0), (3, None, None)],
                                 "doc_id long, quality int, toxic int")


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    got = sorted(map(tuple, token_counts(docs, tokenizer()).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t, _ in ROWS]
    assert got == sorted(want, key=str)
    assert token_counts(none, tokenizer()).count() == 0


def test_fingerprints(docs, none):
    rows = fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_chars == len(SAME) and by_id[3].n_chars == 0
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert by_id[3].fingerprint == by_id[4].fingerprint and by_id[4].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints(none).count() == 0


def test_shards(docs, none):
    rows = shard(docs.select("doc_id", "text"), ["doc_id", "text"], 5).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {2, 3} and len(rows) == len(ROWS)
    assert shard(none.select("doc_id"), ["doc_id"], 5).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(1, "Three  four five SIX seven\neight nine", 1), (2, "two words", 1), (3, None, 1), (4, "", 1), (None, "no such words here at all", 1)],
        "item_id long, text string, n_item int",
    )
    got = {tuple(r) for r in contained_items(docs, items).collect()}
    assert got == {(1, 1, 3, 3), (2, 1, 3, 3), (None, 1, 3, 3), (7, 2, 1, 1), (8, 2, 1, 1)}
    left = decontaminate(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {3, 4, 5, 6, -9}
    assert contained_items(none, items).count() == contained_items(docs, items.limit(0)).count() == 0


def test_long_document_holds_short_item(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG.replace("word20003 ", "other "))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20_000, 20_012)))], "item_id long, text string")
    assert [tuple(r) for r in contained_items(docs, items).collect()] == [(1, 1, 8, 8)]


@pytest.mark.parametrize("operator", [quality_scores, toxicity])
def test_scores(operator, docs, none, labels):
    rows = operator(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert operator(none, labels).count() == 0
    assert len({r.score for r in operator(docs, labels.limit(0)).collect()}) == 1


def test_licences(spark):
    files = spark.createDataFrame(
        [
            (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this "
             "software and associated documentation files."),
            (2, "a/b/c.txt", "some text"), (3, "a/b/d.txt", "x y z\nLicensed under the Apache License, Version 2.0.\n" + " ".join(f"w{i}" for i in range(30))),
            (4, "e/f.txt", "some text"), (5, None, "Released under the MIT License."), (6, "a/g", None), (6, "a/g", None),
            (None, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, "top", ""),
        ],
        "file_id long, path string, text string",
    )
    got = {(r.file_id, r.licence, r.found_in, r.licence_dir) for r in scan(files, templates(spark)).collect()}
    assert got == {
        (1, "MIT", "file", "a"), (2, "GPL-3.0", "directory", "a/b"), (3, "Apache-2.0", "header", None), (4, None, None, None),
        (5, "MIT", "file", None), (6, "MIT", "directory", "a"), (None, "GPL-3.0", "file", "a/b"), (7, None, None, None),
    }
    assert scan(files.limit(0), templates(spark)).count() == 0


def test_mixing(docs, none):
    rows = mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.copies <= 2 for r in rows)
    sizes = {r.source: r.source_size for r in rows}
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(r.copies == 0 for r in rows if r.size == 0)
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(3)).collect()))
    assert mix(none).count() == 0


def test_near_duplicates(docs, none):
    rows = near_duplicates(docs).collect()
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == len(ROWS)
    assert {(1, 6, 1, True), (2, 6, 1, False), (3, 0, 3, True), (5, 0, 5, True), (7, 1, 7, True), (8, 1, 7, False)} <= found
    assert {(None, 6, 1, False), (None, 1, None, True)} <= found
    assert near_duplicates(none).count() == 0


def test_lines(spark, docs, none):
    rows = duplicate_lines(docs).collect()
    assert len(rows) == sum(len((t or "").split("\n")) for _, t, _ in ROWS)
    assert all(r.kept for r in rows if r.doc_id in (3, 4, 5))
    assert {(r.doc_id, r.class_doc) for r in rows if r.doc_id in (2, 7)} == {(2, None), (7, 7)}
    assert duplicate_lines(none).count() == 0
    text = "the same rather long line of text, again\nanother line"
    twice = spark.createDataFrame([(1, text), (2, text.upper().replace("AGAIN", "AGAIM"))], "doc_id long, text string")
    assert {tuple(r) for r in drop_duplicate_lines(twice).collect()} == {(1, text)}


def test_clashing_names(docs):
    clash = docs.select("*", F.lit(1).alias("bands"), F.lit(1).alias("component_id"), F.lit(1).alias("line_no"), F.lit(1).alias("hub"))
    assert near_duplicates(clash).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert duplicate_lines(clash).columns == ["doc_id", "line_no", "class_doc", "class_line", "kept"]
