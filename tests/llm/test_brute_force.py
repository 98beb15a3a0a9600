"""Operators and pipeline stages over whole small tables, against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from civicspark.llm import queries
from civicspark.llm.common import table
from civicspark.llm.lines import duplicate_lines
from civicspark.llm.sharding import locate, permute, row_at

SF_DIR = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs(words):
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def components(sets, percent):
    """The least key reachable from each key of ``sets``, over all pairs that share an element."""
    holders = defaultdict(list)
    for key, items in sets.items():
        for item in items:
            holders[item].append(key)
    shared = Counter((a, b) for keys in holders.values() for i, a in enumerate(keys) for b in keys[i + 1 :])
    head = {key: key for key in sets}

    def find(key):
        while head[key] != key:
            key = head[key]
        return key

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            head[high] = low
    return {key: find(key) for key in sets}


def near(texts, percent=85):
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: runs(WORDS.findall((t or "").translate(LOWER))) for i, t in texts.items()}
    found = components(sets, percent)
    return {i: (len(sets[i]), found[i]) for i in texts}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()}


def test_near_duplicates(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_minhash_near_dedup(spark, SF_DIR).collect()}
    want = near(texts)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_lines(spark):
    docs = table(spark, SF_DIR, "documents").filter("length(text) < 2000")
    lines, sets = {}, {}
    for r in docs.collect():
        for number, raw in enumerate(r.text.split("\n")):
            line = " ".join(WORDS.findall(raw.translate(LOWER))).encode()
            lines[r.doc_id, number] = line
            sets.setdefault(line, {line[i : i + 8] for i in range(max(len(line) - 7, 1))} if line else set())
    head = components(sets, 80)
    least = {}
    for place, line in sorted(lines.items()):
        least.setdefault(head[line] if line else place, place)
    want = {(*place, *(least[head[line]] if line else place)) for place, line in lines.items()}
    rows = duplicate_lines(docs).collect()
    assert {(r.doc_id, r.line_no, r.class_doc, r.class_line) for r in rows} == want
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_doc, r.class_line)) for r in rows)


def test_edited_texts(spark, texts):
    order = sorted(texts, reverse=True)
    want = {}
    for i, doc_id in enumerate(order):
        text, after = texts[doc_id] or "", texts[order[(i + 1) % len(order)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        want[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest())
    rows = queries.op2_imatch_fingerprints(spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r.doc_id]].add(r.fingerprint)
        by_text[want[r.doc_id][1], "edited"].add(r.edited_fingerprint)
        assert r.near_edited == 1 or r.fingerprint != r.edited_fingerprint
    assert all(len(prints) == 1 for prints in by_text.values())


@pytest.mark.parametrize("n", [1, 2, 3, 24, 1000, 4097])
def test_permutation(n):
    place = permute(np.arange(n), n, 3)
    assert sorted(place) == list(range(n))
    assert (permute(place, n, 3, back=True) == np.arange(n)).all()
    assert all(row_at(*locate(row, n, 5), n, 5) == row for row in range(min(n, 50)))


def test_mix_meets_targets(spark, texts):
    rows = queries.op7_pareto_mixing(spark, SF_DIR).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(WORDS.findall(t or "")) for i, t in texts.items()}
    size, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        size[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    sources = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    # Sources that reach their limit leave their excess to the others.
    open_, full, left = set(sources), {}, 1.5 * sum(size.values())
    while over := {s for s in open_ if left * weight[s] > 2 * size[s] * sum(weight[o] for o in open_)}:
        full |= {s: 2 * size[s] for s in over}
        left, open_ = left - sum(2 * size[s] for s in over), open_ - over
    target = full | {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
    assert {r.source: r.target for r in rows} == pytest.approx(target)
    assert {r.source: r.source_size for r in rows} == dict(size)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sources)


def test_pipeline_stages(spark):
    """Each stage against what its own input asks for."""
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    def step(name, before):
        after = corpus_pipeline.materialize(stage[name](spark, before, SF_DIR))
        assert name == "sharding" or after.columns == columns
        return after, [r.asDict() for r in after.collect()]

    predicted = {r.doc_id: r.predicted for r in queries.op5_quality_classifier(spark, SF_DIR).collect()}
    docs, rows = step("quality classifier", docs)
    assert {r["doc_id"] for r in rows} == {i for i, p in predicted.items() if p}

    # No contract names another likeness for the stage than the 0.8 of all stages on word shingles.
    want = {i for i, (_, c) in near({r["doc_id"]: r["text"] for r in rows}, 80).items() if c == i}
    docs, rows = step("MinHash near-dedup", docs)
    assert sorted(r["doc_id"] for r in rows) == sorted(want)

    items = [runs(WORDS.findall(r.text.lower())) for r in table(spark, SF_DIR, "benchmark").collect()]
    held = {
        r["doc_id"]
        for r in rows
        for have in [runs(WORDS.findall((r["text"] or "").lower()))]
        if any(item and 100 * len(item & have) >= 80 * len(item) for item in items)
    }
    before = {r["doc_id"] for r in rows}
    docs, rows = step("benchmark decontamination", docs)
    assert held and {r["doc_id"] for r in rows} == before - held

    before = {r["doc_id"]: r for r in rows}
    docs, rows = step("mixing sources to target weights", docs)
    copies = Counter(r["doc_id"] for r in rows)
    assert set(copies) <= set(before) and max(copies.values()) <= 2
    assert all(r == before[r["doc_id"]] for r in rows)

    _, placed = step("sharding", docs)
    assert Counter(r["doc_id"] for r in placed) == copies
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == queries.SHARDS and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_runs_all_stages(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "shard", "slot"} <= set(got.columns)
    assert got.groupBy("shard", "slot").count().filter(F.col("count") > 1).isEmpty()
