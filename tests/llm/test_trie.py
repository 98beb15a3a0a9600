"""The prefix trie against one of dictionaries, and the double array itself."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from civicspark.llm import queries
from civicspark.llm.common import table
from civicspark.llm.trie import DoubleArray, branched, prefix_trie, sequences

SF_DIR = "/root/testdata/sf0.01"


def plain_sequences(rows):
    """conv_id -> [(role, text)] of rows (conv_id, turn, role, text) whose turns differ."""
    out = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1])):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def plain_branched(convs):
    def one(c):
        h = zlib.crc32(str(c).encode()) % 6
        return convs.get(c - c % 100, [])[:h] + convs[c][h:]

    return {c: one(c) for c in convs}


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) if below else 1
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = own + sum(saved[x] for x in below)
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), len(children.get(path, [])), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def fixture():
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t}" if c % 3 else f"é日{t % 2}") for c in range(95, 330) for t in range(c % 7)]
    rows += [(1000, t, "user", str(t % 3)) for t in range(400)] + [(1001, t, "user", str(t % 3)) for t in range(390)]
    rows += [(7, None, "user", "no number"), (7, 0, None, "x"), (7, 1, "user", None), (8, 3, "", "x"), (-5, 0, "a", "b")]
    rows += [(c, t, "user", "alike") for c in range(2000, 2300) for t in range(4)] + [(None, 0, "user", "x")] * 2
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    schema = "conv_id long, turn long, role string, text string, a long, turns string, upper int"
    return spark.createDataFrame([(*r, 1, "x", 2) for r in fixture()], schema).repartition(3)


@pytest.mark.parametrize("shards", [1, 4, 60])
def test_fixture(conversations, shards):
    got = prefix_trie(sequences(conversations), shards)
    assert rows_of(got) == plain_trie(plain_sequences(fixture()))


def test_branched_conversations(conversations):
    want = plain_branched({c: t for c, t in plain_sequences(fixture()).items() if c >= 0})
    got = prefix_trie(branched(sequences(conversations.filter("conv_id >= 0"))), 9)
    assert rows_of(got) == plain_trie(want)
    assert any(not t for t in want.values())


def test_ties_and_repeated_rows(spark):
    rows = [(1, 0, "u", "x"), (1, 0, "u", "y"), (2, 0, "u", "y"), (2, 0, "u", "x"), (3, 0, "u", "x"), (3, 0, "u", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by_depth = [(r.conv_id, r.n_convs, r.n_children) for r in prefix_trie(sequences(frame)).orderBy("depth", "conv_id").collect()]
    assert by_depth[0] == (1, 3, 2 if len(by_depth) == 5 else 1)  # 1 and 2 are alike, 3 says x twice
    assert sorted(n for _, n, _ in by_depth[1:]) in ([1, 1, 2, 2], [1, 2, 3])


def test_empty_table(conversations):
    assert rows_of(prefix_trie(branched(sequences(conversations.limit(0))))) == []
    assert rows_of(prefix_trie(sequences(conversations.filter("conv_id is null")))) == []


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF_DIR, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op11_prefix_trie(spark, SF_DIR)) == plain_trie(plain_branched(plain_sequences(rows)))


@pytest.mark.parametrize("seed", range(20))
def test_double_array(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 8, 300)
    cuts = np.r_[0, np.cumsum(lengths)]
    keys = np.unique(rng.integers(0, rng.integers(2, 400), cuts[-1]), return_inverse=True)[1]
    trie = DoubleArray(keys, cuts)
    states = trie.walk(keys, cuts)
    by_path = {}
    for i in range(len(lengths)):
        for d in range(lengths[i]):
            by_path.setdefault(tuple(keys[cuts[i] : cuts[i] + d + 1]), set()).add(int(states[cuts[i] + d]))
    assert all(len(s) == 1 and min(s) > 0 for s in by_path.values())
    assert len({min(s) for s in by_path.values()}) == len(by_path) == (trie.check >= 0).sum() - 1
    assert len(trie.check) <= 4 * (len(by_path) + trie.n_keys) + 4096
    for _ in range(200):
        probe = rng.integers(-1, trie.n_keys + 1, 3)
        want = [min(by_path.get(tuple(probe[: d + 1]), {-1})) for d in range(3)]
        assert trie.walk(probe, np.array([0, 3])).tolist() == want
