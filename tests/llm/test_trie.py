"""Prefix tries of conversations against plain dictionaries."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.llm import conversation_trie
from tests.llm.helpers import words

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes by the contract, from (conv_id, turn, role, text) with different turns."""
    own = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    if not whole:
        return set()
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        ends = sorted(c for c in members if len(whole[c]) == len(path))
        out.add(
            (
                min(members),
                len(path),
                min(nodes[path[:-1]]) if path else None,
                len(members),
                sum(len(p) == len(path) + 1 for p in below),
                sum(map(leaf, below)),
                sum((len(nodes[p]) - 1) * len(words_of(p[-1][1])) for p in below if p),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return out


def words_of(text):
    return words(text)


def nodes(spark, rows, **how):
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, TURNS), **how).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def conversations(rng, n, texts):
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 8))):
            rows.append((c + int(c > n // 2) * 7, t, ["user", "assistant"][t % 2], " ".join(["w"] * int(rng.integers(0, 3)) + [str(rng.integers(0, texts))])))
    return rows


@pytest.mark.parametrize("limit", [1, 4, 1024])
def test_nodes_match_dictionaries(spark, limit):
    """With every prefix shared, some, and none."""
    rows = conversations(np.random.default_rng(limit), 150, 2)
    assert nodes(spark, rows, subtree_turns=limit, shard_turns=40) == brute(rows)


def test_copies_of_a_conversation_and_a_common_first_turn(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "ID_SPAN", 16)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 120) for t in range(6)]
    rows += [(c, t, "user", f"t{t}" if t < 4 else f"x{c}") for c in range(200, 260) for t in range(7)]
    assert nodes(spark, rows, subtree_turns=20, shard_turns=30) == brute(rows)


def test_nulls_and_lost_turns(spark):
    rows = [(None, 1, "user", "lost"), (0, None, None, "first"), (0, 1, "user", None), (0, 5, "user", "x y"), (41, 0, "user", "a b"), (41, 1, "u", "c")]
    rows += [(c, 0, "user", "gone") for c in range(60, 80)]  # some take more turns than they have
    assert nodes(spark, rows) == brute(rows)
    assert nodes(spark, []) == set()
    assert nodes(spark, [(None, 1, "user", "lost")]) == set()


def test_repeated_turns_and_other_columns(spark):
    rows = [(3, 1, "user", "b"), (3, 1, "user", "b"), (3, 1, "assistant", "z"), (3, 2, None, "very " * 50000)]
    df = spark.createDataFrame(rows, TURNS)
    for c in ("pos", "prefix", "shared", "n", "k1", "depth", "shard", "lent"):
        df = df.withColumn(c, F.lit("x"))
    got = {r["depth"]: r for r in conversation_trie.conversation_trie(df).collect()}
    h = zlib.crc32(b"3") % 4
    assert len(got) == 1 + max(0, 4 - h)
    assert got[0]["n_leaves"] == 1 and got[0]["n_convs"] == 1


def test_double_arrays_hold_their_paths(spark):
    rng = np.random.default_rng(5)
    paths = sorted({tuple(int(x) for x in rng.integers(1, 30, rng.integers(1, 7))) for _ in range(300)})
    trie = conversation_trie.DoubleArray([list(p) for p in paths])
    prefixes = {p[:d] for p in paths for d in range(1, len(p) + 1)}
    states = {p: trie.walk(list(p)) for p in prefixes}
    assert all(len(s) == len(p) for p, s in states.items())
    assert len({s[-1] for s in states.values()}) == len(prefixes)
    for p in itertools.product(range(1, 12), repeat=2):
        assert len(trie.walk(list(p))) == max((d for d in (1, 2) if p[:d] in prefixes), default=0)
