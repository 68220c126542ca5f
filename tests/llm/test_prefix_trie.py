"""The trie against a plain one, over conversations that are cut into blocks, long, empty, repeated or missing."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postlake.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Nodes by a dictionary of whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below[node] = (sum(below[x][0] for x in children[node]) or 1, own_saved + sum(below[x][1] for x in children[node]))
        digest = hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children[node]), *below[node], digest))
    return sorted(out, key=str)


def made(spark, rows, partitions=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    return sorted(map(tuple, P.prefix_trie(*P.with_shared_beginnings(*P.number_turns(df))).collect()), key=str)


@pytest.mark.parametrize(("block", "seed", "most"), [(64, 1, 8), (3, 2, 20), (2, 3, 12)])
def test_random_conversations(spark, monkeypatch, block, seed, most):
    monkeypatch.setattr(P, "BLOCK", block)
    rng, rows = random.Random(seed), []
    for c in range(0, 120, rng.choice([1, 2, 3])):
        shape = rng.choice(["aaab", "ab", "abc"])
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(shape)) for t in range(rng.randint(1, most))]
    assert made(spark, rows) == plain(rows)


def test_long_conversations_need_rounds_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    rows = [(c, t, "user", "same" if t < 70 - c else f"own {c} {t // 9}") for c in range(7) for t in range(60 + 3 * c)]
    assert made(spark, rows, 9) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None), (7, 2, "user", "é😀"), (8, 1, "ab", "c"), (9, 1, "a", "bc"), (10, 1, "user", ""), (13, 1, "user", "y" * 30_000), (14, 3, "b", "q"), (14, 3, "a", "q"), (14, 3, "a", "q")]
    assert made(spark, rows) == plain(rows)
    assert made(spark, rows[:1]) == []
    assert P.op12_prefix_trie  # the empty table has no conversation, and so no root
    assert made(spark, [(c, 1, "user", "gone") for c in (1, 2, 3, 6)]) == plain([(c, 1, "user", "gone") for c in (1, 2, 3, 6)])


def test_hot_beginnings_and_equal_conversations(spark):
    rows = [(c, t, "user", "first" if t == 0 else "second" if c % 3 else f"own {c % 40}") for c in range(600) for t in range(3)]
    got = made(spark, rows)
    assert got == plain(rows)
    assert max(r[3] for r in got) == 600


def test_clashing_columns(spark):
    rows = [(1, 0, "user", "a"), (6, 0, "user", "b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit("mine") for x in ("depth", "part", "path", "n", "a", "copy")})
    got = P.prefix_trie(*P.with_shared_beginnings(*P.number_turns(df))).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
