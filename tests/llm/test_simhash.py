from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from postlake.llm import simhash as S
from postlake.llm.components import connected_components


def slow_fingerprint(text: str | None, words: int = 4) -> int:
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows: list[tuple[int, int]], radius: int) -> dict[int, int]:
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, fa in rows:
        for b, fb in rows:
            if a < b and (fa ^ fb).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def corpus(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([2, 6, 80, 300]))) for _ in range(40)]
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "ONE"), (5, "Ärger über ÄRGER a b"), (6, "ärger über ÄRGER a b")]
    for i in range(200):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((10 + i, " ".join(words)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "CHUNK", 32)  # so that buckets are dealt as pairs of chunks
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fp.hex(), r.component_id) for r in S.near_duplicates(df).collect()}
    prints = {i: slow_fingerprint(t) for i, t in rows}
    want = slow_components(list(prints.items()), 4)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_bit_slices_count_like_popcounts():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, (50, 2)).astype(np.uint64)
    b = np.concatenate([a[:20] ^ (np.uint64(1) << rng.integers(0, 63, (20, 2)).astype(np.uint64)), rng.integers(0, 2**63, (90, 2)).astype(np.uint64)])
    for radius in (0, 1, 2, 4, 19, 60):
        i, j = S.within(a, b, radius)
        want = np.nonzero(np.bitwise_count(a[:, None] ^ b[None]).sum(-1) <= radius)
        assert sorted(zip(i, j)) == sorted(zip(*want))


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "A B C D E"), (8, None), (None, None)], "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS component_id", "2 AS node")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in S.near_duplicates(df).collect()))
    assert [(d, c) for _, d, c in got] == [(7, 7), (7, 7), (8, 8), (9, 7), (0, None), (0, None)]
    assert S.near_duplicates(df.limit(0)).count() == 0
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "a b c d e"), (7, "a b c d e"), (8, "")]


def test_keep_one_leaves_other_documents_alone(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(200)) for _ in range(60)]
    near = [t.replace(t.split()[50], "changed", 1) for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(df).collect()) == list(range(60))


def test_keep_one_takes_links_at_an_exact_similarity(spark):
    """Pairs just above 0.8 all lose their copy, and pairs just below keep both."""
    rng = random.Random(8)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows, want = [], set()
    for i in range(240):
        words = [f"w{rng.randrange(10**6)}" for _ in range(304)]
        tail = 33 if i % 2 else 35  # of 300 shingles, so many differ: 267 of 333 are shared, or 265 of 335
        a, b = " ".join(words), " ".join(words[:-tail] + [f"v{rng.randrange(10**6)}" for _ in range(tail)])
        similarity = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert 0.785 < similarity < 0.815
        rows += [(2 * i, a), (2 * i + 1, b)]
        want |= {2 * i} if similarity >= 0.8 else {2 * i, 2 * i + 1}
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= kept and len(kept - want) <= 4  # candidates are found by chance: 99 % of those just above
    assert 100 < len(rows) - len(want) < 140


def test_keep_one_finds_copies_that_repeat_a_line(spark):
    rng = random.Random(10)
    rows = []
    for i in range(20):
        text, line = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (300, 12))
        rows += [(2 * i, text), (2 * i + 1, f"{text} {' '.join([line] * 10)}")]
    assert {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {2 * i for i in range(20)}


def test_large_candidate_groups_are_dealt_in_chunks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"v{rng.randrange(10**6)}" for w in base)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id for r in S.keep_one(df).collect()}
    monkeypatch.setattr(S, "SET_CHUNK", 16)
    assert {r.doc_id for r in S.keep_one(df).collect()} == whole and len(whole) < 60


def test_a_very_long_text_is_counted_in_parts(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = S.fingerprint(text, 4, 64)
    monkeypatch.setattr(S, "AT_A_TIME", 100)
    assert S.fingerprint(text, 4, 64) == whole == (slow_fingerprint(text).to_bytes(8, "big"), [])


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_more_blocks_find_the_same_components(spark, monkeypatch, blocks):
    monkeypatch.setattr(S, "key_blocks", lambda n, bits, radius: blocks)
    rows = corpus(4)
    want = slow_components([(i, slow_fingerprint(t)) for i, t in rows], 4)
    assert {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_blocks_grow_with_the_corpus():
    assert [S.key_blocks(n, 64, 4) for n in (10**3, 10**6, 10**9, 10**11)] == [5, 5, 6, 7]


def test_rows_that_repeat_a_doc_id_are_told_apart(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, c, "x"), (3, c, "y"), (3, b, "x"), (4, c, "z")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    # of 2's texts the copy of 1 goes and the other stays; 3 has one row of c, and its b is a copy of 2's
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (2, b), (3, c)])


def test_short_texts_find_their_copies(spark):
    rows = [(1, "a b c d e f g h i"), (2, "a b c d e f g h i j"), (3, "one two"), (4, "one two"), (5, "one two three"), (6, "b c d e f g h i x y z")]
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1, 3, 5, 6}  # 5 of 6 shingles are shared by 1 and 2


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert connected_components(links.limit(0)).count() == 0
