"""Digests against a plain count, edited texts against plain slicing, and likeness over real documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import quartile_digest as Q

SCHEMA = "doc_id long, text string"


def plain(text: str) -> str:
    data, counts = text.encode(), [0] * Q.BUCKETS
    for number, (i, j, k) in enumerate(Q.TRIPLETS):
        for p in range(len(data) - k):
            counts[(data[p + i] + 256 * data[p + j] + 65536 * data[p + k] + (number << 24)) * Q.FACTOR % 2**32 >> Q.SHIFT] += 1
    order = sorted(counts)
    q = [order[Q.BUCKETS * x // 4 - 1] for x in (1, 2, 3)]
    codes = [sum(c > x for x in q) for c in counts]
    size = 1 + int(np.floor(Q.STEPS * np.log2(len(data)))) if data else 0
    body = [sum(codes[n + s] << 2 * s for s in range(4)) for n in range(0, Q.BUCKETS, 4)]
    return bytes([size, 15 * q[0] // max(1, q[2]) * 16 + 15 * q[1] // max(1, q[2]), *body]).hex()


def expected(rows):
    rows = sorted(((i is not None, i or 0, t or "", i) for i, t in rows))
    out = []
    for n, (_, _, t, i) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][2]
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), plain(t), plain(new)))
    return sorted(out, key=str)


TEXTS = ["", "a", "abcdefghij", "abcdefghijk" * 40, "é😀 ö" * 30, "x" * 5000, "The quick brown fox jumps over the lazy dog. " * 7]


def test_digests_equal_a_plain_count(monkeypatch):
    want = [plain(t) for t in TEXTS]
    assert Q._hex(Q.digests([t.encode() for t in TEXTS])) == want
    monkeypatch.setattr(Q, "TOGETHER_BYTES", 50)  # so that long texts are counted by pieces
    assert Q._hex(Q.digests([t.encode() for t in TEXTS])) == want


@pytest.mark.parametrize("part_bytes", [1 << 20, 40, 1])
def test_next_documents(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(Q, "PART_BYTES", part_bytes)
    rows = [(i * 3, TEXTS[i % 7] + str(i) * (i % 5)) for i in range(40)] + [(None, "no id"), (500, None)]
    got = Q.compare_with_next(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


@pytest.mark.parametrize("part_bytes", [1 << 20, 5])
def test_equal_rows_that_fill_parts(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(Q, "PART_BYTES", part_bytes)
    rows = [(1, "before")] + [(5, "the same text again")] * 30 + [(9, "behind it")]
    got = Q.compare_with_next(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows)
    assert sum(r.doc_id == 5 and r.near_next == 1 for r in got) == 29
    only = Q.compare_with_next(spark.createDataFrame(rows[1:31], SCHEMA).repartition(4)).collect()
    assert len(only) == 30 and {r.near_next for r in only} == {1.0}


def test_empty_table_and_clashing_columns(spark):
    assert Q.compare_with_next(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "one"), (2, "two")], SCHEMA).withColumns({x: F.lit("mine") for x in ("part", "edge", "key", "a", "known", "place", "_range")})
    assert [r.n_chars for r in Q.compare_with_next(df).collect()] == [3, 3]


def test_columns(spark):
    df = spark.createDataFrame([("abc" * 50, "abc" * 50), ("abc" * 50, None), (None, "")], "a string, b string").select(Q.fingerprint(F.col("a")).alias("x"), Q.fingerprint(F.col("b")).alias("y"))
    rows = df.select("x", Q.likeness(F.col("x"), F.col("y")).alias("near"), Q.likeness(F.col("x"), F.lit(None).cast("string")).alias("none")).collect()
    assert [r.x for r in rows] == [plain("abc" * 50)] * 2 + [plain("")]
    assert [rows[0].near, rows[2].near] == [1.0, 1.0] and rows[1].near < 1 and rows[0].none is None
    assert set(plain("")) == {"0"}


def test_edited_texts_are_nearer_than_others(spark, sf_dir):
    rows = Q.op11_fingerprints(spark, sf_dir).collect()
    edited, following = (np.array([r[x] for r in rows]) for x in ("near_edited", "near_next"))
    assert (edited > following).mean() > 0.97 and (edited[:, None] > following[None]).mean() > 0.93
