from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string"


def slow_targets(sizes: dict[str | None, int], weights=(5, 2, 1), cap=3) -> dict[str | None, float]:
    """Shares by weight, again and again for the excess above the cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > cap * sizes[s]]
        if not over:
            return {s: fixed[s] if s in fixed else left * weight[s] / sum(weight[f] for f in free) for s in names}
        fixed |= {s: cap * sizes[s] for s in over}


def corpus(seed: int, sources: list[str | None], n: int = 400):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.choice([1, 2]) for _ in range(rng.choice([1, 3, 3, 20, 50, 400]))), "en", rng.choice(sources)) for i in range(n)]
    return rows + [(n, None, "en", sources[0]), (n + 1, "", "en", sources[0]), (n + 2, "  \t", None, sources[-1])]


@pytest.mark.parametrize("sources", [["b", "a", "Z", "é", None], ["only"], ["x", "y"]])
def test_against_the_definition(spark, sources):
    rows = corpus(len(sources), sources)
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.mix(df).collect()
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sizes: dict = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    want = slow_targets(sizes)
    taken: dict = {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s])
    again = {(r.doc_id, r.taken) for r in M.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_rates_solve_the_dual(spark):
    cells = [("=a", 1, 50), ("=a", 10, 20), ("=a", 500, 2), ("=b", 3, 10), ("=c", 7, 5), ("=d", 4, 4)]
    wanted = [("=a", 1250.0, 300.0), ("=b", 30.0, 60.0), ("=c", 35.0, 105.0), ("=d", 16.0, 0.0)]
    c = spark.createDataFrame(cells, "skey string, size long, n long")
    got = M.rates(c, spark.createDataFrame(wanted, "skey string, source_size double, target double")).collect()
    words: dict[str, float] = {}
    for r in got:
        words[r.skey] = words.get(r.skey, 0) + r.n * r["size"] * r.rate
    assert words == {k: pytest.approx(t, abs=1e-4) for k, _, t in wanted}
    # below the cap, the logarithm of a rate is in proportion to the size
    tilt = {r["size"]: math.log(r.rate) for r in got if r.skey == "=a"}
    assert tilt[10] / tilt[1] == pytest.approx(10, rel=1e-6) and tilt[500] / tilt[1] == pytest.approx(500, rel=1e-6)
    assert max(r.rate for r in got) <= 3


def test_rates_stop_at_the_cap(spark):
    cells = [("=a", 1, 100), ("=a", 10, 50), ("=a", 100, 10)]
    got = M.rates(spark.createDataFrame(cells, "skey string, size long, n long"), spark.createDataFrame([("=a", 1600.0, 4000.0)], "skey string, source_size double, target double")).collect()
    rate = {r["size"]: r.rate for r in got}
    assert sum(r.n * r["size"] * r.rate for r in got) == pytest.approx(4000, abs=1e-4)
    assert rate[100] == 3 and 1 < rate[1] < rate[10] <= 3
    assert rate[10] == pytest.approx(min(3, rate[1] ** 10))


def test_documents_of_one_size_differ_by_one_copy(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 50)  # so that the hot cell is ranked in parts
    df = spark.createDataFrame([(i, "a b c", "en", "s" if i < 900 else "t") for i in range(1000)], SCHEMA)
    copies = [r.copies for r in M.mix(df).where("doc_id < 900").collect()]
    assert set(copies) <= {math.floor(np.mean(copies)), math.ceil(np.mean(copies))}


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s")] * 5 + [(None, "a b", "en", None)] * 3, SCHEMA).withColumn("size", F.lit("mine")).withColumn("copies", F.lit(9))
    got = M.mix(df).collect()
    assert len(got) == 8 and {r["size"] for r in got} == {2}
    assert M.mix(df.limit(0)).count() == 0
    copies = M.take_copies(df)
    assert copies.columns == df.columns
    assert copies.count() == sum(r.copies for r in got)
    assert M.take_copies(df.limit(0)).count() == 0


def test_rows_that_differ_elsewhere_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 7)
    rows = [(1, "a b c", "en", "s", i // 2) for i in range(80)] + [(2, f"d e f {i}", "en", "t", i) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA + ", crawl int")
    got = [(r.doc_id, r.text, r.crawl) for r in M.take_copies(df).collect()]
    want: dict = {}
    for r in M.mix(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert {d: sum(x[0] == d for x in got) for d in (1, 2)} == want
    each = [sum(x[2] == c for x in got if x[0] == 1) for c in range(40)]
    assert max(each) - min(each) <= 2  # two rows each, whose copies differ by one at most
    assert sorted(got) == sorted((r.doc_id, r.text, r.crawl) for r in M.take_copies(df.repartition(5)).collect())


def test_hot_sizes_and_single_rows_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 10)
    df = spark.createDataFrame([(i % 50, "a b c" if i < 300 else f"a b c {i}", "en", "s" if i % 3 else "t") for i in range(600)], SCHEMA)
    got = M.mix(df).collect()
    for cell in {(r.source_size, r["size"]) for r in got}:
        copies = {r.copies for r in got if (r.source_size, r["size"]) == cell}
        assert max(copies) - min(copies) <= 1
    assert len(got) == 600
