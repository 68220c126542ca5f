from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import sharding as S


@pytest.mark.parametrize(("n", "shards"), [(1003, 8), (5, 8), (0, 8), (640, 3)])
def test_sizes_and_slots(spark, monkeypatch, n, shards):
    monkeypatch.setattr(S, "PART_ROWS", 7)  # so that blocks and shards are ranked in parts
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    rows = S.shard_rows(df, ["doc_id"], shards).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(shards)) and (n < shards or max(sizes.values()) - min(sizes.values()) <= 1)
    for s, size in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(size))


def test_reruns_agree_and_seeds_differ(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    one = {tuple(r) for r in S.shard_rows(df, ["doc_id"]).collect()}
    assert one == {tuple(r) for r in S.shard_rows(df.repartition(9), ["doc_id"]).collect()}
    assert one != {tuple(r) for r in S.shard_rows(df, ["doc_id"], seed=43).collect()}


def test_the_matrix_has_the_margins_and_the_law(spark):
    sizes = [40, 0, 25, 200, 1]
    blocks = spark.createDataFrame(list(enumerate(sizes)), "block int, n long")
    counts = []
    for seed in range(60):
        rows = sorted(S.communication_matrix(blocks, 4, seed).collect())
        m = np.diff(np.c_[np.zeros(len(rows)), [r.ends for r in rows]], axis=1)
        assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == [67, 67, 66, 66]
        counts.append(m[0])
    # the first block's counts are hypergeometric: mean 40 * 67 / 266, variance as drawn without replacement
    share = 67 / 266
    assert np.mean(counts, axis=0)[0] == pytest.approx(40 * share, abs=1.2)
    assert np.var([c[0] for c in counts]) == pytest.approx(40 * share * (1 - share) * (266 - 40) / 265, rel=0.6)


def test_the_logarithm_of_factorials(spark):
    import math

    for x in (0, 1, 5, 15, 16, 17, 100, 12345):
        assert spark.sql(f"SELECT {S._ln_factorial(f'{x}L')}").first()[0] == pytest.approx(math.lgamma(x + 1), rel=1e-9, abs=1e-9)


def test_rows_that_lie_together_are_spread(spark):
    rows = S.shard_rows(spark.range(4000).withColumnRenamed("id", "doc_id"), ["doc_id"]).collect()
    first = Counter(r.shard for r in rows if r.doc_id < 800)
    assert max(first.values()) < 150 and min(first.values()) > 60
    assert abs(np.corrcoef([r.doc_id for r in rows], [r.slot for r in rows])[0, 1]) < 0.06


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None)] * 30 + [(1, "a")] * 30 + [(2, "é")], "doc_id long, text string").withColumn("shard", F.lit("mine")).withColumn("ends", F.lit(1))
    got = S.shard_rows(df.drop("ends"), ["doc_id", "text"], 2).collect()
    assert len(got) == 61 and sorted(r.slot for r in got if r.shard == 0) == list(range(31))


def test_query(spark, tmp_path):
    texts = ["", None, "é😀", "x" * 50_000, "same", "same"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in S.op10_shards(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (got[i]["size"], got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_query_deals_all_documents_evenly(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = S.op10_shards(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert {tuple(r) for r in rows} == {tuple(r) for r in S.op10_shards(spark, sf_dir).collect()}
