"""The stored index against a scan of the texts, as batches come, come again, are lost half-way and are compacted."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from postlake.functions.text import trigram_similarity, trigrams
from postlake.operators import search as Q
from postlake.operators.inverted import Index

QUERIES = ["apple pears", '"green apple"', "green or running", "-apple", '-"green apple" pear', "run or -apple", '"the green"', "the", "", '"pear pear pear"', "apple -apple", "absent", "absent or apple"]
WORDS = "apple apples green running the pear pears of runs".split()
SCHEMA = "doc long, title string, text string"


def scan(df, query):
    text = F.concat_ws(" ", "title", "text")
    return {r.doc for r in df.where("title IS NOT NULL OR text IS NOT NULL").where(Q.matches(Q.tokens(text), query)).collect()}


@pytest.fixture
def texts():
    rng = random.Random(3)
    return lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))


def same(index, df):
    for q in QUERIES:
        assert {r.doc for r in index.matching(q).collect()} == scan(df, q), q


def test_batches(spark, tmp_path, texts):
    index = Index(spark, str(tmp_path / "index"), buckets=4, files=2)
    assert index.matching("apple").collect() == [] and index.documents().collect() == []
    rows = {i: (i, None if i % 4 else "Green Apple", texts()) for i in range(40)} | {50: (50, None, None), 51: (51, "", "")}
    make = lambda xs: spark.createDataFrame(list(xs), SCHEMA)
    index.apply(make([*rows.values(), (None, "no id", "apple")]), 0)
    same(index, make(rows.values()))
    for generation in (1, 2):
        changed = {i: (i, None, texts()) for i in range(generation, 40, 7)} | {i: (i, None, None) for i in (3, 5)}
        index.apply(make(changed.values()), generation)
        index.apply(make(changed.values()), generation)  # the batch comes again
        rows |= changed
        same(index, make(rows.values()))
    # a batch that was lost before its commit isn't seen
    make([(1, "lost", "apple")]).write.parquet(str(tmp_path / "index/changes/generation=9"))
    same(index, make(rows.values()))
    index.compact(10)
    assert index.generations() == [10]
    same(index, make(rows.values()))
    index.apply(make([(7, None, "green apple running")]), 11)
    rows[7] = (7, None, "green apple running")
    same(index, make(rows.values()))


def test_similar_titles(spark, tmp_path):
    titles = ["AI Engineer", "Senior AI Engineer", "Engineer", "Gardener", "", None, "ai engineers"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(titles)], SCHEMA)
    index = Index(spark, str(tmp_path / "index"))
    index.apply(df, 0)
    want = {r.doc for r in df.where(trigram_similarity(trigrams(F.col("title")), trigrams(F.lit("ai engineer"))) >= 0.3).collect()}
    assert {r.doc for r in index.similar("ai engineer").collect()} == want >= {0, 1, 6}
    assert {r.doc for r in index.matching_or_similar("gardener x").collect()} == {3}


def test_a_query_reads_only_its_buckets(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"), buckets=16)
    index.apply(spark.createDataFrame([(i, None, f"word{i} common") for i in range(100)], SCHEMA), 0)
    df = index.postings("text", ["word7"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(term" in plan.replace("EqualTo(term", "In(term")
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert "bucket" in filters and "field" in filters and len(df.collect()) == 1


def test_rows_that_repeat_a_document_count_together(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    index.apply(spark.createDataFrame([(1, None, "apple"), (1, None, "pear"), (1, None, "apple")], SCHEMA).withColumn("bucket", F.lit(1)), 0)
    assert [r.doc for r in index.matching("apple pear").collect()] == [1]


def test_a_stream_keeps_it(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "apple"), (2, None, "pear")], SCHEMA)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    index = Index(spark, str(tmp_path / "index"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for more in (None, [(1, None, None), (3, None, "apple tree")]):
        if more:
            spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(index.sink()).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {r.doc for r in index.matching("apple").collect()} == {3} and {r.doc for r in index.documents().collect()} == {2, 3}
