"""Invariants over generated inputs; each example is a whole DataFrame."""

from __future__ import annotations

from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from postlake.functions import text as X, url as U
from postlake.operators import score as K, states as T

few = settings(max_examples=2, deadline=None, database=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
word = st.text(alphabet="abcXYZ019-_.~% é", max_size=8)
urls = st.builds(lambda s, h, p, q, f: f"{s}://{h}/{'/'.join(p)}?{'&'.join(f'{a}={b}' for a, b in q)}#{f}", st.sampled_from(["http", "HTTPS", "ftp"]), st.sampled_from(["www.Acme.io", "x.co.uk:80", "u@y.io:8443", "z.io."]), st.lists(word, max_size=3), st.lists(st.tuples(st.sampled_from(["a", "b", "utm_x", "ref", ""]), word), max_size=3), word)


@few
@given(rows=st.lists(urls, min_size=60, max_size=60))
def test_canonical_urls_are_fixed_points(spark, rows):
    df = spark.createDataFrame([(x,) for x in rows], "x string").select("x", U.canonicalize_url(F.col("x")).alias("once"))
    df = df.withColumn("twice", U.canonicalize_url(F.col("once"))).where("once IS NOT NULL")
    assert df.where("once <> twice OR twice IS NULL").count() == 0
    assert df.where("once LIKE '%utm_%=%' OR once LIKE '%#%' OR NOT once LIKE 'https://%'").count() == 0


@few
@given(rows=st.lists(st.lists(st.floats(-1e100, 1e100), min_size=3, max_size=3), min_size=40, max_size=40))
def test_a_vector_is_like_itself(spark, rows):
    df = spark.createDataFrame([(x,) for x in rows], "v array<double>")
    got = df.select(K.cosine(F.col("v"), F.col("v")).alias("c"), (F.array_max(F.transform("v", lambda x: F.abs(x))) == 0).alias("zero")).collect()
    assert all(abs(r.c - (0.0 if r.zero else 1.0)) < 1e-9 for r in got)


@few
@given(rows=st.lists(st.tuples(st.sampled_from(["new_jobs", "no_change", "rate_limited", "failed"]), st.integers(1, 10_000), st.integers(30, 600), st.integers(600, 7200), st.integers(1, 12)), min_size=80, max_size=80))
def test_intervals_stay_within_bounds(spark, rows):
    df = spark.createDataFrame(rows, "outcome string, current int, low int, high int, failures int")
    p = T.next_poll(*[F.col(c) for c in ("outcome", "current", "low", "high", "failures")], F.lit(None).cast("double"))
    got = df.select("low", "high", "failures", "outcome", p.alias("p")).collect()
    for r in got:
        assert r.low <= r.p.interval <= r.high and 0 < r.p.sleep <= 6 * 3600
        assert r.p.circuit_open == (r.outcome == "failed" and r.failures >= 5)


@few
@given(rows=st.lists(st.text(max_size=30), min_size=60, max_size=60))
def test_titles_are_fixed_points_of_folding(spark, rows):
    df = spark.createDataFrame([(x,) for x in rows], "x string").withColumn("t", X.normalize_title(F.col("x")))
    assert df.where(X.fold(F.col("t")) != F.col("t")).count() == 0
    assert df.where(F.col("t").rlike(r"^\s|\s$|\s\s")).count() == 0
