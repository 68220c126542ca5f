from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postlake.operators import states as T
from postlake.streaming import folds


def batch(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_sliding_limit_logs_admitted_hits_only(spark):
    hits = batch(spark, [("a", float(t)) for t in (0, 1, 2, 3, 10, 11, 12)] + [("b", 2.0)], "k string, at double")
    got = folds.sliding_limit(2, 10.0).batch(hits, ["k"], ["at"]).where("k = 'a'").orderBy("at").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True, False]


def test_circuit_lets_one_try_through(spark):
    calls = batch(spark, [("a", float(t), ok) for t, ok in ((0, False), (1, False), (2, True), (6, False), (7, True), (11, True), (12, False))], "k string, at double, ok boolean")
    got = folds.circuit_breaker(2, 5.0).batch(calls, ["k"], ["at"]).orderBy("at").collect()
    assert [(r.tried, r.open) for r in got] == [(True, False), (True, True), (False, True), (True, True), (False, True), (True, False), (True, False)]


def test_poll_loop_agrees_with_single_steps(spark):
    kinds = ["no_change", "no_change", "failed", "failed", "failed", "failed", "failed", "rate_limited", "new_jobs"]
    polls = batch(spark, [("a", i, k, None) for i, k in enumerate(kinds)], "k string, n int, outcome string, retry_after double")
    got = folds.poll_loop().batch(polls, ["k"], ["n"]).orderBy("n").collect()
    interval, failures = 60, 0
    for row in got:
        failures = failures + 1 if row.outcome in ("failed", "rate_limited") else 0
        want = spark.range(1).select(T.next_poll(F.lit(row.outcome), F.lit(interval), F.lit(60), F.lit(3600), F.lit(failures), F.lit(None).cast("double"))).first()[0]
        assert (row.interval, row.sleep, row.circuit_open) == tuple(want)
        interval, failures = want.interval, 0 if want.circuit_open else failures


def test_idempotency_remembers_anew_after_a_day(spark):
    hours = [(0, "x", 200), (1, "x", 200), (2, "y", 200), (25, "x", 200), (26, "x", 200), (27, "y", 200)]
    rows = [("k", h * 3600.0, f, s, 60.0) for h, f, s in hours] + [("busy", float(a), "x", s, 10.0) for a, s in ((0, 503), (5, 200), (20, 429), (40, 200), (45, 200), (60, 200))]
    df = batch(spark, rows, "k string, at double, fingerprint string, status int, seconds double")
    got = folds.idempotency(24).batch(df, ["k"], ["at"]).orderBy("k", "at").collect()
    assert [r.verdict for r in got if r.k == "k"] == ["executed", "replayed", "mismatch", "executed", "replayed", "mismatch"]
    assert [r.verdict for r in got if r.k == "busy"] == ["executed", "in_progress", "executed", "executed", "in_progress", "replayed"]


@pytest.mark.parametrize("files", [1, 3])
def test_streams_keep_state_between_batches(spark, tmp_path, files):
    rows = [("a" if i % 2 else "b", float(i)) for i in range(24)]
    per = len(rows) // files
    for n in range(files):
        batch(spark, rows[n * per : (n + 1) * per], "k string, at double").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    fold = folds.sliding_limit(3, 8.0)
    stream = spark.readStream.schema("k string, at double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = fold.stream(stream, ["k"], ["at"]).writeStream.format("memory").queryName(f"limited{files}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.k, r.at): r.allowed for r in spark.table(f"limited{files}").collect()}
    want = {(r.k, r.at): r.allowed for r in fold.batch(batch(spark, rows, "k string, at double"), ["k"], ["at"]).collect()}
    if files == 1:
        assert got == want
    assert len(got) == len(want)


def test_routing_a_stream(spark, tmp_path):
    batch(spark, [("s1", 1), ("s1", None), ("s2", None), (None, 2)], "source_id string, workspace_id int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id string, workspace_id int").parquet(str(tmp_path / "in"))
    followed = batch(spark, [("s1",)], "source_id string")
    query = T.routed(stream, followed, 1).writeStream.format("memory").queryName("routed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.source_id, r.workspace_id) for r in spark.table("routed").collect() if r.workspace_id) == [("s1", 1)]
    assert spark.table("routed").count() == 2


def finished(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_windows_of_streams(spark, tmp_path):
    import datetime as d

    from postlake.streaming import events as E

    at = lambda day, hour, second=0: d.datetime(2024, 1, day, hour, 0, second)
    rows = [("a", "k1", at(1, 1)), ("a", "k1", at(1, 2)), ("b", "k2", at(1, 3)), ("a", "k3", at(2, 1)), ("a", "k4", at(2, 1, 10)), ("z", "k5", at(9, 0))]
    batch(spark, rows, "user string, key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: E.read_events(spark, str(tmp_path / "in"), "user string, key string, ts timestamp")
    finished(E.daily_usage(stream(), "user"), "usage", tmp_path)
    assert {(r.user, r.day.day, r.n) for r in spark.table("usage").collect()} == {("a", 1, 2), ("b", 1, 1), ("a", 2, 2)}
    finished(E.delivered_once(stream(), "key"), "once", tmp_path)
    assert sorted(r.key for r in spark.table("once").collect()) == ["k1", "k2", "k3", "k4", "k5"]
    finished(E.in_flight(stream(), "user"), "flights", tmp_path)
    assert ("a", 2) in {(r.user, r.n) for r in spark.table("flights").collect()}


def test_listings_stream_into_a_catalogue(spark, tmp_path):
    import datetime as d

    from postlake.streaming import events as E
    from test_operators import empty_catalogue, listing

    schema = listing(spark, [(1, "a", "x")]).schema
    for n, rows in enumerate([[(1, "a", "x"), (2, "b", "y")], [(1, "a", "X"), (2, "b", "y")]]):
        listing(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sink = E.catalogue_sink(spark, str(tmp_path / "catalogue"), empty_catalogue(spark), lambda: F.lit(d.datetime(2024, 1, 1)))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "catalogue" / "1"))
    assert {(r.external_id, r.content_hash, r.version) for r in last.collect()} == {("a", "X", 2), ("b", "y", 1)}
