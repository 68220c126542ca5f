"""Loops of polling by hand, on a batch, and in a running stream with timers; bounded queues; numbers over restarts; results that land."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from postlake.operators import results as L
from postlake.streaming import delivery, polling as P


def play(rows, low=60, high=3600):
    loop, out = P.Loop(), []
    for at, kind in rows:
        loop, fired = P.settle(loop, at)
        loop, due = P.receive(loop, at, kind, None, low, high)
        out.append((fired + due, loop.mode))
    return out


def test_timers_and_early_wake():
    assert play([(0, "start"), (5, "new_jobs"), (70, "no_change"), (80, "poll_now"), (90, "poll_now"), (95, "no_change"), (99, "start")]) == [
        ([0], "polling"), ([], "sleeping"), ([65], "sleeping"), ([80], "polling"), ([], "polling"), ([95], "polling"), ([], "polling"),
    ]


def test_stop():
    assert play([(0, "start"), (1, "stop"), (2, "new_jobs"), (3, "poll_now"), (4, "start"), (5, "new_jobs"), (6, "stop"), (500, "no_change")]) == [
        ([0], "polling"), ([], "ending"), ([], "stopped"), ([], "stopped"), ([4], "polling"), ([], "sleeping"), ([], "stopped"), ([], "stopped"),
    ]


def test_an_open_circuit_isnt_woken():
    rows, at = [(0, "start")], 1
    for _ in range(5):
        rows += [(at, "failed"), (at + 1, "poll_now")]
        at += 2
    got = play(rows + [(at + 1000, "poll_now"), (at + 6 * 3600, "failed")])
    assert got[-4][1] == "circuit" and got[-3] == ([], "circuit") and got[-2] == ([], "circuit")
    assert got[-1] == ([9 + 6 * 3600], "sleeping")  # the timer ends the circuit, failures count anew


def test_unknown_outcomes():
    with pytest.raises(ValueError):
        play([(0, "start"), (1, "odd")])


def test_a_running_stream(spark, tmp_path):
    spark.conf.set(*P.STORE)
    schema = "source string, seq long, kind string, retry_after double"
    seq = iter(range(100))

    def say(*rows):
        spark.createDataFrame([(s, next(seq), k, None) for s, k in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    say(("a", "start"), ("b", "start"), ("c", "start"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rows = lambda: spark.table("due_polls").collect()

    def wait(found, seconds=60):
        end = time.time() + seconds
        while time.time() < end:
            if found(rows()):
                return
            time.sleep(0.3)
        raise AssertionError(rows())

    query = P.due_polls(stream, 2, 3600).writeStream.format("memory").queryName("due_polls").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        wait(lambda rs: len(rs) == 3)
        say(("a", "new_jobs"), ("b", "new_jobs"), ("b", "stop"), ("c", "no_change"))  # a sleeps 2 s, c 60 s, b ends
        wait(lambda rs: ("a", "timer") in {(r.source, r.why) for r in rs})
        say(("c", "poll_now"), ("b", "poll_now"))
        wait(lambda rs: ("c", "poll_now") in {(r.source, r.why) for r in rs})
        time.sleep(3)
        assert sorted((r.source, r.why) for r in rows()) == [("a", "start"), ("a", "timer"), ("b", "start"), ("c", "poll_now"), ("c", "start")]
    finally:
        query.stop()


def test_queues(spark):
    schema = "i string, n_row int, kind string, client string, workspace_id int, sources array<string>, n int"
    rows = [
        ("connect", 1, 7, [], None), ("connect", 2, 8, ["s"], None), ("connect", 3, 7, None, None), ("event", None, 7, None, None), ("event", None, None, ["s", "t"], None), ("event", None, 7, None, None),
        ("event", None, 7, None, None), ("event", None, 7, None, None), ("connect", 3, 7, None, None), ("take", 2, None, None, 5), ("take", 9, None, None, 5), ("disconnect", 2, None, None, None), ("event", None, None, ["s"], None),
    ]
    df = spark.createDataFrame([("x", j, k, None if c is None else str(c), *r) for j, (k, c, *r) in enumerate(rows)], schema)
    got = delivery.hub(2, 3).batch(df, ["i"], ["n_row"]).orderBy("n_row").collect()
    assert [r.admitted for r in got if r.kind == "connect"] == [True, True, False, True]  # a place is free again when a client was dropped
    assert [(r.delivered, list(r.dropped)) for r in got if r.kind == "event"] == [(1, []), (1, []), (1, []), (1, []), (0, ["1"]), (0, [])]
    assert [r.delivered for r in got if r.kind == "take"] == [1, 0] and [r.connected for r in got][-2:] == [1, 1]


def test_numbers_over_restarts_and_a_new_audience(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delivery, "FULL_EVERY", 2)
    schema, followed = "event_id int, key string, source_id string, workspace_id int", ["s"]
    audience = lambda: spark.createDataFrame([(x,) for x in followed], "source_id string")
    sink = delivery.NumberedSink(spark, str(tmp_path / "out"), "key", ["event_id"], audience, 1)
    for n in range(6):
        if n == 3:
            followed.append("t")
        spark.createDataFrame([(4 * n + i, "ab"[i % 2], "st"[i // 2], None) for i in range(4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in")).where("event_id BETWEEN 16 AND 19")
    sink(batch, 4)  # the batch comes again
    numbers = {r.event_id: r.number for r in sink.read().collect()}
    for rest in (0, 1):
        mine = sorted(i for i in numbers if i % 2 == rest)
        assert [numbers[i] for i in mine] == list(range(1, 10))
    assert {i for i in numbers} == {i for i in range(24) if i % 4 < 2 or i >= 12}


def test_results_land_on_their_text_only(spark):
    catalogue = spark.createDataFrame([(1, "new"), (2, "same"), (3, "new")], "job_id int, content_hash string")
    work = [(1, 10, "old", False, "x"), (2, 11, "same", False, "x"), (3, 12, "old", True, "x"), (4, 13, "gone", False, "x"), (2, 9, "same", None, "y"), (1, 14, None, False, "z")]
    work = spark.createDataFrame(work, "job_id int, work_id int, content_hash string, force boolean, status string")
    none = spark.createDataFrame([], "job_id int, work_id int, status string, version int")
    assert {(r.work_id, r.verdict) for r in L.verdicts(work, catalogue, none).collect()} == {(10, "superseded"), (11, "landed"), (12, "landed"), (13, "missing"), (9, "superseded"), (14, "landed")}
    once = L.land(work, catalogue, none)
    assert {tuple(r) for r in L.latest(once).collect()} == {(1, 14, "z", 1), (2, 11, "x", 1), (3, 12, "x", 1)}
    again = L.land(work.where("work_id IN (11, 12, 14)"), catalogue, once)
    assert again.count() == 3
    later = L.land(work.where("work_id = 11").withColumn("work_id", F.lit(20)), catalogue, once)
    assert {(r.work_id, r.version) for r in L.latest(later).where("job_id = 2").collect()} == {(20, 2)}


def test_stages_go_on_where_they_stopped(spark):
    catalogue = spark.createDataFrame([(1, "h"), (2, "h"), (3, "new"), (4, "h")], "job_id int, content_hash string")
    done = [(1, "h", "eligibility"), (1, "h", "enrich"), (3, "old", "eligibility")] + [(4, "h", s) for s in L.STAGES] + [(2, "h", "enrich")]
    got = L.next_stage(spark.createDataFrame(done, "job_id int, content_hash string, stage string"), catalogue)
    assert {(r.job_id, r.stage) for r in got.collect()} == {(1, "embed"), (2, "eligibility"), (3, "eligibility")}
