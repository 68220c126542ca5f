"""Queries of polling, notifications, quotas, plans, billing, idempotency, feeds and followers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from postlake.operators import catalog as C, scope, states as T, stored
from postlake.plans.base import Tables, query
from postlake.streaming import delivery, events as arrivals, folds, polling

_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'new_jobs' WHEN 'view' THEN 'no_change' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'rate_limited' ELSE 'no_change' END"


def _outcome():
    kind = F.col("event_type")
    return F.when(kind == "purchase", "new_jobs").when(kind == "error", "failed").when(kind == "click", "rate_limited").otherwise("no_change")


_CURRENT, _FAILURES = "[60, 300, 900, 3600][CAST(event_id % 4 AS INT) + 1]", "CAST(event_id % 7 + 1 AS INT)"


@query(
    "X15_next_poll",
    f"""SELECT event_id, CASE o WHEN 'new_jobs' THEN 60 WHEN 'no_change' THEN CASE c WHEN 60 THEN 120 WHEN 300 THEN 600 WHEN 900 THEN 1800 ELSE 3600 END WHEN 'rate_limited' THEN least(3600, c * 2) ELSE CASE WHEN n >= 5 THEN 3600 ELSE c END END AS interval,
  CASE o WHEN 'new_jobs' THEN 60 WHEN 'no_change' THEN CASE c WHEN 60 THEN 120 WHEN 300 THEN 600 WHEN 900 THEN 1800 ELSE 3600 END WHEN 'rate_limited' THEN least(14400, c * 2 ** n) ELSE CASE WHEN n >= 5 THEN 21600 ELSE least(14400, c * 2 ** (n - 1)) END END::INT AS sleep,
  o = 'failed' AND n >= 5 AS circuit_open FROM (SELECT event_id, {_OUTCOME} AS o, {_CURRENT} AS c, {_FAILURES} AS n FROM events)""",
)
def x15(t: Tables) -> DataFrame:
    current = F.element_at(F.array(*[F.lit(x) for x in (60, 300, 900, 3600)]), (F.col("event_id") % 4 + 1).cast("int"))
    failures = (F.col("event_id") % 7 + 1).cast("int")
    return t.events.select("event_id", T.next_poll(_outcome(), current, F.lit(60), F.lit(3600), failures, F.lit(None).cast("double")).alias("p")).select("event_id", "p.*")


@query(
    "X16_poll_loop",
    f"""WITH RECURSIVE p AS (SELECT user_id, event_id, {_OUTCOME} AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 60::INT AS interval, 0::INT AS sleep, 0::INT AS failures, false AS circuit_open FROM events
    UNION ALL SELECT user_id, n, event_id, CASE o WHEN 'new_jobs' THEN 60 WHEN 'no_change' THEN quieter WHEN 'rate_limited' THEN least(3600, c * 2) ELSE CASE WHEN k >= 5 THEN 3600 ELSE c END END::INT,
      CASE o WHEN 'new_jobs' THEN 60 WHEN 'no_change' THEN quieter WHEN 'rate_limited' THEN least(14400, c * 2 ** k) ELSE CASE WHEN k >= 5 THEN 21600 ELSE least(14400, c * 2 ** (k - 1)) END END::INT,
      CASE WHEN o IN ('new_jobs', 'no_change') OR (o = 'failed' AND k >= 5) THEN 0 ELSE k END::INT, o = 'failed' AND k >= 5
    FROM (SELECT p.*, f.interval AS c, f.failures + 1 AS k,
        CASE WHEN f.interval <= 90 THEN 120 WHEN f.interval <= 210 THEN 300 WHEN f.interval <= 450 THEN 600 WHEN f.interval <= 750 THEN 900 WHEN f.interval <= 1350 THEN 1800 ELSE 3600 END AS quieter
      FROM f JOIN p ON p.user_id = f.user_id AND p.n = f.n + 1))
  SELECT user_id, event_id, interval, sleep, failures, circuit_open FROM f WHERE n > 0""",
)
def x16(t: Tables) -> DataFrame:
    polls = t.events.select("user_id", "ts", "event_id", _outcome().alias("outcome"), F.lit(None).cast("double").alias("retry_after"))
    return folds.poll_loop().batch(polls, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "interval", "sleep", "failures", "circuit_open")


_SAID = "CASE WHEN n = 1 THEN 'start' WHEN event_type = 'purchase' THEN 'new_jobs' WHEN event_type = 'view' THEN 'no_change' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'poll_now' WHEN event_id % 2 = 0 THEN 'stop' ELSE 'start' END"


def _said(t: Tables) -> DataFrame:
    """Rows about sources: users as sources, their events as outcomes of polls and as signals, a hundred times as fast."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e8).alias("at")
    return t.events.withColumn("n", n).select("user_id", "event_id", at, F.expr(_SAID).alias("kind"), F.lit(None).cast("double").alias("retry_after"))


@query(
    "X16_timers",
    f"""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch(ts)::DOUBLE / 100 AS tm, {_SAID} AS kind, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)),
  f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'stopped' AS mode, 0.0::DOUBLE AS until, 0::INT AS interval, 0::INT AS failures, false AS wake, CAST([] AS DOUBLE[]) AS due FROM r
    UNION ALL SELECT user_id, n, event_id, CASE WHEN starts OR woken OR again THEN 'polling' WHEN kind = 'start' AND m = 'ending' THEN 'polling' WHEN kind = 'stop' THEN CASE WHEN m IN ('polling', 'ending') THEN 'ending' ELSE 'stopped' END
        WHEN ended AND m = 'ending' THEN 'stopped' WHEN ended AND opened THEN 'circuit' WHEN ended THEN 'sleeping' ELSE m END,
      CASE WHEN starts OR woken OR again OR kind = 'stop' OR (ended AND m = 'ending') THEN 0 WHEN ended THEN tm + sleep ELSE u END::DOUBLE,
      CASE WHEN starts THEN 60 WHEN ended THEN step ELSE interval END::INT, CASE WHEN starts THEN 0 WHEN ended THEN fails ELSE failures END::INT,
      CASE WHEN starts OR woken OR ended OR kind = 'stop' THEN false WHEN kind = 'poll_now' THEN w OR m = 'polling' ELSE w END,
      list_concat(fired, CASE WHEN starts OR woken OR again THEN [tm] ELSE [] END)
    FROM (SELECT *, kind = 'start' AND m = 'stopped' AS starts, kind = 'poll_now' AND m = 'sleeping' AS woken, ended AND m = 'polling' AND w AND NOT opened AS again FROM (
      SELECT *, kind IN ('new_jobs', 'no_change', 'failed') AND m IN ('polling', 'ending') AS ended, kind = 'failed' AND k >= 5 AS opened,
        CASE kind WHEN 'new_jobs' THEN 60 WHEN 'no_change' THEN quieter ELSE CASE WHEN k >= 5 THEN 3600 ELSE interval END END AS step,
        CASE kind WHEN 'new_jobs' THEN 60 WHEN 'no_change' THEN quieter ELSE CASE WHEN k >= 5 THEN 21600 ELSE least(14400, interval * 2 ** (k - 1)) END END AS sleep,
        CASE WHEN kind = 'failed' AND k < 5 THEN k ELSE 0 END AS fails
      FROM (SELECT r.*, f.interval, f.failures, f.failures + 1 AS k, late AS late_, CASE WHEN late THEN 'polling' ELSE f.mode END AS m, CASE WHEN late THEN 0 ELSE f.until END AS u, f.wake AND NOT late AS w,
          CASE WHEN late THEN [f.until] ELSE CAST([] AS DOUBLE[]) END AS fired,
          CASE WHEN f.interval <= 90 THEN 120 WHEN f.interval <= 210 THEN 300 WHEN f.interval <= 450 THEN 600 WHEN f.interval <= 750 THEN 900 WHEN f.interval <= 1350 THEN 1800 ELSE 3600 END AS quieter
        FROM (SELECT f.*, r.tm AS row_tm, f.mode IN ('sleeping', 'circuit') AND f.until <= r.tm AS late FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1) f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1))))
  SELECT event_id, mode, round(until, 3) AS until, interval, failures, len(due) AS n_due, round(due[1], 3) AS first_due, round(due[-1], 3) AS last_due FROM f WHERE n > 0""",
)
def x16_timers(t: Tables) -> DataFrame:
    """When each source became due: by its timer, woken early, or not at all as it was stopped or its circuit open."""
    found = polling.poll_timers().batch(_said(t), ["user_id"], ["at", "event_id"])
    due = lambda i: F.round(F.try_element_at("due", F.lit(i)), 3)
    return found.select("event_id", "mode", F.round("until", 3).alias("until"), "interval", "failures", F.size("due").cast("long").alias("n_due"), due(1).alias("first_due"), due(-1).alias("last_due"))


@query("X17_record_poll", f"SELECT user_id, max(ts) AS last_polled_at, max(ts) FILTER (WHERE {_OUTCOME} <> 'failed') AS last_success_at, count(*) FILTER (WHERE {_OUTCOME} = 'failed') AS failures FROM events GROUP BY 1")
def x17(t: Tables) -> DataFrame:
    failed = _outcome() == "failed"
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last_polled_at"), F.max(F.when(~failed, F.col("ts"))).alias("last_success_at"), F.count_if(failed).alias("failures"))


@query(
    "X18_backoff",
    "SELECT o_orderkey, CAST(o_orderkey % 7 + 1 AS INT) AS attempts, coalesce(list_sum(list_transform(range(CAST(o_orderkey % 7 AS INT)), lambda i: least(30, 2 ** i)))::BIGINT, 0) AS waited, (CASE WHEN o_orderkey % 7 > 0 THEN least(30, 2 ** (o_orderkey % 7 - 1)) END)::INT AS longest FROM orders",
)
def x18(t: Tables) -> DataFrame:
    """What each order's delivery waits in all before its last attempt, and its longest wait."""
    attempts = (F.col("o_orderkey") % 7 + 1).cast("int")
    waits = t.orders.select("o_orderkey", attempts.alias("attempts"), T.backoff(1, 30, attempts).alias("waits"))
    return waits.select("o_orderkey", "attempts", F.aggregate("waits", F.lit(0).cast("long"), lambda s, x: s + x).alias("waited"), F.array_max("waits").alias("longest"))


@query("X19_fan_out_once", "SELECT DISTINCT 'eval-' || user_id || '-' || event_type AS id FROM events")
def x19(t: Tables) -> DataFrame:
    return t.events.select(F.concat(F.lit("eval-"), F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("id")).distinct()


_HITS = "h AS (SELECT user_id, event_id, event_type, epoch(ts)::DOUBLE AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(
    "X20_sliding_limit",
    f"""WITH RECURSIVE {_HITS}, f AS (SELECT user_id, n, event_id, true AS allowed, [tm] AS log FROM h WHERE n = 1
    UNION ALL SELECT user_id, n, event_id, len(old) < 5, CASE WHEN len(old) < 5 THEN list_append(old, tm) ELSE old END
    FROM (SELECT h.*, list_filter(log, lambda x: x > tm - 86400) AS old FROM f JOIN h ON h.user_id = f.user_id AND h.n = f.n + 1))
  SELECT user_id, event_id, allowed, CAST(5 - len(log) AS INT) AS remaining FROM f""",
)
def x20(t: Tables) -> DataFrame:
    hits = t.events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return folds.sliding_limit(5, 86_400.0).batch(hits, ["user_id"], ["at", "event_id"]).select("user_id", "event_id", "allowed", "remaining")


@query("X21_daily_quota", "SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def x21(t: Tables) -> DataFrame:
    return T.within_quota(t.events, "user_id", "ts", "event_id", 2).select("event_id", "allowed")


_PLAN = "CASE WHEN c_custkey % 4 IN (0, 1) THEN p WHEN c_custkey % 4 = 2 AND c_custkey % 3 = 0 THEN p ELSE 'free' END"


@query(
    "X22_effective_plan",
    f"SELECT c_custkey, plan, CASE plan WHEN 'free' THEN 3 WHEN 'pro' THEN 25 ELSE 100 END AS sources FROM (SELECT c_custkey, {_PLAN} AS plan FROM (SELECT c_custkey, ['free', 'pro', 'team'][CAST(c_nationkey % 3 AS INT) + 1] AS p FROM customer))",
)
def x22(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    status = F.when(k == 0, "active").when(k == 1, "trialing").when(k == 2, "past_due").otherwise("cancelled")
    until = F.when(F.col("c_custkey") % 3 == 0, F.expr("TIMESTAMP '2024-07-02'")).otherwise(F.expr("TIMESTAMP '2024-06-30'"))
    paid = F.element_at(F.array(*[F.lit(p) for p in T.PLANS]), (F.col("c_nationkey") % 3 + 1).cast("int"))
    held = t.customer.select("c_custkey", T.effective_plan(paid, status, until, F.expr("TIMESTAMP '2024-07-01'")).alias("plan"))
    return held.select("c_custkey", "plan", T.plan_limits(F.col("plan")).sources.alias("sources"))


_KIND = "CASE event_type WHEN 'signup' THEN 'activated' WHEN 'purchase' THEN 'charged' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'charged' ELSE 'cancelled' END"


@query(
    "X23_billing",
    f"SELECT user_id, CASE WHEN kind IN ('activated', 'charged') THEN 'active' WHEN kind = 'failed' THEN 'past_due' ELSE 'cancelled' END AS status, CASE WHEN kind = 'failed' THEN ts + INTERVAL '3' DAY END AS grace_until FROM (SELECT *, {_KIND} AS kind FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def x23(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    made = F.when(kind == "signup", "activated").when(kind.isin("purchase", "view"), "charged").when(kind == "error", "failed").otherwise("cancelled")
    events = t.events.select("user_id", "event_id", "ts", made.alias("kind"), F.lit(None).cast("timestamp_ntz").alias("period_end"))
    return T.billing_state(events.unionAll(events), ["user_id"])


@query(
    "X24_circuit",
    f"""WITH RECURSIVE {_HITS}, f AS (SELECT user_id, n, event_id, true AS tried, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed, tm AS last FROM h WHERE n = 1
    UNION ALL SELECT user_id, n, event_id, NOT waits, CASE WHEN waits THEN failed WHEN event_type = 'error' THEN failed + 1 ELSE 0 END, CASE WHEN waits THEN last ELSE tm END
    FROM (SELECT h.*, failed, last, failed >= 2 AND h.tm - last < 86400 AS waits FROM f JOIN h ON h.user_id = f.user_id AND h.n = f.n + 1))
  SELECT user_id, event_id, tried, failed >= 2 AS open FROM f""",
)
def x24(t: Tables) -> DataFrame:
    calls = t.events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok"))
    return folds.circuit_breaker(2, 86_400.0).batch(calls, ["user_id"], ["at", "event_id"]).select("user_id", "event_id", "tried", "open")


_REQUESTS = """r AS (SELECT event_id, user_id, epoch(ts)::DOUBLE AS tm, CAST(event_id % 3 AS VARCHAR) AS fp, CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status, (event_id % 7) * 5000.0::DOUBLE AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


@query(
    "X25_idempotency",
    f"""WITH RECURSIVE {_REQUESTS},
  f AS (SELECT user_id, n, event_id, 'executed' AS verdict, CAST(NULL AS VARCHAR) AS kept, 0.0::DOUBLE AS until, fp AS busy, tm + seconds AS ends, status AS answer FROM r WHERE n = 1
    UNION ALL SELECT user_id, n, event_id, verdict, kept, until, CASE WHEN verdict = 'executed' THEN fp ELSE busy END, CASE WHEN verdict = 'executed' THEN tm + seconds ELSE ends END, CASE WHEN verdict = 'executed' THEN status ELSE answer END
    FROM (SELECT *, CASE WHEN tm < until AND kept = fp THEN 'replayed' WHEN tm < until THEN 'mismatch' WHEN busy IS NOT NULL THEN 'in_progress' ELSE 'executed' END AS verdict
      FROM (SELECT r.*, CASE WHEN tm >= ends AND busy IS NOT NULL AND answer < 500 AND answer <> 429 THEN busy ELSE kept END AS kept, CASE WHEN tm >= ends AND busy IS NOT NULL AND answer < 500 AND answer <> 429 THEN ends + 86400 ELSE until END AS until,
          CASE WHEN tm < ends THEN busy END AS busy, ends, answer FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)))
  SELECT event_id, verdict FROM f""",
)
def x25(t: Tables) -> DataFrame:
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    status, seconds = F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"), (F.col("event_id") % 7 * 5000.0).alias("seconds")
    requests = t.events.select("event_id", "user_id", at, (F.col("event_id") % 3).cast("string").alias("fingerprint"), status, seconds)
    return folds.idempotency().batch(requests, ["user_id"], ["at", "event_id"]).select("event_id", "verdict")


@query("F12_routing", "SELECT event_id FROM events WHERE (user_id % 3 <> 0 AND user_id % 5 = 2) OR (user_id % 3 = 0 AND event_type IN ('click', 'view'))")
def f12(t: Tables) -> DataFrame:
    events = t.events.select("event_id", F.col("event_type").alias("source_id"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 5).alias("workspace_id"))
    followed = t.spark.sql("SELECT explode(array('click', 'view')) AS source_id")
    return T.routed(events, followed, 2).select("event_id")


@query("X27_delivery", "SELECT event_id FROM events WHERE (user_id % 3 <> 0 AND user_id % 5 = 1) OR (user_id % 3 = 0 AND event_type IN ('error', 'purchase'))")
def x27(t: Tables) -> DataFrame:
    stream = arrivals.read_events(t.spark, f"{t.folder}/events.parquet", t.events.schema)
    sent = stream.select("event_id", F.col("event_type").alias("source_id"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 5).alias("workspace_id"))
    followed = t.spark.sql("SELECT explode(array('error', 'purchase')) AS source_id")
    return arrivals.drained(arrivals.audience(sent, followed, 1).select("event_id"), stored.shared_folder(t.spark))


_HUB_ROWS = """CASE event_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'disconnect' WHEN 'click' THEN 'take' ELSE 'event' END AS kind, CAST(event_id % 6 AS INT) AS client,
  CASE WHEN event_type = 'signup' THEN event_id % 2 WHEN event_id % 3 < 2 THEN event_id % 3 END AS workspace_id, CASE WHEN event_type = 'signup' THEN event_id % 4 = 0 ELSE event_id % 2 = 0 END AS followed"""


@query(
    "X27_bounded_queues",
    f"""WITH RECURSIVE r AS (SELECT user_id, event_id, {_HUB_ROWS}, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BOOLEAN AS admitted, 0::INT AS delivered, 0::INT AS dropped, list_transform(range(6), lambda i: {{'q': -1, 'w': -1, 's': false}}) AS held FROM r
    UNION ALL SELECT user_id, n, event_id, CASE WHEN kind = 'connect' THEN lets END,
      CASE WHEN kind = 'take' THEN greatest(0, least(2, held[client + 1].q)) WHEN kind = 'event' THEN len(list_filter(range(6), lambda i: sees[i + 1] AND held[i + 1].q < 3)) ELSE 0 END::INT,
      CASE WHEN kind = 'event' THEN len(list_filter(range(6), lambda i: sees[i + 1] AND held[i + 1].q >= 3)) ELSE 0 END::INT,
      list_transform(range(6), lambda i: {{
        'q': (CASE WHEN kind = 'event' AND sees[i + 1] THEN CASE WHEN held[i + 1].q >= 3 THEN -1 ELSE held[i + 1].q + 1 END WHEN i <> client THEN held[i + 1].q WHEN kind = 'connect' THEN CASE WHEN lets THEN 0 ELSE held[i + 1].q END
          WHEN kind = 'disconnect' THEN -1 WHEN kind = 'take' AND held[i + 1].q > 0 THEN greatest(0, held[i + 1].q - 2) ELSE held[i + 1].q END)::INT,
        'w': (CASE WHEN i = client AND kind = 'connect' AND lets THEN workspace_id ELSE held[i + 1].w END)::INT, 's': CASE WHEN i = client AND kind = 'connect' AND lets THEN followed ELSE held[i + 1].s END}})
    FROM (SELECT *, held[client + 1].q >= 0 OR len(list_filter(held, lambda h: h.q >= 0)) < 4 AS lets, list_transform(held, lambda h: h.q >= 0 AND CASE WHEN workspace_id IS NOT NULL THEN h.w = workspace_id ELSE h.s AND followed END) AS sees
      FROM (SELECT r.*, held FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)))
  SELECT event_id, admitted, delivered, dropped, CAST(len(list_filter(held, lambda h: h.q >= 0)) AS INT) AS connected FROM f WHERE n > 0""",
)
def x27_queues(t: Tables) -> DataFrame:
    """Clients that are admitted, read, fall behind and are dropped; an instance is a user, its rows are the user's events."""
    rows = t.events.select("user_id", "ts", "event_id", *[F.expr(x.replace("INT)", "STRING)")) for x in _HUB_ROWS.split(",\n")[0].split(", ")], *[F.expr(x) for x in _HUB_ROWS.split(",\n")[1].split(", ")], F.lit(2).alias("n"))
    rows = rows.withColumn("sources", F.when(F.col("followed"), F.array(F.lit("s"))))
    found = delivery.hub(4, 3).batch(rows, ["user_id"], ["ts", "event_id"])
    return found.select("event_id", "admitted", "delivered", F.size("dropped").alias("dropped"), "connected")


@query("X28_event_numbers", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events WHERE event_type <> 'view'")
def x28(t: Tables) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.where("event_type <> 'view'").select("event_id", number.cast("long").alias("number"))


@query("X28_numbered_stream", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events WHERE user_id % 5 = 1 OR event_type IN ('error', 'view')")
def x28_stream(t: Tables) -> DataFrame:
    """Numbers that go on over the micro-batches of a stream that's stopped half-way and started again; events arrive in four files by time."""
    folder = stored.fresh_path(t.spark, "numbered-stream")
    events = t.events.select("event_id", "user_id", "ts", F.col("event_type").alias("source_id"), F.when(~F.col("event_type").isin("error", "view"), F.col("user_id") % 5).alias("workspace_id"))
    bounds = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(F.min("us").alias("low"), F.max("us").alias("high"))
    quarter = F.least(F.lit(3), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.col("low")) * 4 / F.greatest(F.lit(1), F.col("high") - F.col("low"))))
    timed = events.join(F.broadcast(bounds)).withColumn("quarter", quarter).drop("low", "high")
    routed = F.when(F.col("user_id") % 5 == 1, F.lit(1)).otherwise(F.col("workspace_id"))  # a user's own events go to their workspace, whatever their source
    timed = timed.withColumn("workspace_id", F.when(F.col("workspace_id").isNull() & (F.col("user_id") % 5 != 1), None).otherwise(routed))
    sink = delivery.NumberedSink(t.spark, folder, "user_id", ["ts", "event_id"], lambda: t.spark.sql("SELECT explode(array('error', 'view')) AS source_id"), 1)
    for start in (0, 2):
        for n in (start, start + 1):
            timed.where(F.col("quarter") == n).drop("quarter").coalesce(1).write.parquet(f"{folder}/in/{n}")
        stream = arrivals.read_events(t.spark, f"{folder}/in", timed.drop("quarter").schema)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return sink.read().select("event_id", F.col("number").cast("long").alias("number"))


@query("X29_feed_ring", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def x29(t: Tables) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.withColumn("n", newest).where("n <= 50").select("user_id", "event_id")


@query("X29_latest_stage", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY 1")
def x29_stage(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"))


@query("X29_toasts", "SELECT user_id, event_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'signup' AND (c.ts, c.event_id) > (e.ts, e.event_id)) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def x29_toasts(t: Tables) -> DataFrame:
    """The last three matches of each user since the feed was cleared."""
    kind = F.col("event_type")
    shown = F.when(kind == "purchase", "toast").when(kind == "signup", "clear").otherwise("other")
    return T.toasts(t.events.withColumn("kind", shown), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query(
    "X29_progress",
    "SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND coalesce(next > ts + INTERVAL '2' HOUR, true) THEN ts + INTERVAL '2' HOUR ELSE next END AS shown_until, event_type IN ('view', 'click') AND coalesce(next > ts + INTERVAL '2' HOUR, true) AS expired FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)",
)
def x29_progress(t: Tables) -> DataFrame:
    """How long each stage of a source is shown: until its next one, or until a stage in flight expires."""
    return T.shown_stages(t.events, "user_id", "ts", "event_id", F.col("event_type").isin("view", "click"), "2 hours").select("event_id", "shown_until", "expired")


@query(
    "X29_in_flight_sessions",
    "SELECT user_id, min(ts) AS started_at, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL '6' HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session",
)
def x29_sessions(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started_at"), "n")


@query("X30_stale_keys", "SELECT event_id, unnest(CASE event_type WHEN 'click' THEN ['jobs'] WHEN 'purchase' THEN ['jobs', 'dashboard'] WHEN 'error' THEN ['sources', 'runs'] WHEN 'signup' THEN ['profile'] ELSE [] END) AS key FROM events")
def x30(t: Tables) -> DataFrame:
    return T.stale_keys(t.events, "event_type").select("event_id", "key")


@query("X31_provisioning", "SELECT c_nationkey, arg_min(c_custkey, c_custkey) AS owner FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def x31(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 0").groupBy("c_nationkey").agg(F.min("c_custkey").alias("owner"))


@query("X32_followers", "SELECT o_custkey AS source_id, bool_or(o_orderstatus <> 'F') AS enabled FROM orders GROUP BY 1")
def x32(t: Tables) -> DataFrame:
    return T.followers_enabled(t.orders.select(F.col("o_custkey").alias("source_id"), (F.col("o_orderstatus") == "F").alias("paused")))


@query("X33_interval_floor", "SELECT p_partkey, greatest(300, least(p_size * 120, 3600)) AS seconds FROM part")
def x33(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.floored_interval(F.lit("pro"), F.col("p_size") * 120).alias("seconds"))


@query("X34_delete_workspace", "SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT 'orphans', count(*) FROM supplier WHERE s_nationkey = 7")
def x34(t: Tables) -> DataFrame:
    kept = T.delete_workspace(7, "nation", customer=t.customer.withColumnRenamed("c_nationkey", "nation"))["customer"]
    followed = kept.select(F.col("nation").alias("s_nationkey")).distinct()
    orphans = t.supplier.join(followed, "s_nationkey", "left_anti")
    return kept.agg(F.lit("customer").alias("name"), F.count("*").alias("n")).select("name", "n").union(orphans.agg(F.lit("orphans").alias("name"), F.count("*").alias("n")).select("name", "n"))


@query("X11_single_use_tokens", "SELECT user_id, min(ts) AS consumed_at FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-10' GROUP BY 1")
def x11(t: Tables) -> DataFrame:
    alive = t.events.where("event_type = 'click' AND ts < TIMESTAMP_NTZ '2024-01-10'")
    return alive.groupBy("user_id").agg(F.min("ts").alias("consumed_at"))


@query("C24_clip_events", "SELECT doc_id, length(text) <= 200 AS whole FROM documents")
def c24(t: Tables) -> DataFrame:
    event = F.struct("text", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i.cast("string")).alias("items"))
    text = F.get_json_object(T.clip_event(event), "$.text")
    return t.documents.select("doc_id", (text == F.col("text")).alias("whole"))


@query("F01_checked_write", "SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def f01_write(t: Tables) -> DataFrame:
    return scope.checked_write(t.customer.where("c_nationkey = 7"), scope.Scope(workspace=7), "c_nationkey").select("c_custkey")


@query("X07_listing_last_wins", "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1")
def x07_last(t: Tables) -> DataFrame:
    listing = t.conversations.select(F.lit("s").alias("source_id"), F.col("conv_id").alias("external_id"), "turn")
    return C.last_of_listing(listing, "turn").select(F.col("external_id").alias("conv_id"), "turn")
