"""State machines as set operations: polling, outbox, quotas, plans, billing, feeds, followers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.functions import vocabulary as V


def next_poll(outcome: Column, current: Column, low: Column, high: Column, failures: Column, retry_after: Column) -> Column:
    """(interval, sleep, circuit_open) after a poll: new_jobs, no_change, rate_limited or failed. ``failures`` counts this one."""
    now = F.greatest(low, F.least(high, current))
    ladder = F.filter(F.array(*[F.lit(s) for s in V.POLL_LADDER]), lambda s: (s >= low) & (s <= high))
    ladder = F.when(F.size(ladder) > 0, ladder).otherwise(F.array(now))
    nearest = F.array_min(F.transform(ladder, lambda s, i: F.struct(F.abs(s - now).alias("d"), i.alias("i")))).i
    quieter = F.element_at(ladder, F.least(nearest + 2, F.size(ladder)).cast("int"))
    backed = F.least(F.lit(float(V.POLL_MOST_SECONDS)), now * F.pow(F.lit(2.0), F.greatest(F.lit(1), failures))).cast("int")
    limited = F.greatest(backed, F.coalesce(retry_after.cast("int"), F.lit(0)))
    failed = F.greatest(F.least(F.lit(float(V.POLL_MOST_SECONDS)), now * F.pow(F.lit(2.0), failures - 1)).cast("int"), low)
    made = lambda interval, sleep, is_open=False: F.struct(interval.cast("int").alias("interval"), sleep.cast("int").alias("sleep"), F.lit(is_open).alias("circuit_open"))
    return (
        F.when(outcome == "new_jobs", made(low, low))
        .when(outcome == "no_change", made(quieter, quieter))
        .when(outcome == "rate_limited", made(F.greatest(low, F.least(high, F.greatest(now * 2, low))), limited))
        .when((outcome == "failed") & (failures >= V.POLL_FAILURES), made(high, F.lit(V.POLL_CIRCUIT_SECONDS), True))
        .when(outcome == "failed", made(now, failed))
        .otherwise(F.raise_error(F.concat(F.lit("unknown outcome "), outcome)))
    )


def notification_outbox(tries: DataFrame) -> DataFrame:
    """(key, status, attempts): tries of a key count up to the first that was delivered. ``tries`` has key, ts, seq and delivered."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("ts", "seq"))
    per = tries.withColumn("n", place).groupBy("key").agg(F.min(F.when(F.col("delivered"), F.col("n"))).alias("first"), F.count("*").alias("all"))
    return per.select("key", F.when(F.col("first").isNotNull(), "sent").otherwise("failed").alias("status"), F.coalesce("first", "all").cast("long").alias("attempts"))


def backoff(first: int, most: int, attempts: int | Column) -> Column:
    """Seconds before each retry of so many attempts, doubling up to ``most``; none for a single attempt."""
    retries = F.lit(attempts) - 1
    waits = F.transform(F.sequence(F.lit(0), F.greatest(retries, F.lit(1)) - 1), lambda i: F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), i)).cast("int"))
    return F.when(retries > 0, waits).otherwise(F.array().cast("array<int>"))


def within_quota(events: DataFrame, workspace: str, ts: str, tie: str, limit: int) -> DataFrame:
    """``events`` with allowed: the first ``limit`` of a workspace and UTC day."""
    order = Window.partitionBy(workspace, F.to_date(ts)).orderBy(ts, tie)
    return events.withColumn("allowed", F.row_number().over(order) <= limit)


#: Limits of plans: sources, members, evaluations a day, least seconds between polls. Grace after a missed payment, in days.
PLANS = {"free": (3, 1, 200, 900), "pro": (25, 5, 5000, 300), "team": (100, 25, 20000, 60)}
GRACE_DAYS = 3


def effective_plan(plan: Column, status: Column, grace_until: Column, now: Column) -> Column:
    """The plan that holds: the paid one while it's active or in grace, else free."""
    return F.when(status.isin("active", "trialing"), plan).when((status == "past_due") & (grace_until > now), plan).otherwise("free")


def plan_limits(plan: Column) -> Column:
    from postlake.functions.text import lookup

    names = ("sources", "members", "evaluations", "poll_seconds")
    return F.struct(*[lookup({p: v[i] for p, v in PLANS.items()}, plan).alias(n) for i, n in enumerate(names)])


def floored_interval(plan: Column, wanted: Column, high: int = 3600) -> Column:
    """A poll interval within what a plan allows."""
    return F.greatest(plan_limits(plan).poll_seconds, F.least(wanted, F.lit(high)))


def billing_state(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each subscription: events count once by id, in the order of their time.

    ``events`` has event_id, ts, kind (activated, charged, failed, cancelled) and period_end. A failed charge
    gives grace until three days after the period's end or the event, whichever is later.
    """
    once = events.dropDuplicates(["event_id"])
    last = once.groupBy(*keys).agg(F.max(F.struct("ts", "event_id", "kind", "period_end")).alias("e"))
    kind = F.col("e.kind")
    status = F.when(kind.isin("activated", "charged"), "active").when(kind == "failed", "past_due").otherwise("cancelled")
    grace = F.when(kind == "failed", F.greatest(F.coalesce("e.period_end", "e.ts"), F.col("e.ts")) + F.expr(f"INTERVAL '{GRACE_DAYS}' DAY"))
    return last.select(*keys, status.alias("status"), grace.alias("grace_until"))


def routed(events: DataFrame, followed: DataFrame, workspace: object) -> DataFrame:
    """Events that a workspace gets: its own, or of no workspace and a source that it follows; the rest is dropped.

    Works on streams too; ``followed`` (source_id) is static.
    """
    f = followed.select("source_id", F.lit(True).alias("_followed")).distinct()
    joined = events.join(f, "source_id", "left")
    return joined.where((F.col("workspace_id") == F.lit(workspace)) | (F.col("workspace_id").isNull() & F.col("_followed"))).drop("_followed")


def toasts(events: DataFrame, key: str, order: list[str], most: int = 3) -> DataFrame:
    """The last ``most`` toasts of each key that no later ``clear`` took away; ``events`` has kind: toast, clear or other."""
    falling = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    later = events.where("kind IN ('toast', 'clear')").withColumn("_cleared", F.max(F.col("kind") == "clear").over(falling.rowsBetween(Window.unboundedPreceding, -1)))
    kept = later.where("kind = 'toast' AND coalesce(_cleared, false) = false").withColumn("_n", F.row_number().over(falling))
    return kept.where(F.col("_n") <= most).drop("_cleared", "_n")


def shown_stages(events: DataFrame, key: str, ts: str, tie: str, in_flight: Column, expiry: str = "30 seconds") -> DataFrame:
    """``events`` with shown_until and expired: a stage shows until the key's next event; one in flight without a next event within ``expiry`` expires."""
    following = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    end = F.col(ts) + F.expr(f"INTERVAL '{expiry}'")
    expired = in_flight & F.coalesce(F.col("_next") > end, F.lit(True))
    return events.withColumn("_next", following).withColumns({"shown_until": F.when(expired, end).otherwise(F.col("_next")), "expired": expired}).drop("_next")


#: Dashboard keys that an event makes stale.
STALE = {
    "click": ["jobs"],
    "purchase": ["jobs", "dashboard"],
    "error": ["sources", "runs"],
    "signup": ["profile"],
}


def stale_keys(events: DataFrame, kind: str) -> DataFrame:
    keys = F.create_map(*[x for k, v in STALE.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    return events.withColumn("key", F.explode(F.try_element_at(keys, F.col(kind))))


def followers_enabled(subscriptions: DataFrame) -> DataFrame:
    """(source_id, enabled): whether anyone follows a source unpaused."""
    return subscriptions.groupBy("source_id").agg(F.bool_or(~F.col("paused")).alias("enabled"))


def delete_workspace(workspace: object, key: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Tables without a workspace's rows."""
    return {n: d.where(F.coalesce(F.col(key) != F.lit(workspace), F.lit(True))) for n, d in tables.items()}


def clip_event(event: Column, most: int = 7000) -> Column:
    """JSON of an event, its lists halved up to five times while it's longer than ``most`` bytes.

    ``event`` is a struct with text (clipped to 200 characters) and items (20 at most).
    """
    def made(n: int) -> Column:
        return F.to_json(F.struct(F.substring(event.text, 1, 200).alias("text"), F.slice(event["items"], 1, n).alias("items")))

    sizes = [20, 10, 5, 2, 1]
    found = F.when(F.octet_length(made(sizes[0])) <= most, made(sizes[0]))
    for n in sizes[1:]:
        found = found.when(F.octet_length(made(n)) <= most, made(n))
    return found.otherwise(made(0))
