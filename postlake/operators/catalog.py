"""A catalogue of postings against listings of their boards: new, updated, unchanged, duplicate and closed rows as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.operators.dedupe import equal_duplicates, first_per

KEY = ["source_id", "external_id"]
#: Closing guard: with this many open postings, a listing of less than this share of them closes nothing.
GUARD_OPEN, GUARD_SHARE = 10, 0.5
MOST_PER_LISTING = 5000


def capped(listing: DataFrame, position: str = "position", most: int = MOST_PER_LISTING) -> DataFrame:
    """The first ``most`` postings of each source's listing."""
    order = Window.partitionBy("source_id").orderBy(position)
    return listing.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def last_of_listing(listing: DataFrame, position: str = "position") -> DataFrame:
    """One row per key: of repeated postings the last of the listing."""
    return first_per(listing, KEY, F.desc(position))


def classify(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """KEY and change (new, updated, unchanged or missing) by content hash; missing ones only of sources that were listed."""
    now = listing.select(*KEY, F.col("content_hash").alias("hash"))
    was = catalogue.join(listing.select("source_id").distinct(), "source_id", "left_semi").select(*KEY, F.col("content_hash").alias("old_hash"), "closed_at")
    change = F.when(F.col("old_hash").isNull(), "new").when(F.col("hash").isNull(), "missing").when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("updated")
    return now.join(was, KEY, "full_outer").withColumn("change", change)


def closable(changes: DataFrame) -> DataFrame:
    """KEY of missing open postings that may be closed.

    Open postings are counted as after the update: what was open and what is listed now. A source that
    lists nothing closes nothing.
    """
    listed = F.col("change") != "missing"
    per = changes.groupBy("source_id").agg(F.count(F.when(listed, 1)).alias("seen"), F.count(F.when(listed | F.col("closed_at").isNull(), 1)).alias("open"))
    ok = per.where((F.col("seen") > 0) & ~((F.col("open") >= GUARD_OPEN) & (F.col("seen") < GUARD_SHARE * F.col("open")))).select("source_id")
    return changes.where(~listed & F.col("closed_at").isNull()).join(ok, "source_id", "left_semi").select(*KEY)


def apply_listing(catalogue: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """The catalogue after a listing (both of the same columns, the listing without state).

    New rows take ``now`` where the publication date is unknown and are linked to an earlier original of
    another source; updated ones get the next version, reopen and keep date and link; unchanged ones are
    seen again and reopen, but a closed state stays; missing ones close if the guard lets them. The
    result has ``change``, closed included.
    """
    listing = last_of_listing(listing)
    changes = classify(listing, catalogue)
    closing = closable(changes).withColumn("closing", F.lit(True))
    body = [c for c in listing.columns if c not in (*KEY, "position", "published_at", "job_id")]
    fresh = listing.join(changes.where("change = 'new'").select(*KEY), KEY, "left_semi")
    links = equal_duplicates(fresh, catalogue.where("closed_at IS NULL AND duplicate_of IS NULL"))
    added = fresh.join(links, "job_id", "left").select(
        "job_id", *KEY, *body, F.coalesce("published_at", now).alias("published_at"), F.lit(1).alias("version"), now.alias("first_seen_at"), now.alias("last_seen_at"),
        F.lit(None).cast("timestamp").alias("closed_at"), "duplicate_of", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("discovered").alias("state"),
        F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("new").alias("change"),
    )
    seen = listing.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in body], F.lit(True).alias("seen"))
    old = catalogue.join(seen, KEY, "left").join(closing, KEY, "left").withColumn("is_seen", F.coalesce("seen", F.lit(False)))
    updated = F.col("is_seen") & (F.col("new_content_hash") != F.col("content_hash"))
    closes = F.coalesce("closing", F.lit(False))
    kept = old.select(
        "job_id", *KEY, *[F.when(updated, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in body], "published_at",
        (F.col("version") + updated.cast("int")).alias("version"), "first_seen_at", F.when(F.col("is_seen"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(F.col("is_seen"), None).when(closes, now).otherwise(F.col("closed_at")).alias("closed_at"), "duplicate_of",
        F.when(updated, "discovered").when(closes, "closed").otherwise(F.col("state")).alias("state"),
        F.when(updated, "updated").when(F.col("is_seen"), "unchanged").when(closes, "closed").otherwise("absent").alias("change"),
    )
    return kept.unionByName(added)


def counters(applied: DataFrame) -> DataFrame:
    """One row per source: new, updated, unchanged, duplicates, closed."""
    n = lambda change: F.count_if(F.col("change") == change)
    return applied.groupBy("source_id").agg(n("new").alias("new"), n("updated").alias("updated"), n("unchanged").alias("unchanged"), n("duplicate").alias("duplicates"), n("closed").alias("closed"))


def reset_verdicts(profile_jobs: DataFrame, applied: DataFrame) -> DataFrame:
    """Verdicts of updated postings back to pending without a score, of all profiles."""
    touched = applied.where("change = 'updated'").select("job_id", F.lit(True).alias("_touched"))
    old = profile_jobs.join(touched, "job_id", "left")
    return old.select(*[F.when(F.col("_touched"), F.lit("pending") if c == "status" else F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("status", "score") else F.col(c) for c in profile_jobs.columns])


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key of both, changes before what's there among equals."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return first_per(both, keys, F.desc("_new"), F.desc(order)).drop("_new")


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with those of ``rows`` whose key it lacks, each key once."""
    return target.unionByName(rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))
