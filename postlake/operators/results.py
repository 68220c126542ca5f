"""Results of evaluations that land only on the text they were made from.

An evaluation reads a posting, takes its time, and lands later; meanwhile the posting may have changed. Each
row of work therefore carries the hash of what it read. Landing compares it with the catalogue as it is now, and
keeps work that is superseded out, unless it's forced. Results are versioned, and landing the same work twice changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The stages of an evaluation, in order.
STAGES = ("eligibility", "enrich", "embed", "rank", "notify")


def content_hash(*fields: Column) -> Column:
    """SHA-256 over fields, nulls told from empty ones."""
    return F.sha2(F.to_json(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"}), 256)


def verdicts(work: DataFrame, catalogue: DataFrame, results: DataFrame) -> DataFrame:
    """``work`` with ``verdict``: landed, superseded, missing (the posting is gone) or repeated (this work has landed before).

    ``work`` has job_id, work_id, content_hash and force; ``catalogue`` job_id and content_hash; ``results`` job_id, work_id and version. A null hash in work
    asks for no comparison. Of several pieces of work on one posting that could land, the one with the greatest work_id does; the others are superseded.
    """
    now = catalogue.groupBy("job_id").agg(F.max("content_hash").alias("_hash"))
    landed = results.groupBy("job_id").agg(F.collect_set("work_id").alias("_landed"), F.max("version").alias("_version"))
    met = work.join(now, "job_id", "left").join(landed, "job_id", "left")
    same = F.col("content_hash").isNull() | (F.col("content_hash") == F.col("_hash")) | F.coalesce("force", F.lit(False))
    verdict = F.when(F.col("_hash").isNull(), "missing").when(F.coalesce(F.array_contains("_landed", F.col("work_id")), F.lit(False)), "repeated").when(same, "landed").otherwise("superseded")
    met = met.withColumn("verdict", verdict)
    last = F.row_number().over(Window.partitionBy("job_id", "verdict").orderBy(F.desc("work_id")))
    met = met.withColumn("_last", last)
    return met.withColumn("verdict", F.when((F.col("verdict") == "landed") & (F.col("_last") > 1), "superseded").otherwise(F.col("verdict"))).drop("_last", "_landed", "_hash")


def land(work: DataFrame, catalogue: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` with the work that lands, as each posting's next version. ``results`` keeps all versions; see :func:`latest`."""
    new = verdicts(work, catalogue, results).where("verdict = 'landed'").withColumn("version", F.coalesce("_version", F.lit(0)) + 1)
    return results.unionByName(new.select(*results.columns))


def latest(results: DataFrame) -> DataFrame:
    """The last version of each posting's result."""
    names = [c for c in results.columns if c != "job_id"]
    return results.groupBy("job_id").agg(F.max_by(F.struct(*names), "version").alias("r")).select("job_id", "r.*")


def next_stage(finished: DataFrame, catalogue: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(job_id, content_hash, stage): where each posting's evaluation goes on, after the last stage that finished on its present text.

    ``finished`` (job_id, content_hash, stage) may hold stages of earlier texts, which don't count, and may lack one in between, which is then next. Postings with all
    stages finished aren't listed.
    """
    done = finished.groupBy("job_id", "content_hash").agg(F.collect_set("stage").alias("_done"))
    met = catalogue.select("job_id", "content_hash").join(done, ["job_id", "content_hash"], "left")
    open_ = reduce(lambda rest, s: F.when(~F.coalesce(F.array_contains("_done", s), F.lit(False)), s).otherwise(rest), reversed(stages), F.lit(None).cast("string"))
    return met.withColumn("stage", open_).where("stage IS NOT NULL").select("job_id", "content_hash", "stage")
