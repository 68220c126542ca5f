"""Helpers of the training-data operators: the shared folder, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Bytes of an Arrow batch at most; a single row may be larger.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or else the context's checkpoint folder.

    Only where neither is set and Spark runs on one machine, as in tests, a temporary folder is set; on
    a cluster that's an error, as executors wouldn't see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="postlake-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches of this session hold ``rows`` rows and ``BATCH_BYTES`` bytes at most; settings below stay.

    Spark reads both settings when it runs a query, so they're set for the session; smaller batches
    change no result.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it again.

    This cuts the lineage, survives lost executors, and gives the planner the true size, so that
    it broadcasts the table only when it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, group: list[str], order: Column, parts: int | Column, out: str, weight: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """``df`` with the 0-based rank ``out`` of a row in its group under a random order; with ``weight`` the sum of the weights before it.

    ``order`` is a hash of ``_key``, a column of ``df``; where hashes are equal, ``ties`` (columns that tell rows apart) decide, so that a task that runs
    again gives the same places. A group is ranked in ``parts`` parts (a column of the group), in as
    many tasks, so a hot group isn't sorted in one. Group columns mustn't be null.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    df = df.withColumn("_order", order).withColumn("_parts", F.lit(parts) if isinstance(parts, int) else parts)
    df = df.withColumn("_part", F.pmod(F.shiftrightunsigned("_order", 20), F.col("_parts")).cast("int"))
    counts = df.where("_parts > 1").groupBy(*group, "_part").agg(F.sum(one).alias("_n"))
    starts = stored(counts.withColumn("_start", F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")).drop("_n"), "rank-starts")
    inside = Window.partitionBy(*group, "_part").orderBy("_order", "_key", *(ties or []))
    own = F.row_number().over(inside) - 1 if weight is None else F.coalesce(F.sum(one).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(out, own.cast("long")).join(starts, [*group, "_part"], "left").withColumn(out, F.col(out) + F.coalesce("_start", F.lit(0))).drop("_order", "_parts", "_part", "_start")


def numbered(df: DataFrame, order: Column, out: str) -> DataFrame:
    """``df`` sorted and stored, with the 0-based place ``out`` of each row: places in range partitions, plus the counts of those before."""
    place = F.monotonically_increasing_id()
    placed = stored(df.orderBy(order).withColumns({"_range": F.shiftright(place, 33).cast("int"), out: place.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    before = placed.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_start", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n"))
    return placed.join(F.broadcast(before.select("_range", "_start")), "_range").withColumn(out, F.col(out) + F.col("_start")).drop("_range", "_start")


def crc32_sql(data: str) -> str:
    """DuckDB SQL for the crc32 of a blob, by the table ``crc_table(t)`` of ``CRC_TABLE_SQL``."""
    by = f"list_transform(regexp_extract_all(hex({data}), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce({by}, lambda c, y: xor(c >> 8, t[1 + xor(c & 255, y)]), 4294967295))"


#: The table of crc32 by its rule: eight shifts of each byte, the polynomial added where a bit falls out.
CRC_TABLE_SQL = "crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t)"
