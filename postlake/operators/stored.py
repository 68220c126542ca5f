"""Tables written on the way to a result, and rows numbered without sorting them in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="postlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``df`` with the place ``out`` of each row in the whole order, from 1.

    Rows are sorted in ranges, by as many tasks; a row's place is its place in its range and the number of
    rows in the ranges before. The order must tell rows apart, else equal ones take any of their places.
    """
    spot = F.monotonically_increasing_id()  # the partition in the upper bits, the row's number in it in the lower 33
    rows = stored(df.orderBy(*order).withColumns({"_range": F.shiftright(spot, 33), "_row": spot.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # a row per range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return rows.join(before, "_range").withColumn(out, F.col("_before") + F.col("_row") + 1).drop("_range", "_row", "_before")
