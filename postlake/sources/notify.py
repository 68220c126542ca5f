"""Rendering and signing of notifications, and the outbox sink of streams."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from postlake.functions.text import canonical_json, escape_html


def signature(secret: str, timestamp: Column, body: Column) -> Column:
    """Hex HMAC-SHA256 of ``timestamp.body``, as two hashes over the padded key; a null body leaves the timestamp alone."""
    raw = secret.encode()
    key = (raw if len(raw) <= 64 else hashlib.sha256(raw).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    message = F.concat_ws(".", timestamp.cast("string"), body).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def webhook(jobs: DataFrame, secret: str, timestamp: Column) -> DataFrame:
    """job_id, body and signature of each posting's webhook."""
    made = jobs.withColumn("body", canonical_json(job_id=F.col("job_id"), title=F.col("title"), score=F.col("score")))
    return made.select("job_id", "body", signature(secret, timestamp, F.col("body")).alias("signature"))


def email(title: Column, score: Column, reasons: Column, most: int = 8) -> Column:
    """HTML of an e-mail: escaped title, score in percent, up to ``most`` reasons."""
    items = F.array_join(F.transform(F.slice(reasons, 1, most), lambda r: F.concat(F.lit("<li>"), escape_html(r), F.lit("</li>"))), "")
    return F.format_string("<h2>%s</h2><p>%.0f%%</p><ul>%s</ul>", escape_html(title), score * 100, items)


def outbox_sink(path: str, buckets: int = 64):
    """A ``foreachBatch`` function that appends each key once; batches that come again add nothing.

    The outbox lies in buckets by key, and a batch reads the keys of its own buckets only.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["key"]).withColumn("bucket", (F.crc32(F.col("key").cast("binary")) % buckets).cast("int"))
        wanted = [r.bucket for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
        try:
            there = spark.read.parquet(path).where(F.col("bucket").isin(wanted)).select("key")
            new = new.join(there, "key", "left_anti")
        except AnalysisException as e:  # the first batch has nothing to read
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        new.write.mode("append").partitionBy("bucket").parquet(path)

    return write
