"""Content-addressed snapshots of what was fetched."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlake.functions.url import safe_segment
from postlake.operators.stored import stored

PREVIEW_CHARS = 200_000


def snapshot_key(source: Column, body: Column) -> Column:
    return F.concat(F.lit("staging/"), safe_segment(source), F.lit("/"), F.substring(F.sha2(body, 256), 1, 32), F.lit("/raw.json"))


def valid_key(key: Column) -> Column:
    """Whether a key is relative, of safe characters, and without steps up."""
    return key.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*$") & ~key.contains("..")


def preview(body: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.struct(F.substring(body, 1, chars).alias("text"), (F.length(body) > chars).alias("truncated"))


def write_snapshots(fetched: DataFrame, folder: str, index: DataFrame | None = None) -> DataFrame:
    """Writes bodies that ``index`` (key) doesn't have yet to Parquet by source, and returns their keys.

    ``fetched`` has source and body.
    """
    keyed = fetched.withColumn("key", snapshot_key(F.col("source"), F.col("body"))).dropDuplicates(["key"])
    new = keyed if index is None else keyed.join(index.select("key"), "key", "left_anti")
    new.write.mode("append").partitionBy("source").parquet(folder)
    return fetched.sparkSession.read.parquet(folder).select("key").distinct()


#: Bytes that a body has at most, and the share of it from which it's near that limit.
MOST_BYTES, NEAR = 50_000_000, 0.75
MANIFEST = "target string, stamp timestamp, outcome string, digest string, etag string, last_modified string, near_limit boolean, size long"


class SnapshotStore:
    """Fetched bodies by their content, each stored once, with a manifest of every batch of fetches.

    ``bodies`` lies in buckets by digest, so a batch probes only the buckets of its own digests; ``manifests`` in buckets by target, so it reads the validators of its own
    targets only. A batch that comes again is written anew and sees nothing of itself. A second run over what hasn't changed stores nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _bucket(self, x: Column) -> Column:
        return (F.crc32(x.cast("binary")) % self.buckets).cast("int")

    def _read(self, name: str, schema: str, batch: int, buckets: DataFrame) -> DataFrame:
        """Rows of earlier batches in some buckets, of which there are so many at most."""
        wanted = sorted(r[0] for r in buckets.distinct().collect())
        try:
            rows = self.spark.read.schema(f"{schema}, batch int, bucket int").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, batch int, bucket int")
        return rows.where((F.col("batch") < batch) & F.col("bucket").isin(wanted))

    def validators(self, targets: DataFrame, batch: int) -> DataFrame:
        """(target, etag, last_modified, digest): what the last batch before this one that got a body of a target was told; to be sent along with the next fetch."""
        rows = self._read("manifests", MANIFEST, batch, targets.select(self._bucket(F.col("target"))))
        rows = rows.where("outcome IN ('stored', 'known')").join(targets.select("target").distinct(), "target", "left_semi")
        return rows.groupBy("target").agg(F.max_by(F.struct("etag", "last_modified", "digest"), F.struct("batch", "stamp", "digest")).alias("v")).select("target", "v.*")

    def fetched(self, fetches: DataFrame, batch: int) -> DataFrame:
        """Stores a batch of fetches (target, stamp, status, etag, last_modified, body binary), and returns its manifest (``MANIFEST``).

        An outcome is not_modified (a status of 304, or the validator is the one of the last body: the ETag, or where the answer has none the Last-Modified), too_large (beyond ``MOST_BYTES``; not stored), empty (no
        body), stored, or known, if the same bytes are there already, from this source or another.
        """
        size, sha = F.coalesce(F.octet_length("body"), F.lit(0)).cast("long"), F.sha2("body", 256)
        told = self.validators(fetches, batch).select("target", F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"))
        # outcomes follow from digests; bodies travel once, to be written
        met = fetches.select("target", "stamp", "status", "etag", "last_modified", size.alias("size"), sha.alias("sha")).join(told, "target", "left")
        same = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("_etag")).otherwise(F.col("last_modified") == F.col("_modified"))
        outcome = F.when((F.col("status") == 304) | F.coalesce(same, F.lit(False)), "not_modified").when(F.col("size") > MOST_BYTES, "too_large").when(F.col("size") == 0, "empty")
        met = met.withColumn("outcome", outcome)
        keyed = met.withColumn("digest", F.when(F.col("outcome").isNull(), F.col("sha"))).withColumn("bucket", self._bucket(F.col("digest")))
        keyed = stored(keyed.drop("sha", "_etag", "_modified"), "fetches")
        digests = keyed.where("digest IS NOT NULL").select("digest", "bucket")
        there = self._read("bodies", "digest string, body binary", batch, digests.select("bucket")).select("digest").withColumn("there", F.lit(True))
        new = keyed.where("digest IS NOT NULL").join(there, "digest", "left_anti")
        per = new.groupBy("bucket", "digest", "target", "stamp").agg(F.count("*").alias("n"))
        once = per.groupBy("bucket", "digest").agg(F.min(F.struct("target", "stamp", "n")).alias("one")).select("bucket", "digest", "one.*")
        self._bodies_of(fetches.select("target", "stamp", sha.alias("digest"), "body"), stored(once, "once")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/bodies/batch={batch}")
        marked = keyed.drop("bucket").join(there, "digest", "left").withColumn("outcome", F.coalesce("outcome", F.when(F.col("there"), "known").otherwise("stored")))
        rows = marked.withColumn("near_limit", F.col("size") > NEAR * MOST_BYTES).withColumn("bucket", self._bucket(F.coalesce("target", F.lit(""))))
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        rows.select(*names, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/manifests/batch={batch}")
        return self.spark.read.schema(f"{MANIFEST}, bucket int").parquet(f"{self.folder}/manifests/batch={batch}").drop("bucket")

    def _bodies_of(self, fetches: DataFrame, once: DataFrame) -> DataFrame:
        """(bucket, digest, body): the body of the fetch that stands for each digest; of ``n`` equal fetches any."""

        def met(of: DataFrame) -> DataFrame:
            a, b = fetches.alias("a"), of.hint("shuffle_hash").alias("b")  # the smaller side is hashed, so no bodies are sorted
            same = (F.col("a.digest") == F.col("b.digest")) & F.col("a.target").eqNullSafe(F.col("b.target")) & F.col("a.stamp").eqNullSafe(F.col("b.stamp"))
            return a.join(b, same).select("b.bucket", "b.digest", "a.body")

        repeated = once.where("n > 1")
        if repeated.isEmpty():
            return met(once)
        return met(once.where("n = 1")).unionByName(met(repeated).groupBy("bucket", "digest").agg(F.any_value("body").alias("body")))

    def bodies(self) -> DataFrame:
        """(digest, body) of all batches."""
        return self.spark.read.schema("digest string, body binary, batch int, bucket int").parquet(f"{self.folder}/bodies").select("digest", "body")


def posting_key(kind: Column, domain: Column, external_id: Column, stamp: Column) -> Column:
    """Where the raw form of a posting lies as it was at a time: by kind, company and id, with the stamp in UTC."""
    return F.concat_ws("/", F.lit("raw"), safe_segment(kind), safe_segment(domain), safe_segment(external_id), F.concat(F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'"), F.lit(".json")))
