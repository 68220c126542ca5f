"""Queries of dashboards, counts, histograms and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlake.sources.export import export_parts, manifest
from postlake.plans.base import Tables, query
from postlake.plans.relations import _VIEW, overlay

#: Bucket bounds of latency histograms.
LATENCY = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def score_bucket(score: Column, buckets: int = 10) -> Column:
    """Label of a score's bucket: its lower bound in tenths; 1 counts in the last."""
    return (F.width_bucket(score, F.lit(0.0), F.lit(1.0001), F.lit(buckets)) - 1) / buckets


def status_counts(view: DataFrame) -> DataFrame:
    return view.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


@query("A01_status_counts", f"{_VIEW}SELECT coalesce(status, 'pending') AS status, count(*) AS n FROM seen GROUP BY 1")
def a01(t: Tables) -> DataFrame:
    return status_counts(t.postings.select("job_id").join(overlay(t), "job_id", "left"))


@query("A02_score_histogram", f"{_VIEW}SELECT (least(10, floor(score * 10 / 1.0001) + 1) - 1) / 10 AS bucket, count(*) AS n FROM seen WHERE score IS NOT NULL GROUP BY 1")
def a02(t: Tables) -> DataFrame:
    return overlay(t).where("score IS NOT NULL").groupBy(score_bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))


@query("A03_per_day", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY 1")
def a03(t: Tables) -> DataFrame:
    recent = t.events.where("ts >= TIMESTAMP_NTZ '2024-01-03'")
    return recent.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))


@query(
    "A04_rejection_reasons",
    "SELECT rule, count(*) AS n FROM (SELECT unnest(['length', 'language', 'source']) AS rule, unnest([n_chars < 500, lang <> 'en', source = 'src1']) AS failed FROM documents) WHERE failed GROUP BY rule ORDER BY n DESC, rule LIMIT 10",
)
def a04(t: Tables) -> DataFrame:
    rules = {"length": F.col("n_chars") < 500, "language": F.col("lang") != "en", "source": F.col("source") == "src1"}
    rows = t.documents.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.when(v, "fail").otherwise("pass").alias("outcome")) for k, v in rules.items()])).alias("r"))
    return rows.where("r.outcome = 'fail'").groupBy("r.rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(10)


@query("A05_run_counts", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def a05(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("A06_notification_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def a06(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "A07_usage",
    "SELECT count(*) AS n, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18, 2))), 0) AS DOUBLE) AS cost, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) FILTER (WHERE l_quantity > 1000), 0) AS DOUBLE) AS none FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'",
)
def a07(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0).cast("decimal(18,2)")).cast("double")
    return t.lineitem.where("l_shipdate >= TIMESTAMP_NTZ '1997-01-01'").agg(F.count("*").alias("n"), total(price).alias("cost"), total(F.when(F.col("l_quantity") > 1000, price)).alias("none"))


@query("A08_filtered_counts", "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_active FROM orders GROUP BY 1")
def a08(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "F").alias("n_active"))


@query("A09_open_per_source", "SELECT source, count(*) AS n FROM documents WHERE doc_id % 10 <> 0 AND source IN ('src0', 'src3', 'src5') GROUP BY 1")
def a09(t: Tables) -> DataFrame:
    return t.documents.where((F.col("doc_id") % 10 != 0) & F.col("source").isin("src0", "src3", "src5")).groupBy("source").agg(F.count("*").alias("n"))


@query("A10_page_total", "SELECT count(*) AS total FROM documents WHERE lang = 'fr' AND n_chars > 400")
def a10(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'fr' AND n_chars > 400").agg(F.count("*").alias("total"))


@query(
    "A11_scalar_counts",
    "SELECT (SELECT count(*) FROM customer) AS members, (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS owners, (SELECT count(*) FROM supplier) AS sources, (SELECT count(DISTINCT o_custkey) FROM orders) AS seats",
)
def a11(t: Tables) -> DataFrame:
    members = t.customer.agg(F.count("*").alias("members"), F.count_if(F.col("c_acctbal") > 9000).alias("owners"))
    return members.join(t.supplier.agg(F.count("*").alias("sources"))).join(t.orders.agg(F.count_distinct("o_custkey").alias("seats")))


@query(
    "A12_dashboard",
    f"{_VIEW}SELECT (SELECT count(*) FROM seen) AS total, (SELECT count(*) FROM seen WHERE status = 'eligible') AS eligible, (SELECT count(*) FROM seen WHERE score >= 0.5) AS matches, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS runs_failed, (SELECT array_to_string(list(job_id ORDER BY score DESC, job_id), ',') FROM (SELECT * FROM seen WHERE score IS NOT NULL ORDER BY score DESC, job_id LIMIT 5)) AS top",
)
def a12(t: Tables) -> DataFrame:
    base = t.postings.select("job_id").join(overlay(t), "job_id", "left")
    counts = base.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "eligible").alias("eligible"), F.count_if(F.col("score") >= 0.5).alias("matches"))
    runs = t.orders.agg(F.count_if(F.col("o_orderstatus") == "F").alias("runs_failed"))
    top = base.where("score IS NOT NULL").orderBy(F.desc("score"), "job_id").limit(5)
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "job_id"))), lambda x: x.job_id.cast("string"))
    return counts.join(runs).join(top.agg(F.array_join(ids, ",").alias("top")))


@query("A14_runs_total", "SELECT sum(n) AS total FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def a14(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"))


@query(
    "A15_latency_histogram",
    "SELECT event_type, " + ", ".join(f"count(*) FILTER (WHERE value / 100 <= {b}) AS le_{i}" for i, b in enumerate(LATENCY)) + ", count(*) AS n FROM events GROUP BY 1",
)
def a15(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(*[F.count_if(F.col("value") / 100 <= b).alias(f"le_{i}") for i, b in enumerate(LATENCY)], F.count("*").alias("n"))


@query("R15_daily_budget", "SELECT o_orderdate AS day, count(*) AS n, round(sum(o_totalprice), 2) AS cost, count(*) >= 8 OR sum(o_totalprice) >= 1000000 AS exhausted FROM orders GROUP BY 1")
def r15(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spent"))
    return per.select("day", "n", F.round("spent", 2).alias("cost"), ((F.col("n") >= 8) | (F.col("spent") >= 1_000_000)).alias("exhausted"))


@query(
    "C22_export",
    """SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS sources,
    (SELECT coalesce(sum(c_custkey), 0)::BIGINT FROM customer WHERE c_nationkey = n_nationkey) AS member_keys FROM nation""",
)
def c22(t: Tables) -> DataFrame:
    """What a reader finds in the parts of each nation's document: its members, their keys, and its sources."""
    parts = export_parts(t.nation, _exported(t), "n_nationkey", part_rows=20)
    rows = F.from_json(F.concat(F.lit("["), "fragment", F.lit("]")), "array<struct<c_custkey:bigint,s_suppkey:bigint>>")
    read = parts.select("n_nationkey", "name", F.explode(rows).alias("r"))
    found = read.groupBy("n_nationkey").agg(F.count("r.c_custkey").alias("members"), F.count("r.s_suppkey").alias("sources"), F.sum("r.c_custkey").alias("member_keys"))
    return t.nation.select("n_nationkey").join(found, "n_nationkey", "left").select("n_nationkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("members", "sources", "member_keys")])


def _exported(t: Tables) -> dict[str, DataFrame]:
    return {"members": t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), "sources": t.supplier.withColumnRenamed("s_nationkey", "n_nationkey")}


@query(
    "C22_manifest",
    """SELECT n_nationkey, 'members' AS name, greatest(1, ceil(count(c_custkey) / 20.0))::BIGINT AS parts, count(c_custkey) AS rows FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
  UNION ALL SELECT n_nationkey, 'sources', greatest(1, ceil(count(s_suppkey) / 20.0))::BIGINT, count(s_suppkey) FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""",
)
def c22_manifest(t: Tables) -> DataFrame:
    """How many parts of about twenty rows each nation's lists are written in."""
    parts = export_parts(t.nation, _exported(t), "n_nationkey", part_rows=20)
    return manifest(parts, "n_nationkey").where("section > 0").select("n_nationkey", "name", "parts", "rows")
