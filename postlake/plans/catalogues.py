"""Queries of change detection, duplicates, versions and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from postlake.operators import catalog as C, dedupe as D
from postlake.operators.stored import fresh_path
from postlake.plans.base import WITH_POSTINGS, Tables, query
from postlake.sources.snapshots import SnapshotStore, posting_key

# A catalogue and a later listing made of documents: rows known before, some with other content; some gone, some new.
_CATALOGUE = "SELECT doc_id AS job_id, source AS source_id, 'e' || doc_id AS external_id, md5(text) AS content_hash, doc_id % 13 = 0 AS closed FROM documents WHERE doc_id % 5 <> 0"
_LISTING = "SELECT doc_id AS job_id, source AS source_id, 'e' || doc_id AS external_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS content_hash FROM documents WHERE doc_id % 3 <> 0"
_CHANGES = f"""WITH catalogue AS ({_CATALOGUE}), listing AS ({_LISTING}), changes AS (
  SELECT coalesce(l.source_id, c.source_id) AS source_id, coalesce(l.external_id, c.external_id) AS external_id, c.closed,
    CASE WHEN c.content_hash IS NULL THEN 'new' WHEN l.content_hash IS NULL THEN 'missing' WHEN c.content_hash = l.content_hash THEN 'unchanged' ELSE 'updated' END AS change
  FROM listing l FULL JOIN catalogue c ON l.source_id = c.source_id AND l.external_id = c.external_id)
"""


def _catalogue(t: Tables) -> DataFrame:
    now = F.expr("TIMESTAMP '2024-06-01'")
    return t.documents.where("doc_id % 5 <> 0").select(
        F.col("doc_id").alias("job_id"), F.col("source").alias("source_id"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("external_id"),
        F.md5("text").alias("content_hash"), F.sha2(F.col("text"), 256).alias("fingerprint"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("canonical_url"),
        now.alias("published_at"), F.lit(1).alias("version"), now.alias("first_seen_at"), now.alias("last_seen_at"),
        F.when(F.col("doc_id") % 13 == 0, now).alias("closed_at"), F.lit(None).cast("long").alias("duplicate_of"),
        F.when(F.col("doc_id") % 13 == 0, "closed").otherwise("discovered").alias("state"),
    )


def _listing(t: Tables) -> DataFrame:
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return t.documents.where("doc_id % 3 <> 0").select(
        F.col("doc_id").alias("job_id"), F.col("source").alias("source_id"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("external_id"),
        F.md5(edited).alias("content_hash"), F.sha2(edited, 256).alias("fingerprint"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("canonical_url"),
        F.lit(None).cast("timestamp").alias("published_at"), F.col("doc_id").alias("position"),
    )


def _now():
    return F.expr("TIMESTAMP '2024-07-01'")


@query("X01_classify", f"{_CHANGES}SELECT source_id, external_id, change FROM changes")
def x01(t: Tables) -> DataFrame:
    return C.classify(_listing(t), _catalogue(t)).select(*C.KEY, "change")


_COUNTS = "(SELECT source_id, count(*) FILTER (WHERE change <> 'missing') AS seen, count(*) FILTER (WHERE change <> 'missing' OR NOT closed) AS open FROM changes GROUP BY 1)"
_CLOSING = f"SELECT c.source_id, c.external_id FROM changes c JOIN {_COUNTS} n ON n.source_id = c.source_id WHERE change = 'missing' AND NOT closed AND seen > 0 AND NOT (open >= 10 AND seen < 0.5 * open)"


@query("X06_close_missing", f"{_CHANGES}{_CLOSING}")
def x06(t: Tables) -> DataFrame:
    return C.closable(C.classify(_listing(t), _catalogue(t)))


_ORIGINAL = "SELECT l.job_id, arg_min(c.job_id, c.job_id) AS duplicate_of FROM (SELECT doc_id AS job_id, source, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS body FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0) l JOIN (SELECT doc_id AS job_id, source, text AS body FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 13 <> 0) c ON c.body = l.body AND c.source <> l.source GROUP BY 1"


@query("X02_three_layers", _ORIGINAL)
def x02(t: Tables) -> DataFrame:
    applied = C.apply_listing(_catalogue(t), _listing(t), _now())
    return applied.where("change = 'duplicate'").select("job_id", "duplicate_of")


@query("X03_insert_new", f"{_CHANGES}, dup AS ({_ORIGINAL}) SELECT source_id, external_id, TIMESTAMP '2024-07-01' AS published_at, CASE WHEN d.job_id IS NULL THEN 'discovered' ELSE 'duplicate' END AS state FROM changes LEFT JOIN dup d ON 'e' || d.job_id = external_id WHERE change = 'new'")
def x03(t: Tables) -> DataFrame:
    applied = C.apply_listing(_catalogue(t), _listing(t), _now())
    return applied.where("change IN ('new', 'duplicate')").select(*C.KEY, F.col("published_at").cast("timestamp_ntz").alias("published_at"), "state")


@query("X04_update", f"{_CHANGES}SELECT source_id, external_id, 2 AS version, TIMESTAMP '2024-06-01' AS published_at, 'discovered' AS state FROM changes WHERE change = 'updated'")
def x04(t: Tables) -> DataFrame:
    applied = C.apply_listing(_catalogue(t), _listing(t), _now())
    return applied.where("change = 'updated'").select(*C.KEY, "version", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "state")


@query("X04_reset_verdicts", "SELECT doc_id AS job_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'pending' ELSE 'eligible' END AS status, CASE WHEN doc_id % 7 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN NULL ELSE 0.5 END::DOUBLE AS score FROM labels")
def x04_reset(t: Tables) -> DataFrame:
    verdicts = t.labels.select(F.col("doc_id").alias("job_id"), F.lit("eligible").alias("status"), F.lit(0.5).alias("score"))
    return C.reset_verdicts(verdicts, C.apply_listing(_catalogue(t), _listing(t), _now()))


@query("X05_touch_seen", f"{_CHANGES}SELECT source_id, external_id, CASE WHEN closed THEN 'closed' ELSE 'discovered' END AS state, true AS is_open FROM changes WHERE change = 'unchanged'")
def x05(t: Tables) -> DataFrame:
    applied = C.apply_listing(_catalogue(t), _listing(t), _now())
    return applied.where("change = 'unchanged'").select(*C.KEY, "state", F.col("closed_at").isNull().alias("is_open"))


@query(
    "A13_counters",
    f"{_CHANGES}, dup AS ({_ORIGINAL}), closing AS ({_CLOSING}) SELECT source_id, count(*) FILTER (WHERE change = 'new' AND external_id NOT IN (SELECT 'e' || job_id FROM dup)) AS new, count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE change = 'new' AND external_id IN (SELECT 'e' || job_id FROM dup)) AS duplicates, count(*) FILTER (WHERE external_id IN (SELECT external_id FROM closing)) AS closed FROM changes GROUP BY 1",
)
def a13(t: Tables) -> DataFrame:
    return C.counters(C.apply_listing(_catalogue(t), _listing(t), _now()))


@query("J12_equal_duplicates", "SELECT a.doc_id AS job_id, min(b.doc_id) AS duplicate_of FROM documents a JOIN documents b ON b.source <> a.source AND b.text = a.text GROUP BY 1")
def j12(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("job_id"), F.col("source").alias("source_id"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("canonical_url"), F.sha2("text", 256).alias("fingerprint"), F.lit(0).alias("first_seen_at"))
    return D.equal_duplicates(rows, rows)


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_NAMES = f"names AS (SELECT id, block, grams FROM (SELECT c_custkey AS id, c_nationkey AS block, {_GRAMS.format(x='c_name')} AS grams FROM customer))"
_SIM = "len(list_intersect(a.grams, b.grams)) / len(list_distinct(list_concat(a.grams, b.grams)))::DOUBLE"


def _names(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("block"), "c_name")


@query("J13_fuzzy_duplicates", f"WITH {_NAMES} SELECT a.id AS l_id, b.id AS r_id, round({_SIM}, 4) AS similarity FROM names a JOIN names b ON a.block = b.block AND a.id <> b.id WHERE {_SIM} >= 0.85")
def j13(t: Tables) -> DataFrame:
    n = _names(t)
    return D.similar_pairs(n, n, "c_name", ["block"], 0.85).withColumn("similarity", F.round("similarity", 4))


@query(
    "J14_similar_titles",
    f"WITH {_NAMES}, pairs AS (SELECT a.id AS l_id, b.id AS r_id, {_SIM} AS similarity FROM names a JOIN names b ON a.block = b.block AND a.id <> b.id) SELECT l_id, r_id, round(similarity, 4) AS similarity FROM pairs WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY similarity DESC, r_id) <= 5",
)
def j14(t: Tables) -> DataFrame:
    n = _names(t)
    return D.top_similar(n, n, "c_name", ["block"], 0.6, 5).select("l_id", "r_id", F.round("similarity", 4).alias("similarity"))


@query("X07_upsert", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 4 = 1")
def x07(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_name", "c_acctbal")
    moved = base.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).union(base.where("c_custkey % 4 = 1").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return C.upsert(base, moved, ["c_custkey"], "c_acctbal")


@query("X08_role_upgrade", "SELECT o_custkey, arg_max(role, rank) AS role FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'owner' WHEN 'P' THEN 'admin' ELSE 'member' END AS role, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END AS rank FROM orders) GROUP BY 1")
def x08(t: Tables) -> DataFrame:
    from postlake.functions.text import lookup

    role = F.when(F.col("o_orderstatus") == "F", "owner").when(F.col("o_orderstatus") == "P", "admin").otherwise("member")
    ranked = t.orders.select("o_custkey", role.alias("role")).withColumn("rank", lookup({"member": 1, "admin": 2, "owner": 3}, F.col("role")))
    return ranked.groupBy("o_custkey").agg(F.max_by("role", "rank").alias("role"))


@query("X09_insert_absent", "SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE event_type <> 'click' AND event_id % 2 = 0")
def x09(t: Tables) -> DataFrame:
    there = t.events.where("event_type = 'click'").select("event_id")
    return C.insert_absent(there, t.events.where("event_id % 2 = 0").select("event_id").unionAll(t.events.where("event_id % 4 = 0").select("event_id")), ["event_id"])


@query("X10_notification_claims", "SELECT key, status, attempts FROM (SELECT user_id || ':' || event_type AS key, CASE WHEN count(*) FILTER (WHERE value >= 50) > 0 THEN 'sent' ELSE 'failed' END AS status, coalesce(min(n) FILTER (WHERE value >= 50), count(*)) AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) GROUP BY 1)")
def x10(t: Tables) -> DataFrame:
    from postlake.operators.states import notification_outbox

    tries = t.events.select(F.concat_ws(":", "user_id", "event_type").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("value") >= 50).alias("delivered"))
    return notification_outbox(tries)


@query("X14_view_state", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'duplicate' WHEN doc_id % 13 = 0 THEN 'closed' WHEN quality = 1 THEN 'ranked' WHEN quality = 0 THEN 'rejected' ELSE 'discovered' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def x14(t: Tables) -> DataFrame:
    catalogue = F.when(F.col("doc_id") % 11 == 0, "duplicate").when(F.col("doc_id") % 13 == 0, "closed").otherwise("discovered")
    own = F.when(F.col("quality") == 1, "ranked").when(F.col("quality") == 0, "rejected")
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").withColumn("catalogue", catalogue)
    return rows.select("doc_id", F.when(F.col("catalogue").isin("duplicate", "closed"), F.col("catalogue")).otherwise(F.coalesce(own, F.col("catalogue"))).alias("state"))


@query("X35_backfill_locator", "SELECT page_id, locator || CASE WHEN n > 1 THEN '#dup-' || n ELSE '' END AS locator FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS locator, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ORDER BY page_id) AS n FROM pages)")
def x35(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("locator"))
    n = F.row_number().over(Window.partitionBy("locator").orderBy("page_id"))
    return rows.withColumn("n", n).select("page_id", F.concat("locator", F.when(F.col("n") > 1, F.concat(F.lit("#dup-"), F.col("n").cast("string"))).otherwise("")).alias("locator"))


@query("C13_good_and_bad", "SELECT source, count(*) FILTER (WHERE n_chars >= 40) AS kept, count(*) FILTER (WHERE n_chars < 40) AS skipped FROM documents GROUP BY 1")
def c13(t: Tables) -> DataFrame:
    bad = F.col("n_chars") < 40
    return t.documents.groupBy("source").agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("skipped"))


@query("C14_listing_cap", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5000")
def c14(t: Tables) -> DataFrame:
    return C.capped(t.documents.withColumnRenamed("source", "source_id"), "doc_id").select("doc_id")


@query("C15_not_modified", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0")
def c15(t: Tables) -> DataFrame:
    now = t.documents.select("doc_id", F.md5("text").alias("etag"))
    checkpoint = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.md5("text")).otherwise("old").alias("etag"))
    return now.join(checkpoint, ["doc_id", "etag"], "left_anti").select("doc_id")


_FETCHED = """fetches AS (SELECT 0 AS batch, doc_id, coalesce(text, '') AS body FROM documents UNION ALL SELECT 1, doc_id, CASE WHEN lang = 'de' THEN coalesce(text, '') || ' edited' ELSE coalesce(text, '') END FROM documents
    UNION ALL SELECT 2, doc_id, CASE WHEN lang = 'de' THEN coalesce(text, '') || ' edited' WHEN lang = 'fr' THEN 'gone quiet' ELSE coalesce(text, '') END FROM documents),
  told AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN sha256(body) END AS etag, CASE WHEN doc_id % 3 = 1 THEN NULL ELSE CAST(length(body) AS VARCHAR) END AS modified FROM fetches)"""


@query(
    "C15_validators",
    f"""WITH {_FETCHED}, compared AS (SELECT *, body = lag(body) OVER w AS same, sha256(lag(body) OVER w) AS last_etag, CAST(length(lag(body) OVER w) AS VARCHAR) AS last_modified FROM told WINDOW w AS (PARTITION BY doc_id ORDER BY batch)),
  judged AS (SELECT *, body = '' AS nothing, CASE WHEN etag IS NOT NULL THEN etag = last_etag ELSE modified = last_modified END AS unmodified FROM compared),
  known AS (SELECT j.*, EXISTS (SELECT 1 FROM told e WHERE e.batch < j.batch AND e.body = j.body) AS there FROM judged j)
  SELECT batch, doc_id, CASE WHEN nothing THEN 'empty' WHEN coalesce(unmodified, false) THEN 'not_modified' WHEN there THEN 'known' ELSE 'stored' END AS outcome FROM known""",
)
def c15_validators(t: Tables) -> DataFrame:
    """Three rounds of fetching every document, with edits between: what is told unmodified, what is known by its bytes, what is stored."""
    store = SnapshotStore(t.spark, fresh_path(t.spark, "snapshots"))
    docs = t.documents.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("body"))
    edited = F.when(F.col("lang") == "de", F.concat("body", F.lit(" edited")))
    found = None
    for batch, body in enumerate((F.col("body"), F.coalesce(edited, F.col("body")), F.coalesce(edited, F.when(F.col("lang") == "fr", "gone quiet"), F.col("body")))):
        one = docs.select("doc_id", body.alias("body"))
        etag, modified = F.when(F.col("doc_id") % 3 > 0, F.sha2("body", 256)), F.when(F.col("doc_id") % 3 != 1, F.length("body").cast("string"))
        fetches = one.select(F.col("doc_id").cast("string").alias("target"), F.expr(f"TIMESTAMP '2024-06-0{batch + 1} 00:00:00'").alias("stamp"), F.lit(200).alias("status"), etag.alias("etag"), modified.alias("last_modified"), F.col("body").cast("binary").alias("body"))
        made = store.fetched(fetches, batch).select(F.lit(batch).alias("batch"), F.col("target").cast("long").alias("doc_id"), "outcome")
        found = made if found is None else found.unionByName(made)
    return found


@query("C16_http_status", "SELECT event_id, CASE WHEN c = 304 THEN 'not_modified' WHEN c < 300 THEN 'ok' WHEN c = 429 THEN 'rate_limited' WHEN c IN (404, 410) THEN 'gone' WHEN c >= 500 OR c IN (408, 425) THEN 'transient' ELSE 'permanent' END AS outcome FROM (SELECT event_id, [200, 304, 429, 404, 503, 403, 408][CAST(event_id % 7 AS INT) + 1] AS c FROM events)")
def c16(t: Tables) -> DataFrame:
    from postlake.sources.fetch import http_outcome

    code = F.element_at(F.array(*[F.lit(x) for x in (200, 304, 429, 404, 503, 403, 408)]), (F.col("event_id") % 7 + 1).cast("int"))
    return t.events.select("event_id", http_outcome(code).alias("outcome"))


@query("C18_snapshots", "SELECT 'staging/' || source || '/' || substring(sha256(text), 1, 32) || '/raw.json' AS key, min(doc_id) AS first_id FROM documents GROUP BY 1")
def c18(t: Tables) -> DataFrame:
    from postlake.sources.snapshots import snapshot_key

    keyed = t.documents.select(snapshot_key(F.col("source"), F.col("text")).alias("key"), "doc_id")
    return keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"))


@query("C18_posting_snapshots", f"{WITH_POSTINGS}SELECT job_id, 'raw/lever/' || company_domain || '/' || external_id || '/' || strftime(published_at, '%Y%m%dT%H%M%SZ') || '.json' AS key FROM postings")
def c18_postings(t: Tables) -> DataFrame:
    """Where the raw form of each posting lies, stamped in UTC."""
    stamp = F.col("published_at").cast("timestamp")
    return t.postings.select("job_id", posting_key(F.lit("lever"), F.col("company_domain"), F.col("external_id"), stamp).alias("key"))


@query("C20_preview", "SELECT doc_id, md5(substring(text, 1, 2000)) AS preview, length(text) > 2000 AS truncated FROM documents")
def c20(t: Tables) -> DataFrame:
    from postlake.sources.snapshots import preview

    p = preview(F.col("text"), 2000)
    return t.documents.select("doc_id", F.md5(p.text).alias("preview"), p.truncated.alias("truncated"))
