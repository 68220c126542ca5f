"""Queries of text, URL and hash normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlake.functions import text as X, url as U, vocabulary as V
from postlake.plans.base import WITH_POSTINGS, Tables, query


def _case(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {key} END"


def _accents(x: str) -> str:
    return f"lower(regexp_replace(translate({x}, '{X.ACCENTED}', '{X.PLAIN}'), '\\p{{M}}', '', 'g'))"


def _strip(x: str, chars: str) -> str:
    return f"trim({x}, '{chars}')"


@query("S01_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def s01(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    "S02_canonical_json",
    """SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","missing":null,"source":"' || source || '"}' AS json FROM documents""",
)
def s02(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.canonical_json(source=F.col("source"), doc_id=F.col("doc_id"), lang=F.col("lang"), missing=F.lit(None).cast("string")).alias("json"))


@query("S03_fold", f"SELECT doc_id, md5({_accents('text')}) AS folded FROM documents")
def s03(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@query("S03_fold_exact")
def s03_exact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.fold_exact("text").alias("folded"))


_TITLE_WORDS = rf"regexp_split_to_array(trim(regexp_replace(regexp_replace(translate(regexp_replace(lower(title), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '/,|', '   '), '[^a-z0-9+#.\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
_TITLE = f"""array_to_string(list_transform(list_filter(list_transform({_TITLE_WORDS}, lambda w: trim(w, '.-')), lambda w: w NOT IN ('', 'remote', 'hybrid', 'onsite')), lambda w: {_case(V.TITLE_WORDS, 'w')}), ' ')"""
_PARTS = rf"list_transform(list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(lower(location), '\s+', ' ', 'g'), ' ,;-'), '[,;/|]'), lambda p: trim(p)), lambda p: p <> ''), lambda p: {_case(V.PLACES, 'p')})"
_LOCATION = rf"""CASE WHEN location IS NULL OR trim(regexp_replace(lower(location), '\s+', ' ', 'g'), ' ,;-') = '' THEN NULL
  WHEN trim(regexp_replace(lower(location), '\s+', ' ', 'g'), ' ,;-') = 'remote - worldwide' THEN 'worldwide'
  ELSE array_to_string(list_filter({_PARTS}, lambda p, i: list_position({_PARTS}, p) = i), ', ') END"""


@query("S04_normalize_title", f"{WITH_POSTINGS}SELECT job_id, {_TITLE} AS normalized_title FROM postings")
def s04(t: Tables) -> DataFrame:
    return t.postings.select("job_id", X.normalize_title(F.col("title")).alias("normalized_title"))


@query("S05_title_fallback", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '(remote)' ELSE p_name END AS title FROM part")
def s05(t: Tables) -> DataFrame:
    title = F.when(F.col("p_partkey") % 3 == 0, " (Remote) ").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, X.title_or_raw(title)).otherwise(title).alias("title"))


@query("S06_normalize_location", f"{WITH_POSTINGS}SELECT job_id, {_LOCATION} AS normalized_location FROM postings")
def s06(t: Tables) -> DataFrame:
    return t.postings.select("job_id", X.normalize_location(F.col("location")).alias("normalized_location"))


_JOINED = "concat_ws(' ', nullif(location, ''), title, description)"


def _rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '(?i){pattern}')"


_POLICY = f"""CASE WHEN {_rx(_JOINED, V.HYBRID)} THEN 'hybrid'
  WHEN (coalesce(remote_hint, false) OR {_rx(_JOINED, V.REMOTE)}) AND NOT {_rx(_JOINED, V.ONSITE)} THEN 'remote'
  WHEN {_rx(_JOINED, V.ONSITE)} AND NOT (coalesce(remote_hint, false) OR {_rx(_JOINED, V.REMOTE)}) THEN 'onsite'
  WHEN {_rx(_JOINED, V.ONSITE)} THEN 'hybrid' WHEN NOT remote_hint THEN 'onsite' ELSE 'unknown' END"""
_SENIORITY = "CASE " + " ".join(f"WHEN {_rx('title', p)} THEN '{level}'" for level, p in V.SENIORITY) + " ELSE 'unknown' END"


def with_policy(df: DataFrame) -> DataFrame:
    return df.withColumn("remote_policy", X.remote_policy([F.col("location"), F.col("title"), F.col("description")], F.col("remote_hint")))


@query("S07_remote_policy", f"{WITH_POSTINGS}SELECT job_id, {_POLICY} AS remote_policy FROM postings")
def s07(t: Tables) -> DataFrame:
    return with_policy(t.postings).select("job_id", "remote_policy")


@query("S08_seniority", f"{WITH_POSTINGS}SELECT job_id, {_SENIORITY} AS seniority FROM postings")
def s08(t: Tables) -> DataFrame:
    return t.postings.select("job_id", X.seniority(F.col("title")).alias("seniority"))


_DOMAIN = "CASE company_domain WHEN 'jobs.acme.io' THEN 'acme.io' WHEN 'www.globex.co.uk' THEN 'globex.co.uk' WHEN 'careers.umbrella.com.au' THEN 'umbrella.com.au' ELSE company_domain END"


@query("S09_fingerprint", f"{WITH_POSTINGS}SELECT job_id, sha256({_DOMAIN} || '|' || {_TITLE} || '|' || coalesce({_LOCATION}, '')) AS fingerprint FROM postings")
def s09(t: Tables) -> DataFrame:
    return t.postings.select("job_id", X.fingerprint(F.col("company_domain"), X.normalize_title(F.col("title")), X.normalize_location(F.col("location"))).alias("fingerprint"))


def normalise(postings: DataFrame) -> DataFrame:
    """Silver postings: normalised title, place, URL and domain, work model, seniority, content hash and fingerprint."""
    title, place = X.title_or_raw(F.col("title")), X.normalize_location(F.col("location"))
    return with_policy(postings).withColumns(
        {
            "title": F.trim("title"),
            "normalized_title": title,
            "normalized_location": place,
            "canonical_url": U.canonicalize_url(F.col("url")),
            "company_domain": U.registrable_domain(F.col("company_domain")),
            "seniority": X.seniority(F.col("title")),
            "fingerprint": X.fingerprint(F.col("company_domain"), title, place),
            "content_hash": F.sha2(
                X.canonical_json(title=F.trim("title"), location=F.col("location"), description=F.col("description"), department=F.lit(None).cast("string"), employment_type=F.col("employment_type")), 256
            ),
        }
    )


@query(
    "S10_normalize_job",
    f"{WITH_POSTINGS}SELECT job_id, {_TITLE} AS normalized_title, {_LOCATION} AS normalized_location, {_POLICY} AS remote_policy, {_SENIORITY} AS seniority, {_DOMAIN} AS company_domain, "
    f"'https://' || company_domain || '/jobs/' || job_id || '?a=1&b=2' AS canonical_url FROM postings",
)
def s10(t: Tables) -> DataFrame:
    return normalise(t.postings).select("job_id", "normalized_title", "normalized_location", "remote_policy", "seniority", "company_domain", "canonical_url")


@query(
    "S11_parse_datetime",
    "SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN floor(epoch(ts))::BIGINT WHEN 1 THEN floor(epoch(ts))::BIGINT WHEN 2 THEN floor(epoch(ts))::BIGINT END AS seconds FROM events",
)
def s11(t: Tables) -> DataFrame:
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 4 == 0, seconds.cast("string")).when(F.col("event_id") % 4 == 1, (seconds * 1000).cast("string")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return t.events.select("event_id", F.unix_seconds(X.parse_datetime(raw)).alias("seconds"))


@query("S12_dig", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none.x') AS missing FROM events")
def s12(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.dig(F.col("props"), "k").alias("k"), X.dig(F.col("props"), "none.x").alias("missing"))


@query(
    "S13_normalize_skill",
    "SELECT p_partkey, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'postgresql' WHEN 1 THEN 'kubernetes' WHEN 2 THEN 'javascript' ELSE lower(trim(p_name)) END AS skill FROM part",
)
def s13(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    return t.part.select("p_partkey", X.normalize_skill(F.when(k == 0, " PSQL ").when(k == 1, "K8s").when(k == 2, "Node.js").otherwise(F.col("p_name"))).alias("skill"))


def _skill(name: str) -> str:
    out = []
    for n, p in X._skill_patterns(False):
        if n == name:
            flags, body = ("(?i)", p[4:]) if p.startswith("(?i)") else ("", p)
            out.append(f"regexp_matches(title || chr(10) || description, '{flags}(^|[^\\w.]){body.removeprefix('(?<![' + chr(92) + 'w.])').removesuffix('(?![' + chr(92) + 'w])')}([^\\w]|$)')")
    return f"CASE WHEN {' OR '.join(out)} THEN '{name}' END"


_SKILLS = f"list_filter([{', '.join(_skill(n) for n in V.SKILLS)}], lambda s: s IS NOT NULL)"


@query("S14_extract_skills", f"{WITH_POSTINGS}SELECT job_id, array_to_string({_SKILLS}, ',') AS skills FROM postings")
def s14(t: Tables) -> DataFrame:
    return t.postings.select("job_id", F.array_join(X.extract_skills(F.concat_ws("\n", "title", "description")), ",").alias("skills"))


@query("S15_clip", "SELECT doc_id, substring(text, 1, 200) AS clipped, length(text) > 200 AS was_longer FROM documents")
def s15(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring("text", 1, 200).alias("clipped"), (F.length("text") > 200).alias("was_longer"))


@query("S16_formats", "SELECT c_custkey, regexp_matches(replace(lower(c_name), '#', '-'), '^[a-z0-9][a-z0-9-]{1,62}$') AS slug_ok, regexp_matches(c_name, '^[a-z0-9][a-z0-9-]{1,62}$') AS raw_ok FROM customer")
def s16(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.is_slug(F.replace(F.lower("c_name"), F.lit("#"), F.lit("-"))).alias("slug_ok"), X.is_slug(F.col("c_name")).alias("raw_ok"))


@query("S17_identity", "SELECT c_custkey, sha256(lower(trim(' ' || c_name || '@Mail.example '))) AS subject, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def s17(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.sha2(F.lower(F.trim(F.concat(F.lit(" "), "c_name", F.lit("@Mail.example ")))), 256).alias("subject"), X.slug(F.col("c_name")).alias("slug"))


@query("S18_csv_items", "SELECT doc_id, lang || '|' || source AS items FROM documents")
def s18(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.csv_items(F.concat(F.lit(" "), "lang", F.lit(",, "), "source", F.lit(" ,"), "lang")), "|").alias("items"))


_QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
_KEPT = f"list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: regexp_matches(p, '^[^=]*=.') AND NOT regexp_matches(lower(string_split(p, '=')[1]), '^({'|'.join(V.TRACKING)})$|^({'|'.join(V.TRACKING_PREFIXES)})')))"
_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g')"
_CANONICAL = f"""'https://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') || CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE regexp_replace({_PATH}, '/$', '') END
  || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END"""


@query("E03_canonical_url", f"SELECT page_id, {_CANONICAL} AS canonical_url FROM pages")
def e03(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.canonicalize_url(F.col("url")).alias("canonical_url"))


@query(
    "E04_tracking_params",
    f"SELECT page_id, len(list_filter(string_split({_QUERY}, '&'), lambda p: regexp_matches(lower(string_split(p, '=')[1]), '^({'|'.join(V.TRACKING)})$|^({'|'.join(V.TRACKING_PREFIXES)})'))) AS n FROM pages",
)
def e04(t: Tables) -> DataFrame:
    names = F.transform(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda p: F.substring_index(p, "=", 1))
    return t.pages.select("page_id", F.size(F.filter(names, U.is_tracking)).cast("long").alias("n"))


@query("E05_registrable_domain", "SELECT page_id, array_to_string(string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.')[-2:], '.') AS domain FROM pages")
def e05(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.registrable_domain(F.col("url")).alias("domain"))


@query("E06_embedding_text", f"{WITH_POSTINGS}SELECT job_id, md5(substring(title || chr(10) || company_domain || CASE WHEN trim(coalesce(location, '')) = '' THEN '' ELSE chr(10) || location END || chr(10) || text, 1, 16000)) AS input FROM postings")
def e06(t: Tables) -> DataFrame:
    parts = F.filter(F.array("title", "company_domain", "location", "text"), lambda x: F.trim(x) != "")
    return t.postings.select("job_id", F.md5(F.substring(F.array_join(parts, "\n"), 1, 16000)).alias("input"))


@query("E07_prompt", "SELECT doc_id, md5('Focus: skills, location' || chr(10) || '<posting>' || chr(10) || substring(replace(text, '</posting>', ''), 1, 24000) || chr(10) || '</posting>') AS prompt FROM documents")
def e07(t: Tables) -> DataFrame:
    body = F.substring(F.replace("text", F.lit("</posting>"), F.lit("")), 1, 24000)
    return t.documents.select("doc_id", F.md5(F.format_string("Focus: %s\n<posting>\n%s\n</posting>", F.array_join(F.array(F.lit("skills"), F.lit("location")), ", "), body)).alias("prompt"))


@query("E08_escape_html", """SELECT doc_id, md5('<p>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</p>') AS html, '42%' AS share FROM documents""")
def e08(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.format_string("<p>%s</p>", X.escape_html(F.col("text")))).alias("html"), F.format_string("%.0f%%", F.lit(0.42) * 100).alias("share"))


@query("E10_resolve", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/jobs/1' AS rooted, 'https://x.example/a' AS absolute FROM pages")
def e10(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.resolve(F.col("url"), F.lit("/jobs/1")).alias("rooted"), U.resolve(F.col("url"), F.lit("https://x.example/a")).alias("absolute"))


@query(
    "C11_locator",
    "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\\?([^#]*)', 1) ELSE '' END AS locator, 'acme' AS token FROM pages",
)
def c11(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.locator(F.col("url")).alias("locator"), U.locator(F.lit(" Acme ")).alias("token"))


@query("C17_host_rules", "SELECT page_id, regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '(^|\\.)example\\.com$') AS allowed, page_id % 3 <> 0 AS public FROM pages")
def c17(t: Tables) -> DataFrame:
    host = F.try_parse_url("url", F.lit("HOST"))
    address = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("100.64.0."), (F.col("page_id") % 256).cast("string"))).otherwise(host)
    return t.pages.select("page_id", U.allowed_host(host, ["example.com"]).alias("allowed"), U.is_public_host(address).alias("public"))


@query("C19_safe_segment", "SELECT page_id, substring(CASE WHEN s = '' THEN 'x' ELSE s END, 1, 120) AS segment FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') AS s FROM pages)")
def c19(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.safe_segment(F.col("url")).alias("segment"))
