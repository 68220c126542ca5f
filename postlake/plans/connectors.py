"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlake.sources import boards as B, demo, markup as M, notify
from postlake.sources.policy import read_policies
from postlake.plans.base import Tables, query


def _per_listing(t: Tables):
    return t.documents.groupBy(F.col("source").alias("source_id"), F.floor(F.col("doc_id") / 500).alias("part"))


def _listing(t: Tables, *items) -> DataFrame:
    """Listings of up to 500 postings of a source each, made of documents."""
    return _per_listing(t).agg(F.to_json(F.struct(F.collect_list(F.struct(*items)).alias("jobs"))).alias("body")).drop("part")


_BOARD = "CASE CAST(length(source) + ascii(right(source, 1)) AS INT) % 7 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'rss' WHEN 4 THEN 'generic_json' WHEN 5 THEN 'fax' ELSE 'lever' END"
_BROKEN = "CAST(length(source) + ascii(right(source, 1)) AS INT) % 7 = 6"


def _boards(t: Tables) -> DataFrame:
    """(source_id, kind, body): boards of all kinds with the documents as postings, in parts of up to 500; some are broken."""
    id_, title, url = F.col("doc_id").cast("string"), F.concat(F.lit("Job "), F.coalesce("lang", F.lit("?"))), F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))
    docs = t.documents.where("source IS NOT NULL").select("doc_id", F.col("source").alias("source_id"), F.expr(_BOARD).alias("kind"), F.expr(_BROKEN).alias("broken"), id_.alias("id"), title.alias("title"), url.alias("url"))
    per = docs.groupBy("source_id", "kind", "broken", F.floor(F.col("doc_id") / 500).alias("part"))
    jobs = lambda *fields: F.collect_list(F.struct(*fields))
    entry = F.concat(F.lit("<item><title>"), "title", F.lit("</title><guid>"), "id", F.lit("</guid><link>"), "url", F.lit("</link></item>"))
    bodies = {
        "greenhouse": F.to_json(F.struct(jobs(F.col("doc_id").alias("id"), "title", F.col("url").alias("absolute_url")).alias("jobs"))),
        "lever": F.to_json(jobs("id", F.col("title").alias("text"), F.col("url").alias("hostedUrl"))),
        "ashby": F.to_json(F.struct(jobs("id", "title", F.col("url").alias("jobUrl")).alias("jobs"))),
        "rss": F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(entry), ""), F.lit("</channel></rss>")),
        "generic_json": F.to_json(F.struct(F.struct(jobs(F.col("id").alias("uid"), "title", "url").alias("items")).alias("data"))),
    }
    made = F.lit(None).cast("string")
    for kind, body in bodies.items():
        made = F.when(F.col("kind") == kind, body).otherwise(made)
    return per.agg(made.alias("body")).select("source_id", "kind", F.when(F.col("broken"), F.concat(F.lit("<html>"), "body")).otherwise(F.col("body")).alias("body"))


@query("C01_source", f"SELECT source AS source_id, {_BOARD} AS kind, CAST(doc_id AS VARCHAR) AS external_id, 'Job ' || coalesce(lang, '?') AS title, 'https://x.example/' || doc_id AS url FROM documents WHERE source IS NOT NULL AND {_BOARD} <> 'fax' AND NOT {_BROKEN}")
def c01(t: Tables) -> DataFrame:
    """The postings of boards of all kinds, each in the shape that every source gives."""
    return B.read_boards(_boards(t))[0].select("source_id", "kind", "external_id", "title", "url")


@query("C02_greenhouse", "SELECT CAST(doc_id AS VARCHAR) AS external_id, source AS source_id, 'Job ' || doc_id AS title, 'https://x.example/' || doc_id AS url, lang AS location, CASE WHEN doc_id % 2 = 0 THEN 'R&D' END AS department, epoch(TIMESTAMP '2024-06-01')::BIGINT AS published FROM documents WHERE doc_id % 9 <> 0")
def c02(t: Tables) -> DataFrame:
    id_ = F.col("doc_id")
    listing = _listing(
        t, id_.alias("id"), F.when(id_ % 9 == 0, "").otherwise(F.concat(F.lit("Job "), id_.cast("string"))).alias("title"), F.lit("2024-06-01T00:00:00Z").alias("updated_at"),
        F.struct(F.col("lang").alias("name")).alias("location"), F.concat(F.lit("https://x.example/"), id_.cast("string")).alias("absolute_url"),
        F.when(id_ % 2 == 0, F.array(F.struct(F.lit(1).alias("id"), F.lit("R&D").alias("name")))).alias("departments"), F.lit("&lt;p&gt;Hello&lt;/p&gt;").alias("content"),
    )
    good, _ = B.split_valid(B.greenhouse(listing))
    return good.select("external_id", "source_id", "title", "url", "location", "department", F.unix_seconds("published_at").alias("published"))


@query("C03_lever", "SELECT 'L' || doc_id AS external_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Berlin, Paris' END AS location, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN true WHEN 1 THEN false END AS remote_hint, '<p>d</p><h3>Needs</h3><ul><li>x</li></ul>end' AS description_html, 1717200000::BIGINT AS published FROM documents")
def c03(t: Tables) -> DataFrame:
    id_ = F.col("doc_id")
    place = F.when(id_ % 3 == 0, "remote").when(id_ % 3 == 1, "onsite").otherwise("hybrid")
    item = F.struct(
        F.concat(F.lit("L"), id_.cast("string")).alias("id"), F.lit("Job").alias("text"), F.lit("https://x.example/l").alias("hostedUrl"), F.lit(1717200000000).alias("createdAt"), place.alias("workplaceType"),
        F.struct(F.when(id_ % 2 == 0, F.col("lang")).alias("location"), F.array(F.lit("Berlin"), F.lit("Paris")).alias("allLocations"), F.lit("Core").alias("team")).alias("categories"),
        F.lit("<p>d</p>").alias("description"), F.array(F.struct(F.lit("Needs").alias("text"), F.lit("<li>x</li>").alias("content"))).alias("lists"), F.lit("end").alias("additional"),
    )
    listing = _per_listing(t).agg(F.to_json(F.collect_list(item)).alias("body"))
    return B.lever(listing).select("external_id", "location", "remote_hint", "description_html", F.unix_seconds("published_at").alias("published"))


@query("C04_ashby", "SELECT 'A' || doc_id AS external_id, lang || ', Remote' AS location, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END AS remote_hint FROM documents WHERE doc_id % 5 <> 0")
def c04(t: Tables) -> DataFrame:
    id_ = F.col("doc_id")
    listing = _listing(
        t, F.concat(F.lit("A"), id_.cast("string")).alias("id"), F.lit("Job").alias("title"), F.col("lang").alias("location"), F.array(F.struct(F.lit("Remote").alias("location"))).alias("secondaryLocations"),
        (id_ % 2 == 0).alias("isRemote"), F.when(id_ % 3 == 0, "Hybrid").otherwise("Remote").alias("workplaceType"), (id_ % 5 != 0).alias("isListed"), F.lit("https://x.example/a").alias("jobUrl"),
    )
    return B.ashby(listing).select("external_id", "location", "remote_hint")


@query("C05_feed", "SELECT source AS source_id, 'g' || doc_id AS external_id, 'Job ' || lang AS title, 'https://f.example/' || doc_id AS url, 1717200000::BIGINT AS published FROM documents")
def c05(t: Tables) -> DataFrame:
    id_ = F.col("doc_id").cast("string")
    item = F.concat(F.lit("<item><title>Job "), "lang", F.lit("</title><guid>g"), id_, F.lit("</guid><link>https://f.example/"), id_, F.lit("</link><pubDate>Sat, 01 Jun 2024 00:00:00 +0000</pubDate></item>"))
    listing = _per_listing(t).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    return B.feed(listing).select("source_id", "external_id", "title", "url", F.unix_seconds("published_at").alias("published"))


@query("C06_generic_json", "SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS external_id, 'Job ' || lang AS title, 'https://b.example/jobs/' || doc_id AS url FROM documents")
def c06(t: Tables) -> DataFrame:
    id_ = F.col("doc_id").cast("string")
    item = F.struct(id_.alias("uid"), F.struct(F.concat(F.lit("Job "), "lang").alias("name")).alias("info"), F.concat(F.lit("/jobs/"), id_).alias("link"))
    listing = _per_listing(t).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("items")).alias("data"))).alias("body"))
    found = B.generic(listing, {"items": "data.items", "external_id": "uid", "title": "info.name", "url": "link"}, "https://b.example/board?x=1")
    return found.select("source_id", "external_id", "title", "url")


@query(
    "C07_html_listing",
    """WITH items AS (SELECT url AS page_url, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS found FROM pages),
    item AS (SELECT page_url, unnest(range(len(found)))::INT AS position, unnest(found) AS body FROM items),
    parts AS (SELECT page_url, position, regexp_extract(body, '<a href="([^"]*)">', 1) AS href, regexp_extract(body, '<a [^>]*>(.*?)</a>', 1) AS title FROM item),
    made AS (SELECT *, regexp_extract(page_url, '^https?://[^/]+') || href AS link FROM parts)
  SELECT page_url, position, sha256('https://' || regexp_replace(regexp_extract(link, '^https?://(.*)$', 1), '^www[.]', ''))[:32] AS external_id, title, link AS url, NULL::VARCHAR AS location, NULL::VARCHAR AS department FROM made""",
)
def c07(t: Tables) -> DataFrame:
    return M.html_listing(t.pages, "li", {"title": "a"})


@query(
    "C07_selectors",
    """WITH items AS (SELECT url AS page_url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li>(.*?)</li>', 1) AS found, nullif(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS heading FROM pages),
    item AS (SELECT page_url, unnest(range(len(found)))::INT AS position, unnest(found) AS body FROM items),
    parts AS (SELECT page_url, position, regexp_extract(body, '<a href="([^"]*)">', 1) AS href, regexp_extract(body, '<a [^>]*>(.*?)</a>', 1) AS title FROM item)
  SELECT page_url, position, CASE WHEN starts_with(href, '/the') THEN title END AS title, regexp_extract(page_url, '^https?://[^/]+') || href AS url, title AS department FROM parts""",
)
def c07_selectors(t: Tables) -> DataFrame:
    """Items, links, titles and departments by children, descendants, attributes and classes."""
    fields = {"title": 'nav > ul a[href^="/the"], li.none a', "link": "li > a[href]", "department": "html body li a"}
    return M.html_listing(t.pages, "body > nav > ul > li, div.ad.wide li", fields).select("page_url", "position", "title", "url", "department")


@query(
    "C09_demo_board",
    """WITH b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY source) AS size FROM documents WHERE source IS NOT NULL),
  e AS (SELECT *, 6 + 3 * (10 + length(source)) AS final FROM b), r AS (SELECT *, unnest(range(0, 100)) AS round FROM e)
  SELECT source AS source_id, doc_id, round::BIGINT AS round, ((final - 1 - n - round * size) * 7)::BIGINT AS minutes_ago FROM r WHERE n + round * size < final AND n + round * size >= final - 30""",
)
def c09(t: Tables) -> DataFrame:
    """What the sources show if each releases its documents little by little, after as many polls as their names are long, and eleven."""
    board = t.documents.where("source IS NOT NULL").select(F.col("source").alias("source_id"), "doc_id", (F.length("source") + 11).alias("polls"))
    return demo.released(board, F.col("polls"), order="doc_id").select("source_id", "doc_id", F.col("round").cast("long").alias("round"), F.col("minutes_ago").cast("long").alias("minutes_ago"))


@query(
    "C10_kinds",
    f"""WITH b AS (SELECT DISTINCT source, doc_id // 500 AS part, {_BOARD} AS kind, {_BROKEN} AS broken FROM documents WHERE source IS NOT NULL)
  SELECT source AS source_id, kind, CASE WHEN kind = 'fax' THEN 'kind' ELSE 'unreadable' END AS reason, count(*) AS n FROM b WHERE kind = 'fax' OR broken GROUP BY ALL""",
)
def c10(t: Tables) -> DataFrame:
    """Boards of a kind that nothing reads, and of broken listings; they take no other board along."""
    return B.read_boards(_boards(t))[1].groupBy("source_id", "kind", "reason").agg(F.count("*").alias("n"))


_POLICY_TEXT = """CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN '{"experience_min": ' || (c_custkey % 9) || '}' WHEN 1 THEN '{"allowed_locations": ["' || n_name || '"], "allowed_work_models": ["remote", "hybrid"]}' WHEN 2 THEN '{"experienc_min": 1}'
  WHEN 3 THEN '[1]' WHEN 4 THEN '{"experience_max": "much"}' ELSE '{"experience_min": 1.5, "experience_max": 9, "excluded_regions": []}' END"""


@query(
    "C21_policy",
    f"""SELECT c_custkey, problem, CASE WHEN problem IS NULL THEN CASE k WHEN 1 THEN n_name ELSE 'India,Worldwide' END END AS locations, CASE WHEN problem IS NULL THEN CASE k WHEN 1 THEN 'remote,hybrid' ELSE 'remote' END END AS models,
    (CASE WHEN problem IS NULL THEN CASE k WHEN 0 THEN c_custkey % 9 WHEN 5 THEN 1.5 ELSE 3 END END)::DOUBLE AS experience_min, (CASE WHEN problem IS NULL THEN CASE k WHEN 5 THEN 9 ELSE 6 END END)::DOUBLE AS experience_max,
    (CASE WHEN problem IS NULL THEN CASE k WHEN 5 THEN 0 ELSE 2 END END)::INT AS excluded
  FROM (SELECT c_custkey, n_name, CAST(c_custkey % 6 AS INT) AS k, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN CASE WHEN c_custkey % 9 > 6 THEN 'range' END WHEN 2 THEN 'unknown' WHEN 3 THEN 'unreadable' WHEN 4 THEN 'unreadable' END AS problem FROM customer JOIN nation ON n_nationkey = c_nationkey)""",
)
def c21(t: Tables) -> DataFrame:
    """A policy per customer from JSON: defaults for what isn't named, and what's wrong with those that can't count."""
    named = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.expr(_POLICY_TEXT).alias("policy"))
    found = read_policies(named)
    size = F.when(F.col("excluded_regions").isNotNull(), F.size("excluded_regions"))
    return found.select("c_custkey", "problem", F.array_join("allowed_locations", ",").alias("locations"), F.array_join("allowed_work_models", ",").alias("models"), "experience_min", "experience_max", size.alias("excluded"))


@query("C12_definitions", "SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 4 <> 1")
def c12(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    sources = t.customer.select("c_custkey", F.when(k < 2, "lever").when(k == 2, "rss").otherwise("rss").alias("kind"), F.when(k == 0, "acme").alias("token"), F.when(k == 2, "https://x.example/feed").alias("url"))
    return B.split_definitions(sources)[0].select("c_custkey")


def _hmac(key: str, message: str) -> str:
    """Oracle SQL of the hex HMAC-SHA256 of a text."""
    inner, outer = ("unhex('" + bytes(b ^ pad for b in key.encode().ljust(64, b"\0")).hex() + "')" for pad in (0x36, 0x5C))
    return f"sha256({outer} || unhex(sha256({inner} || encode({message}))))"


_BODY = """'{"job_id":' || doc_id || ',"score":0.5,"title":' || coalesce('"' || lang || '"', 'null') || '}'"""


@query("C23_webhooks", f"""SELECT doc_id AS job_id, {_BODY} AS body, {_hmac("secret", f"'1717200000.' || {_BODY}")} AS signature FROM documents""")
def c23(t: Tables) -> DataFrame:
    jobs = t.documents.select(F.col("doc_id").alias("job_id"), F.col("lang").alias("title"), F.lit(0.5).alias("score"))
    return notify.webhook(jobs, "secret", F.lit(1717200000))


def _chained(x: str, *rules: tuple[str, str]) -> str:
    """Oracle SQL of replacements one after another."""
    for pattern, new in rules:
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return x


_HIDDEN = [("(?s)<!--.*?-->", "''"), ("(?i)<![^>]*>", "''"), *[(f"(?is)<{t}[^>]*>.*?</{t}>", "''") for t in ("script", "style", "noscript", "template")]]
_MARKS = [("&quot;", "chr(34)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;?", "'&'")]
_ALLOWED = "(a|b|blockquote|br|code|div|em|h[1-6]|hr|i|li|ol|p|pre|span|strong|table|tbody|td|th|thead|tr|u|ul)"
_LINK = """chr(1) || 'a href="\\1" rel="noopener noreferrer nofollow"' || chr(2)"""
_CLEAN = _chained(
    "html", *_HIDDEN, ('<a href="((?:https?://|mailto:)[^"]*)">', _LINK), (f"<{_ALLOWED}(?:\\s[^>]*)?>", "chr(1) || '\\1' || chr(2)"), (f"</{_ALLOWED}>", "chr(1) || '/\\1' || chr(2)"),
    ("</?[A-Za-z][^>]*>", "''"), *_MARKS, ("&", "'&amp;'"), ("<", "'&lt;'"), (">", "'&gt;'"), (chr(1), "'<'"), (chr(2), "'>'"),
)
_PLAIN = _chained("html", *_HIDDEN, (r"</?(p|div|li|br|h[1-6]|tr|ul|ol)(\s[^>]*)?>", "chr(10)"), ("</?[A-Za-z][^>]*>", "''"), *_MARKS, (r"[ \t\r\f\v]+", "' '"), (r" ?\n ?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"))


@query("E01_sanitize_html", f"SELECT page_id, {_CLEAN} AS html FROM pages")
def e01(t: Tables) -> DataFrame:
    return t.pages.select("page_id", M.sanitize_html("html").alias("html"))


@query("E02_html_to_text", f"SELECT page_id, trim({_PLAIN}, chr(10) || chr(32)) AS text FROM pages")
def e02(t: Tables) -> DataFrame:
    return t.pages.select("page_id", M.html_to_text("html").alias("text"))


@query("E09_signature", f"""SELECT doc_id, {_hmac("secret", "concat_ws('.', '1717200000', text)")} AS signature FROM documents""")
def e09(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", notify.signature("secret", F.lit(1717200000), F.col("text")).alias("signature"))


@query("C23_email", "SELECT doc_id, '<h2>' || lang || ' &amp; more</h2><p>50%</p><ul><li>a &lt; b</li></ul>' AS html FROM documents")
def c23_email(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", notify.email(F.concat("lang", F.lit(" & more")), F.lit(0.5), F.array(F.lit("a < b"))).alias("html"))
