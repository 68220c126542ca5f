"""JSON job boards as postings: Greenhouse-, Lever- and Ashby-style listings, and any JSON by a map of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlake.sources.demo import visible
from postlake.sources.markup import html_listing
from postlake.functions.text import dig, parse_datetime

#: Columns of a posting as a source gives it.
RAW = (
    "external_id string, title string, url string, location string, department string, employment_type string, description_html string, description_text string, "
    "published_at timestamp, remote_hint boolean"
)


def _postings(rows: DataFrame, **columns: Column) -> DataFrame:
    """All of RAW, null where a source has nothing."""
    out = []
    for x in RAW.split(", "):
        name, kind = x.split()
        out.append(columns.get(name, F.lit(None)).cast(kind).alias(name))
    return rows.select(*out, *[c for c in rows.columns if c in ("source_id", "position")])


def split_valid(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings that keep the contract (id of 1 to 255 characters, title of 1 to 500, http(s) URL to 2048), and those skipped."""
    ok = F.length("external_id").between(1, 255) & F.length(F.trim("title")).between(1, 500) & F.col("url").rlike("^https?://") & (F.length("url") <= 2048)
    ok = F.coalesce(ok, F.lit(False))
    return postings.where(ok), postings.where(~ok)


def _items(listing: DataFrame, root: str | None, schema: str) -> DataFrame:
    """The items of listings (source_id, body), an error where the root list is missing."""
    items = F.from_json(F.col("body") if root is None else F.get_json_object("body", f"$.{root}"), f"array<{schema}>")
    return listing.select("source_id", F.posexplode(_checked(items)).alias("position", "item"))


def _checked(items: Column) -> Column:
    return F.when(items.isNull(), F.raise_error(F.concat(F.lit("no list of postings in the listing of "), "source_id"))).otherwise(items)


def greenhouse(listing: DataFrame) -> DataFrame:
    schema = "struct<id:bigint,title:string,updated_at:string,first_published:string,location:struct<name:string>,absolute_url:string,departments:array<struct<id:int,name:string>>,content:string>"
    rows = _items(listing, "jobs", schema)
    i = F.col("item")
    return _postings(
        rows,
        external_id=i.id.cast("string"),
        title=i.title,
        url=i.absolute_url,
        location=i.location["name"],
        department=F.try_element_at(i.departments, F.lit(1))["name"],
        description_html=i.content,
        published_at=parse_datetime(F.coalesce(i.first_published, i.updated_at)),
    )


def lever(listing: DataFrame) -> DataFrame:
    schema = (
        "struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:bigint,workplaceType:string,categories:struct<commitment:string,department:string,location:string,team:string,allLocations:array<string>>,"
        "description:string,descriptionPlain:string,lists:array<struct<text:string,content:string>>,additional:string>"
    )
    rows = _items(listing, None, schema)
    i = F.col("item")
    lists = F.array_join(F.transform(F.coalesce(i.lists, F.expr("array()").cast("array<struct<text:string,content:string>>")), lambda x: F.concat(F.lit("<h3>"), F.coalesce(x.text, F.lit("")), F.lit("</h3><ul>"), F.coalesce(x.content, F.lit("")), F.lit("</ul>"))), "")
    place = i.workplaceType
    return _postings(
        rows,
        external_id=i.id,
        title=i.text,
        url=F.coalesce(i.hostedUrl, i.applyUrl),
        location=F.coalesce(i.categories.location, F.nullif(F.array_join(i.categories.allLocations, ", "), F.lit(""))),
        department=F.coalesce(i.categories.team, i.categories.department),
        employment_type=i.categories.commitment,
        description_html=F.concat(F.coalesce(i.description, F.lit("")), lists, F.coalesce(i.additional, F.lit(""))),
        published_at=F.timestamp_millis(i.createdAt),
        remote_hint=F.when(place == "remote", True).when(place.isin("onsite", "on-site"), False),
    )


def ashby(listing: DataFrame) -> DataFrame:
    schema = (
        "struct<id:string,title:string,department:string,team:string,employmentType:string,location:string,secondaryLocations:array<struct<location:string>>,isRemote:boolean,workplaceType:string,"
        "isListed:boolean,publishedAt:string,jobUrl:string,applyUrl:string,descriptionHtml:string,descriptionPlain:string>"
    )
    rows = _items(listing, "jobs", schema).where(F.coalesce(F.col("item.isListed"), F.lit(True)))
    i = F.col("item")
    places = F.concat(F.array(i.location), F.transform(F.coalesce(i.secondaryLocations, F.expr("array()").cast("array<struct<location:string>>")), lambda x: x.location))
    return _postings(
        rows,
        external_id=i.id,
        title=i.title,
        url=F.coalesce(i.jobUrl, i.applyUrl),
        location=F.nullif(F.array_join(F.array_compact(places), ", "), F.lit("")),
        department=F.coalesce(i.department, i.team),
        employment_type=i.employmentType,
        description_html=i.descriptionHtml,
        description_text=i.descriptionPlain,
        published_at=parse_datetime(i.publishedAt),
        remote_hint=F.when(F.lower(i.workplaceType) == "hybrid", None).otherwise(i.isRemote),
    )


def generic(listing: DataFrame, field_map: dict[str, str], base: str) -> DataFrame:
    """Postings of any JSON: ``field_map`` names the path of ``items`` and, within an item, of each column."""
    from postlake.functions.url import resolve

    missing = {"items", "external_id", "title", "url"} - field_map.keys()
    if missing:
        raise ValueError(f"field map lacks {sorted(missing)}")
    body = F.col("body") if field_map["items"] == "" else dig(F.col("body"), field_map["items"])
    items = F.from_json(body, "array<string>")
    checked = F.when(items.isNull(), F.raise_error(F.lit("no list of postings at the path of items"))).otherwise(items)
    rows = listing.select("source_id", F.posexplode(checked).alias("position", "item"))
    columns = {k: dig(F.col("item"), v) for k, v in field_map.items() if k != "items"}
    columns["url"] = resolve(F.lit(base), columns["url"])
    if "published_at" in columns:
        columns["published_at"] = parse_datetime(columns["published_at"])
    return _postings(rows, **columns)


def read_listings(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """(source_id, body): whole files of JSON."""
    return spark.read.text(path, wholetext=True).select(F.lit(source_id).alias("source_id"), F.col("value").alias("body"))


_ENTRY = "guid string, id string, title string, link string, description string, content string, summary string, pubDate string, published string, updated string"


def _entries(rows: DataFrame) -> DataFrame:
    """Postings of feed entries; the id is the entry's id, guid or link."""
    stamp = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), parse_datetime(F.coalesce("published", "updated")))
    return _postings(
        rows,
        external_id=F.substring(F.coalesce("id", "guid", "link"), 1, 255),
        title=F.col("title"),
        url=F.col("link"),
        description_html=F.coalesce("content", "summary", "description"),
        published_at=stamp,
    )


def read_feed(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Postings of RSS or Atom files of any size, by Spark's XML reader."""
    rows = None
    for tag in ("item", "entry"):
        one = spark.read.format("xml").option("rowTag", tag).schema(_ENTRY).load(path)
        rows = one if rows is None else rows.unionByName(one)
    return _entries(rows.withColumn("source_id", F.lit(source_id)).withColumn("position", F.lit(None).cast("int")))


def feed(listing: DataFrame) -> DataFrame:
    """Postings of fetched RSS feeds (source_id, body)."""
    channel = F.from_xml("body", f"channel struct<item array<struct<{_ENTRY.replace(' string', ':string')}>>>".replace("struct<item ", "struct<item:"))
    items = channel.channel["item"]
    checked = F.when(items.isNull(), F.raise_error(F.concat(F.lit("no list of postings in the listing of "), "source_id"))).otherwise(items)
    return _entries(listing.select("source_id", F.posexplode(checked).alias("position", "entry")).select("source_id", "position", "entry.*"))


#: Kinds of boards and what reads their listings; kinds that need a token, and those that need a URL.
KINDS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "rss": feed, "generic_json": generic, "static_html": html_listing, "demo": visible}
NEEDS_TOKEN, NEEDS_URL = ("greenhouse", "lever", "ashby"), ("rss", "generic_json", "static_html", "dynamic_html")


def split_definitions(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions (kind, token, url) that have what their kind needs, and the others."""
    ok = (F.col("kind").isin(*NEEDS_TOKEN) & F.col("token").isNotNull()) | (F.col("kind").isin(*NEEDS_URL) & F.col("url").isNotNull()) | (F.col("kind") == "demo")
    ok = F.coalesce(ok, F.lit(False))
    return sources.where(ok), sources.where(~ok)


def postings_of(kind: str, *listing, **options) -> DataFrame:
    """What a kind of board lists: from its listings, and what its reader needs besides (field maps, selectors, or a session and a number of polls)."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of board: {kind}")
    return KINDS[kind](*listing, **options)


#: Whether a fetched body holds a list of postings, by kind, for boards whose listings are fetched as text.
READABLE = {
    "greenhouse": lambda body: F.from_json(F.get_json_object(body, "$.jobs"), "array<string>").isNotNull(),
    "lever": lambda body: F.from_json(body, "array<string>").isNotNull(),
    "ashby": lambda body: F.from_json(F.get_json_object(body, "$.jobs"), "array<string>").isNotNull(),
    "rss": lambda body: F.from_xml(F.when(body.rlike("(?s)^\\s*<"), body), "channel struct<item:array<struct<title:string>>>", {"mode": "PERMISSIVE"}).channel["item"].isNotNull(),
    "generic_json": lambda body: F.from_json(dig(body, "data.items"), "array<string>").isNotNull(),
}
#: Where postings of boards of any JSON stand, unless a definition says otherwise.
GENERIC_MAP = {"items": "data.items", "external_id": "uid", "title": "title", "url": "url"}


def read_boards(listings: DataFrame, field_map: dict[str, str] | None = None, base: str = "https://localhost/") -> tuple[DataFrame, DataFrame]:
    """(postings, failures) of boards of all kinds at once.

    ``listings`` is (source_id, kind, body). Each row is read by what its kind says, in one pass per kind over its own rows. A board that can't be read, as its
    kind is unknown, its body missing or no list of postings, is a failure (source_id, kind, reason) and takes no other board along; a posting that breaks the
    contract is one as well (reason "posting"). Postings have ``RAW``, source_id and kind.
    """
    field_map = GENERIC_MAP if field_map is None else field_map
    body = F.col("body")
    readable = F.lit(False)
    for kind, test in READABLE.items():
        readable = readable | ((F.col("kind") == kind) & F.coalesce(test(body), F.lit(False)))
    reason = F.when(~F.coalesce(F.col("kind").isin(*READABLE), F.lit(False)), "kind").when(body.isNull(), "missing").when(~readable, "unreadable")
    checked = listings.select("source_id", "kind", "body", reason.alias("reason"))
    postings, failures = None, checked.where("reason IS NOT NULL").select("source_id", "kind", "reason")
    for kind in READABLE:
        own = checked.where((F.col("kind") == kind) & F.col("reason").isNull()).select("source_id", "body")
        found = generic(own, field_map, base) if kind == "generic_json" else KINDS[kind](own)
        good, bad = split_valid(found.withColumn("kind", F.lit(kind)))
        failures = failures.unionByName(bad.select("source_id", "kind", F.lit("posting").alias("reason")))
        good = good.drop("position")
        postings = good if postings is None else postings.unionByName(good)
    return postings, failures
