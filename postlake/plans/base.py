"""Tables of a folder, the derived view of postings, and how queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Parts that postings are made of; a document takes one of each by its number.
TITLES = [
    "Sr. AI Engineer (Remote)", "Staff Python Developer", "Junior Data Analyst", "Engineering Manager, Platform", "Backend Dev II", "Principal ML Engr", "Intern - Research",
    "Full-Stack SWE [Hybrid]", "Head of Data / Analytics", "Lead Frontend Engineer", "Mid-level Go Developer", "Support Specialist",
]
LOCATIONS = ["Remote - Worldwide", "Bengaluru, India", "London, UK", "Berlin; Germany", "USA", "New York, NY", "Europe", None, "Toronto | Canada", "LATAM", "Paris, France, Paris", "  ", "Atlantis"]
REQUIREMENTS = [
    "5+ years of Python experience required.", "3-5 years of backend experience with Kafka.", "At least 10 years of experience in sales.", "You must reside in the United States.",
    "Nice to have: 8 years of Rust experience.", "Fully remote, distributed team using Docker and Kubernetes.", "On-site in Berlin, relocation required.", "Hybrid, 3 days per week in office.",
    "Authorized to work in Canada and 2 years of Java experience.", "Experience with PostgreSQL, Redis and FastAPI.", "Work from home with LLM agents.",
]
ZONES = ["Must overlap with EST business hours.", "Working hours in CET.", "European hours preferred.", "No schedule.", "PST time zone only."]
DOMAINS = ["jobs.acme.io", "www.globex.co.uk", "initech.com", "careers.umbrella.com.au", "hooli.dev"]
KINDS = ["full_time", "contract", None]


def _pick(values: list[str | None], spark: bool) -> str:
    """SQL that takes one of ``values`` by number."""
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    at = f"CAST(doc_id % {len(values)} AS INT) + 1"
    return f"element_at(array({quoted}), {at})" if spark else f"list_extract([{quoted}], {at})"


def _postings_sql(spark: bool) -> str:
    text = "STRING" if spark else "VARCHAR"
    return f"""SELECT doc_id AS job_id, source AS source_id, CONCAT('ext-', CAST(doc_id % 997 AS {text})) AS external_id,
  {_pick(TITLES, spark)} AS title, {_pick(LOCATIONS, spark)} AS location, {_pick(DOMAINS, spark)} AS company_domain, {_pick(KINDS, spark)} AS employment_type,
  CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS remote_hint,
  {_pick(REQUIREMENTS, spark)} AS requirement, {_pick(ZONES, spark)} AS schedule, text, lang, n_chars,
  CONCAT('http://www.', {_pick(DOMAINS, spark)}, '/jobs//', CAST(doc_id AS {text}), '/?utm_source=x&b=2&a=1#top') AS url,
  CAST(TIMESTAMP '2024-06-01 00:00:00' AS TIMESTAMP{'_NTZ' if spark else ''}) + CAST(doc_id % 90 AS INT) * INTERVAL '1' DAY AS published_at
FROM {'{documents}' if spark else 'documents'}"""


#: The view of postings as a common table expression of oracle SQL.
WITH_POSTINGS = f"WITH made AS ({_postings_sql(False)}), postings AS (SELECT *, concat_ws(chr(10), requirement, schedule, text) AS description FROM made)\n"

NOW = "TIMESTAMP '2024-09-01 00:00:00'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder by name; ``postings`` is derived from ``documents``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name == "postings":
            return postings(self.documents)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def postings(documents: DataFrame) -> DataFrame:
    """Postings made of documents: title, location and requirement by number, the whole text as body."""
    made = documents.sparkSession.sql(_postings_sql(True), documents=documents)
    return made.withColumn("description", F.concat_ws("\n", "requirement", "schedule", "text"))


def query(name: str, sql: str | None = None):
    """Registers a function of :class:`Tables` as a query, with its oracle SQL if there is one."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
