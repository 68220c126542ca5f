from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postlake.functions import geo as G, text as X, url as U, vocabulary as V
from postlake.functions.facts import Walk, text_facts
from postlake.operators import rules as R


def values(spark, inputs, make, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_titles(spark):
    got = values(spark, ["Sr. AI Engineer (Remote)", "Full-Stack SWE [Hybrid]", "C++ / C# Dev, II", "Café Mgr.", "(remote)", None], X.normalize_title)
    assert got == ["senior artificial intelligence engineer", "full stack software engineer", "c++ c# developer 2", "cafe manager", "", None]
    assert values(spark, [" (Remote) "], X.title_or_raw) == ["(remote)"]


def test_locations(spark):
    got = values(spark, ["Remote - Worldwide", "Bengaluru, India", "USA", "Paris; Paris | France", " ,; ", None, "São Paulo"], X.normalize_location)
    assert got == ["worldwide", "bangalore, india", "united states", "paris, france", None, None, "sao paulo"]


def test_fold_agrees_with_the_exact_form(spark):
    texts = ["Crème BRÛLÉE", "Ångström", "œuvre ß", "Ñandú", "plain"]
    assert values(spark, texts, X.fold) == values(spark, texts, X.fold_exact)
    assert values(spark, ["ﬁne"], X.fold_exact) == ["fine"]


@pytest.mark.parametrize(
    ("text", "hint", "want"),
    [("Remote role", None, "remote"), ("On-site in Rome", None, "onsite"), ("remote, some on-site", None, "hybrid"), ("Hybrid", True, "hybrid"), ("", True, "remote"), ("", False, "onsite"), ("", None, "unknown"), ("3 days per week in office", None, "hybrid")],
)
def test_work_models(spark, text, hint, want):
    assert spark.range(1).select(X.remote_policy([F.lit(text)], F.lit(hint).cast("boolean"))).first()[0] == want


def test_seniority_takes_the_first_pattern(spark):
    assert values(spark, ["Senior Staff Engineer", "Lead Director", "Engineering Manager", "Jr. Dev", "Poet"], X.seniority) == ["staff", "director", "manager", "junior", "unknown"]


def test_dates(spark):
    got = values(spark, ["1717200000", "1717200000000", "2024-06-01T00:00:00Z", "soon", "", None], lambda c: F.unix_seconds(X.parse_datetime(c)))
    assert got == [1717200000] * 3 + [None] * 3


def test_skills(spark):
    got = values(spark, ["Python and Go, some K8s", "drag and drop laws", "go away", None], X.extract_skills)
    assert got == [["python", "kubernetes", "go"], [], [], []]
    assert "rag" in values(spark, ["drag and drop"], lambda c: X.extract_skills(c, compat=True))[0]


def test_trigrams_match_the_documented_example(spark):
    assert values(spark, ["word"], lambda c: F.round(X.trigram_similarity(X.trigrams(c), X.trigrams(F.lit("two words"))), 4)) == [0.3636]
    assert values(spark, [""], lambda c: X.trigram_similarity(X.trigrams(c), X.trigrams(c))) == [0.0]


URLS = {
    "http://www.Acme.io:80/a//b/?utm_source=x&b=2&a=1#top": "https://acme.io/a/b?a=1&b=2",
    "https://u:p@acme.io./": "https://acme.io/",
    "https://acme.io:8443/x/?blank=&gh_src=1": "https://acme.io:8443/x",
    "https://acme.io/?q=a%20b&q=~*": "https://acme.io/?q=a+b&q=~%2A",
    "ftp://acme.io": None,
    "https://": None,
    "nonsense": None,
}


def test_urls(spark):
    assert values(spark, list(URLS), U.canonicalize_url) == list(URLS.values())
    once = [x for x in URLS.values() if x]
    assert values(spark, once, U.canonicalize_url) == once


def test_domains(spark):
    assert values(spark, ["https://jobs.acme.co.uk/x", "www.acme.io", "acme", "a.b.c.d", ""], U.registrable_domain) == ["acme.co.uk", "acme.io", "acme", "c.d", ""]


def test_locators_keep_the_query(spark):
    assert values(spark, [" ACME ", "HTTPS://X.io:443/feed/?q=A#f", "http://x.io:8080"], U.locator) == ["acme", "https://x.io/feed?q=A", "http://x.io:8080"]


def test_hosts(spark):
    assert values(spark, ["10.1.2.3", "172.20.0.1", "8.8.8.8", "100.64.1.1", "acme.io", "localhost", "240.0.0.1"], U.is_public_host) == [False, False, True, False, True, False, False]


def test_countries(spark):
    texts = ["Toronto, Canada", "Austin, TX", "UK or USA", "can you?", "Cyprus and Belarus", None]
    assert values(spark, texts, G.countries_in) == [["canada"], ["united states"], ["united kingdom", "united states"], [], [], []]
    assert values(spark, ["Cyprus"], lambda c: G.countries_in(c, compat=True)) == [["united states"]]


def test_all_countries_of_the_gazetteer(spark):
    names = [c for c, _, _ in G.GAZETTEER]
    assert len(names) == 59 and values(spark, [f"Office in {c.title()}." for c in names], G.countries_in) == [[c] for c in names]
    aliases = [(c, a) for c, al, _ in G.GAZETTEER for a in al]
    assert values(spark, [f"near {a}, soon" for _, a in aliases], G.countries_in) == [[c] for c, _ in aliases]


def test_countries_by_join_agree(spark):
    df = spark.createDataFrame([(1, "Berlin, Germany"), (2, "New Delhi"), (3, "")], "id int, text string")
    got = {r["id"]: r["countries"] for r in G.countries_by_join(df, "id", "text", G.gazetteer_table(spark)).collect()}
    assert got == {1: ["germany"], 2: ["india"]}


def test_zones(spark):
    got = values(spark, ["Must work EST hours", "central office", "european hours preferred", "overlap with PST required time", None], lambda c: G.detect_zones(c))
    assert [(r.zones, r.strict) for r in got] == [(["EST"], True), ([], False), (["CET"], False), (["PST"], True), ([], False)]


US_CITIES = [
    "San Francisco", "New York", "NYC", "Seattle", "Austin", "Boston", "Chicago", "Los Angeles", "Denver", "Atlanta", "Miami", "Washington DC", "Palo Alto", "Mountain View", "Menlo Park",
    "Sunnyvale", "San Jose", "San Diego", "Portland", "Philadelphia",
]


def test_every_city_is_in_the_united_states(spark):
    assert values(spark, [f"Office in {c}" for c in US_CITIES], G.countries_in) == [["united states"]] * 20
    places = spark.createDataFrame([(c, "remote", "") for c in US_CITIES], "location string, remote_policy string, description string")
    assert {r.o for r in R.evaluate(places, R.Policy()).select(F.filter("rules", lambda r: r.rule == "location")[0].outcome.alias("o")).collect()} == {"fail"}


def test_one_walk_finds_all_kinds(spark):
    text = "Weİ need Go, K8s and Node.js; PySpark. 3+ years of Python experience required. Must reside in Canada.\nOverlap with EST hours only. Hybrid, office in Boston, MA or across EMEA. NewYorker est, central office."
    row = spark.createDataFrame([(text,), (None,)], "t string").select(text_facts(F.col("t"), "countries", "regions", "skills", "zones", "residency", "model", "years").alias("f")).collect()
    f = row[0].f.asDict()
    assert f == {"countries": ["canada", "united states"], "regions": ["emea"], "skills": ["python", "kubernetes", "javascript", "go", "spark"], "zones": ["EST"], "strict": True, "residency": ["canada", None], "remote": False, "hybrid": True, "onsite": False, "low": 3.0, "high": None}
    assert row[1].f.countries == [] and row[1].f.low is None and row[1].f.strict is False


def test_zone_clauses_equal_a_search_of_all_clauses(spark):
    import random
    import re

    rng, words = random.Random(5), ["est", "EST", "et", "central", "time zone", "hours", "overlap", "the", "must", "only", ".", "\n", "us hours", "CETs", "pt", "x" * 70]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))
        want = {V.ZONE_PHRASES[p] for p in V.ZONE_PHRASES if p in text.lower()}
        for clause in re.split(r"[.\n]", text):
            want |= {V.ZONES[n.lower()] for a, n, b in re.findall(V.ZONE_IN_CONTEXT, clause, re.I) if re.search(V.TIME_WORDS, f"{a} {b}", re.I)}
        assert Walk(("zones",), []).facts(text)["zones"] == sorted(want), text


def test_a_small_gazetteer_is_broadcast(spark):
    texts = spark.range(50).selectExpr("id", "'From Peru to New Zealand' AS text")
    found = G.countries_by_join(texts, "id", "text", G.gazetteer_table(spark))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().sparkPlan().toString()
    assert [r["countries"] for r in found.collect()] == [["new zealand", "peru"]] * 50
