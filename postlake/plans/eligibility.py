"""Queries of the gazetteer, eligibility rules and scores."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, functions as F

from postlake.functions import geo as G, text as X, vocabulary as V
from postlake.functions.facts import text_facts
from postlake.operators import results as L, rules as R, score as K
from postlake.operators.nearest import nearest
from postlake.operators.stored import stored
from postlake.plans.base import NOW, WITH_POSTINGS, Tables, query
from postlake.plans.normalisation import _POLICY, _SENIORITY, _SKILLS, _TITLE, with_policy

POLICY = R.Policy()
HAVE = ["python", "docker", "kubernetes", "postgresql", "fastapi", "llm", "redis"]
ROLES = ["AI Engineer", "Backend Developer"]
_ALIASES = {a: c for c, aliases, _ in reversed(G.GAZETTEER) for a in (c, *aliases)}


#: Cities of the oracles, on their own.
_CITIES = "san francisco|new york|nyc|seattle|austin|boston|chicago|los angeles|denver|atlanta|miami|washington dc|palo alto|mountain view|menlo park|sunnyvale|san jose|san diego|portland|philadelphia"


def _named(x: str) -> str:
    """Oracle SQL of the sorted countries that a text names."""
    tests = []
    for c, aliases, _ in G.GAZETTEER:
        words = "|".join(a.replace(".", r"\.") for a in sorted({c, *aliases}, key=lambda a: (-len(a), a)))
        own = [f"regexp_matches({x}, '(?i)(^|[^a-z])({words})([^a-z]|$)')"]
        own += [f"regexp_matches({x}, '(^|[^A-Za-z]){code}([^A-Za-z]|$)')" for code, of in G.CODES.items() if of == c]
        if c == G.STATES[0]:
            own.append(f"regexp_matches({x}, ',\\s*({'|'.join(G.STATES[1])})\\b')")
            own.append(f"regexp_matches(lower({x}), '{_CITIES}')")
        tests.append(f"CASE WHEN {' OR '.join(own)} THEN '{c}' END")
    return f"list_sort(list_filter([{', '.join(tests)}], lambda c: c IS NOT NULL))"


def _regions(x: str) -> str:
    by: dict[str, list[str]] = {}
    for a, r in V.REGIONS.items():
        by.setdefault(r, []).append(a)
    return f"list_sort(list_filter([{', '.join(f'''CASE WHEN regexp_matches(lower({x}), '(^|[^a-z])({'|'.join(a)})([^a-z]|$)') THEN '{r}' END''' for r, a in by.items())}], lambda r: r IS NOT NULL))"


# Fixed values of the oracles, on their own: how many names the gazetteer has for the nations, and which nations lie in its regions.
_NAMES = {"argentina": 2, "brazil": 4, "canada": 11, "egypt": 2, "france": 2, "germany": 6, "india": 14, "indonesia": 2, "japan": 3, "kenya": 2, "peru": 2, "china": 4, "romania": 2, "saudi arabia": 2, "vietnam": 3, "united kingdom": 10, "united states": 8}
_REGION_NATIONS = {
    "americas": ["argentina", "brazil", "canada", "peru", "united states"], "apac": ["china", "india", "indonesia", "japan", "vietnam"], "asia": ["china", "india", "indonesia", "japan", "saudi arabia", "vietnam"],
    "emea": ["egypt", "france", "germany", "kenya", "romania", "saudi arabia", "united kingdom"], "europe": ["france", "germany", "romania", "united kingdom"], "latam": ["argentina", "brazil", "peru"],
    "north america": ["canada", "united states"],
}
#: Places of the nations, which have no names of their own, by number; and their countries.
_PLACES = [
    ("Argentina", "argentina"), ("Brasil", "brazil"), ("CANADA", "canada"), ("egypt", "egypt"), ("Paris", "france"), ("Deutschland", "germany"), ("Bengaluru", "india"), ("Indonesia", "indonesia"), ("Tokyo", "japan"),
    ("Kenya", "kenya"), ("Lima", "peru"), ("Shanghai", "china"), ("Bucharest", "romania"), ("Riyadh", "saudi arabia"), ("hanoi", "vietnam"), ("U.K.", "united kingdom"), ("USA", "united states"), ("Algeria", None), ("Iran", None),
    (" new delhi ", "india"), ("Scotland", "united kingdom"), ("são paulo", "brazil"), ("america", "united states"), ("Europe", None), ("New York", None),
]
_PLACED = "SELECT n_nationkey, country FROM nation JOIN (VALUES " + ", ".join(f"({i}, {'NULL' if c is None else repr(c)})" for i, (_, c) in enumerate(_PLACES)) + ") AS p(n, country) ON n = n_nationkey % 25"


def _placed(t: Tables) -> DataFrame:
    """(n_nationkey, country): nations by the country of their place."""
    place = F.element_at(F.array(*[F.lit(x) for x, _ in _PLACES]), (F.col("n_nationkey") % 25 + 1).cast("int"))
    names = G.gazetteer_table(t.spark).select(F.col("alias").alias("name"), "country")
    return t.nation.select("n_nationkey", F.lower(F.trim(place)).alias("name")).join(names, "name", "left").select("n_nationkey", "country")


@query("G01_gazetteer", f"SELECT n_nationkey, country, names::BIGINT AS names FROM ({_PLACED}) JOIN (VALUES {', '.join(f"('{c}', {n})" for c, n in _NAMES.items())}) AS g(country, names) USING (country)")
def g01(t: Tables) -> DataFrame:
    """How many names the gazetteer has for each nation."""
    names = G.gazetteer_table(t.spark).groupBy("country").agg(F.count("*").alias("names"))
    return _placed(t).join(names, "country").select("n_nationkey", "country", "names")


_IN_REGIONS = ", ".join(f"('{r}', '{c}')" for r, cs in _REGION_NATIONS.items() for c in cs)


@query("G02_region_members", f"SELECT region, count(DISTINCT n_nationkey) AS nations, count(*) AS customers FROM customer JOIN ({_PLACED}) ON n_nationkey = c_nationkey JOIN (VALUES {_IN_REGIONS}) AS m(region, country) USING (country) GROUP BY 1")
def g02(t: Tables) -> DataFrame:
    """Nations and customers of each region of the gazetteer; customers are added up before they meet it."""
    rows = G.gazetteer_table(t.spark).select("country", F.explode("regions").alias("region")).distinct()
    per = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).join(_placed(t), "n_nationkey")
    return rows.join(per, "country").groupBy("region").agg(F.count("*").alias("nations"), F.sum("n").alias("customers"))


@query("G03_canonical_country", _PLACED)
def g03(t: Tables) -> DataFrame:
    place = F.element_at(F.array(*[F.lit(x) for x, _ in _PLACES]), (F.col("n_nationkey") % 25 + 1).cast("int"))
    return t.nation.select("n_nationkey", G.canonical_country(place).alias("country"))


@query("G04_canonical_region", "SELECT r_regionkey, CASE lower(r_name) WHEN 'europe' THEN 'europe' WHEN 'asia' THEN 'asia' END AS region FROM region")
def g04(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", G.canonical_region(F.col("r_name")).alias("region"))


@query("G05_countries_in", f"{WITH_POSTINGS}SELECT job_id, array_to_string({_named('coalesce(location, chr(32)) || chr(10) || description')}, ',') AS countries FROM postings")
def g05(t: Tables) -> DataFrame:
    return t.postings.select("job_id", F.array_join(G.countries_in(F.concat(F.coalesce("location", F.lit(" ")), F.lit("\n"), "description")), ",").alias("countries"))


def _by_runs(x: str) -> str:
    """Oracle SQL of the sorted countries whose names are runs of a text's words."""
    words = f"' ' || trim(regexp_replace(lower({x}), '[^a-z0-9.]+', ' ', 'g')) || ' '"
    tests = (f"CASE WHEN {' OR '.join(f"contains(w, ' {a} ')" for a in sorted({c, *aliases}))} THEN '{c}' END" for c, aliases, _ in G.GAZETTEER)
    return f"SELECT job_id, array_to_string(list_sort(list_filter([{', '.join(tests)}], lambda c: c IS NOT NULL)), ',') AS countries FROM (SELECT job_id, {words} AS w FROM postings)"


@query("G05_countries_by_join", f"{WITH_POSTINGS}SELECT * FROM ({_by_runs('concat_ws(chr(10), location, description)')}) WHERE countries <> ''")
def g05_join(t: Tables) -> DataFrame:
    found = G.countries_by_join(t.postings.withColumn("where", F.concat_ws("\n", "location", "description")), "job_id", "where", G.gazetteer_table(t.spark))
    return found.select("job_id", F.array_join("countries", ",").alias("countries"))


@query("G06_regions_in", f"{WITH_POSTINGS}SELECT job_id, array_to_string({_regions('coalesce(location, chr(32))')}, ',') AS regions FROM postings")
def g06(t: Tables) -> DataFrame:
    return t.postings.select("job_id", F.array_join(G.regions_in(F.col("location")), ",").alias("regions"))


@query(
    "G07_expand_allowed",
    f"SELECT c_mktsegment AS segment, c_custkey FROM customer JOIN ({_PLACED}) ON n_nationkey = c_nationkey WHERE CASE c_mktsegment WHEN 'BUILDING' THEN country IN {tuple(_REGION_NATIONS['emea'] + ['india'])} WHEN 'MACHINERY' THEN country IN {tuple(_REGION_NATIONS['latam'])} WHEN 'FURNITURE' THEN true ELSE country = 'united states' END",
)
def g07(t: Tables) -> DataFrame:
    """Customers who live where their segment's policy allows, its regions and countries expanded; one allows the whole world."""
    allowed = {"BUILDING": ["EMEA", "India"], "MACHINERY": ["Latin America"], "FURNITURE": ["Worldwide", "Peru"]}
    lives = t.customer.join(_placed(t), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_mktsegment").alias("segment"), "c_custkey", "country")

    def within(places: list[str]) -> Column:
        countries, world = G.expand_allowed(places)
        return F.lit(True) if world else F.coalesce(F.col("country").isin(*countries), F.lit(False))

    test = within(["USA"])
    for segment, places in allowed.items():
        test = F.when(F.col("segment") == segment, within(places)).otherwise(test)
    return lives.where(test).select("segment", "c_custkey")


@query("G08_region_includes", "SELECT r_regionkey, lower(r_name) = 'asia' AS covers FROM region")
def g08(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", G.region_includes_any(G.canonical_region(F.col("r_name")), ["india"]).alias("covers"))


@query("G09_zone_tokens", "SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'PST' WHEN 1 THEN 'CET' WHEN 2 THEN 'GMT' END AS zone, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN -8.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 END::DOUBLE AS hours FROM events")
def g09(t: Tables) -> DataFrame:
    token = F.element_at(F.array(F.lit("Pacific"), F.lit("cest"), F.lit("UTC"), F.lit("lunar")), (F.col("event_id") % 4 + 1).cast("int"))
    zone = X.lookup(V.ZONES, F.lower(token))
    return t.events.select("event_id", zone.alias("zone"), X.lookup(V.ZONE_HOURS, zone).alias("hours"))


@query("G10_near_zones", "SELECT event_id, z IN ('GMT', 'IST', 'CET') AS allowed FROM (SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'GMT' WHEN 1 THEN 'IST' WHEN 2 THEN 'PST' WHEN 3 THEN 'CET' ELSE 'AEST' END AS z FROM events)")
def g10(t: Tables) -> DataFrame:
    zone = F.element_at(F.array(*[F.lit(z) for z in ("GMT", "IST", "PST", "CET", "AEST")]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", G.zone_allowed(zone, ["GMT", "IST"]).alias("allowed"))


def _zones(x: str) -> str:
    """Oracle SQL of the time zones that a text asks for, each with what stands near it."""
    named = []
    for phrase, zone in V.ZONE_PHRASES.items():
        at = f"position('{phrase}' IN lower({x}))"
        named.append(f"CASE WHEN {at} > 0 THEN struct_pack(zone := '{zone}', near := substring(lower({x}), greatest(1, {at} - 60), least({at} - 1, 60) + {len(phrase)})) END")
    groups = [f"regexp_extract_all({x}, '(?i){V.ZONE_IN_CONTEXT}', {i})" for i in (1, 2, 3)]
    zone = "CASE lower(c[2]) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ZONES.items()) + " END"
    beside = f"list_transform(list_filter(list_zip({', '.join(groups)}), lambda c: regexp_matches(c[1] || ' ' || c[3], '(?i){V.TIME_WORDS}')), lambda c: struct_pack(zone := {zone}, near := c[1] || ' ' || c[3]))"
    return f"list_concat(list_filter([{', '.join(named)}], lambda z: z IS NOT NULL), {beside})"


_WITH_ZONES = f"{WITH_POSTINGS}, zoned AS (SELECT *, {_zones('description')} AS found FROM postings), asked AS (SELECT *, list_sort(list_distinct(list_transform(found, lambda z: z.zone))) AS zones, coalesce(list_bool_or(list_transform(found, lambda z: regexp_matches(z.near, '(?i){V.STRICT_WORDS}'))), false) AS strict FROM zoned)\n"


@query("G11_detect_zones", f"{_WITH_ZONES}SELECT job_id, array_to_string(zones, ',') AS zones, strict FROM asked")
def g11(t: Tables) -> DataFrame:
    found = t.postings.select("job_id", G.detect_zones(F.col("description")).alias("z"))
    return found.select("job_id", F.array_join("z.zones", ",").alias("zones"), F.col("z.strict").alias("strict"))


@query("R01_work_model", f"{WITH_POSTINGS}SELECT job_id, CASE ({_POLICY}) WHEN 'unknown' THEN 'unknown' WHEN 'remote' THEN 'pass' ELSE 'fail' END AS outcome FROM postings")
def r01(t: Tables) -> DataFrame:
    return with_policy(t.postings).select("job_id", R.work_model(F.col("remote_policy"), POLICY).alias("outcome"))


def _country_of(place: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in _ALIASES.items())
    plain = f"replace(lower(trim({place})), ' of america', '')"
    return f"coalesce(CASE {plain} {cases} END, CASE replace({plain}, '.', '') {cases} END)"


_RESIDENCE = "list_concat(" + ", ".join(f"regexp_extract_all(description, '(?i){p}', 1)" for p in V.RESIDENCY) + ")"
_R02 = f"CASE WHEN len(list_filter(list_transform({_RESIDENCE}, lambda p: {_country_of('p')}), lambda c: c IS NOT NULL AND c <> 'india')) > 0 THEN 'fail' ELSE 'unknown' END"


@query("R02_excluded_region", f"{WITH_POSTINGS}SELECT job_id, {_R02} AS outcome FROM postings")
def r02(t: Tables) -> DataFrame:
    return t.postings.select("job_id", R.excluded_region(text_facts(F.col("description"), "residency").residency, POLICY).alias("outcome"))


_R03 = f"""CASE WHEN trim(coalesce(location, '')) = '' THEN 'unknown' WHEN list_contains({_named('location')}, 'india') THEN 'pass' WHEN list_contains({_regions('location')}, 'worldwide') THEN 'pass'
  WHEN len(list_intersect({_regions('location')}, ['asia', 'apac'])) > 0 THEN 'pass' WHEN len({_named('location')}) + len({_regions('location')}) > 0 THEN 'fail' ELSE 'unknown' END"""


@query("R03_location", f"{WITH_POSTINGS}SELECT job_id, {_R03} AS outcome FROM postings")
def r03(t: Tables) -> DataFrame:
    named = t.postings.select("job_id", "location", text_facts(F.col("location"), "countries", "regions").alias("named"))
    return named.select("job_id", R.location(F.col("location"), F.col("named"), POLICY).alias("outcome"))


def _spans(pattern: str, high: bool) -> str:
    """Oracle SQL of the required spans of experience in a text: pieces between matches tell what stands before and after each."""
    p = f"(?i){pattern}"
    lists = f"string_split_regex(description, '{p}') AS pieces, regexp_extract_all(description, '{p}') AS found, regexp_extract_all(description, '{p}', 1) AS lows, {f"regexp_extract_all(description, '{p}', 2)" if high else "CAST([] AS VARCHAR[])"} AS highs"
    before = f"right(array_to_string(list_transform(range(1, i + 1), lambda j: CASE WHEN j > 1 THEN found[j - 1] ELSE '' END || pieces[j]), ''), {V.LOOK_BEHIND})"
    after = f"left(array_to_string(list_transform(range(i + 1, len(pieces) + 1), lambda j: pieces[j] || coalesce(found[j], '')), ''), {V.LOOK_AHEAD})"
    last = lambda words: f"length(regexp_extract(before, '(?is)^(.*(?:{words.replace(chr(39), chr(39) * 2)}))', 1))"
    preferred = f"({last(V.PREFERRED)} > {last(V.REQUIRED)} OR regexp_matches(after, '(?i)^{V.PREFERRED_AFTER}'))"
    return f"""SELECT job_id, CAST(lows[i] AS DOUBLE) AS low, try_cast(nullif(highs[i], '') AS DOUBLE) AS high, {int(not high)} AS kind, i, {preferred} AS preferred
  FROM (SELECT job_id, lows, highs, i, {before} AS before, {after} AS after FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT job_id, {lists} FROM postings)))"""


_YEARS = f"""years AS (SELECT job_id, low, high FROM ({_spans(V.EXPERIENCE, True)} UNION ALL {_spans(V.LEAST_EXPERIENCE, False)})
  WHERE NOT preferred AND low <= {V.MOST_YEARS} AND (high IS NULL OR (high <= {V.MOST_YEARS} AND high >= low)) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY low DESC, kind, i) = 1)"""


@query("R04_preferred", f"{WITH_POSTINGS}, {_YEARS} SELECT job_id, low, high FROM postings LEFT JOIN years USING (job_id)")
def r04(t: Tables) -> DataFrame:
    return t.postings.select("job_id", R.required_experience(F.col("description")).alias("y")).select("job_id", "y.low", "y.high")


_STATED = f"list_zip(regexp_extract_all(description, '(?i){V.EXPERIENCE}', 1), regexp_extract_all(description, '(?i){V.EXPERIENCE}', 2))"


@query(
    "R05_stated_experience",
    f"{WITH_POSTINGS}SELECT job_id, list_max(list_transform(list_filter({_STATED}, lambda s: CAST(s[1] AS DOUBLE) <= {V.MOST_YEARS} AND (try_cast(s[2] AS DOUBLE) IS NULL OR (try_cast(s[2] AS DOUBLE) <= {V.MOST_YEARS} AND try_cast(s[2] AS DOUBLE) >= CAST(s[1] AS DOUBLE)))), lambda s: CAST(s[1] AS DOUBLE))) AS low FROM postings",
)
def r05(t: Tables) -> DataFrame:
    return t.postings.select("job_id", R.stated_experience(F.col("description")).low.alias("low"))


@query("R06_experience_outcome", "SELECT p_partkey, CASE WHEN p_size % 12 > 7 THEN 'fail' WHEN p_size % 5 = 0 AND p_size % 3 < 2 THEN 'fail' ELSE 'pass' END AS outcome FROM part")
def r06(t: Tables) -> DataFrame:
    low, high = (F.col("p_size") % 12).cast("double"), F.when(F.col("p_size") % 5 == 0, (F.col("p_size") % 3).cast("double"))
    return t.part.select("p_partkey", R.experience_outcome(low, high, POLICY).alias("outcome"))


_NEAR = [z for z, h in V.ZONE_HOURS.items() if z in POLICY.allowed_timezones or any(abs(h - V.ZONE_HOURS[a]) <= V.NEAR_HOURS for a in POLICY.allowed_timezones)]
_R07 = f"CASE WHEN len(zones) = 0 THEN 'unknown' WHEN list_has_any(zones, {_NEAR}) THEN 'pass' WHEN strict THEN 'fail' ELSE 'unknown' END"


@query("R07_timezone", f"{_WITH_ZONES}SELECT job_id, {_R07} AS outcome FROM asked")
def r07(t: Tables) -> DataFrame:
    z = t.postings.select("job_id", G.detect_zones(F.col("description")).alias("z"))
    return z.select("job_id", R.timezone(F.col("z.zones"), F.col("z.strict"), POLICY).alias("outcome"))


def _outcome(name: str) -> Column:
    return F.filter("rules", lambda r: r.rule == name)[0].outcome.alias(name)


def _evaluated(t: Tables) -> DataFrame:
    return R.evaluate(with_policy(t.postings), POLICY)


_OUTCOMES = f"""CASE ({_POLICY}) WHEN 'unknown' THEN 'unknown' WHEN 'remote' THEN 'pass' ELSE 'fail' END AS work_model, {_R02} AS excluded_region, {_R03} AS location_outcome,
  CASE WHEN low > 7 OR high < 2 THEN 'fail' WHEN low IS NULL AND high IS NULL THEN 'unknown' ELSE 'pass' END AS experience, {_R07} AS timezone"""
_EVALUATED = f"{_WITH_ZONES}, {_YEARS}, outcomes AS (SELECT *, {_OUTCOMES} FROM asked LEFT JOIN years USING (job_id)), evaluated AS (SELECT *, CASE WHEN 'fail' IN (work_model, excluded_region, location_outcome, experience, timezone) THEN 'ineligible' ELSE 'eligible' END AS status FROM outcomes)\n"


@query("R08_evaluate", f"{_EVALUATED}SELECT job_id, status, work_model, excluded_region, location_outcome AS location, experience, timezone FROM evaluated")
def r08(t: Tables) -> DataFrame:
    e = _evaluated(t)
    return e.select("job_id", F.col("eligibility.status").alias("status"), *[_outcome(n) for n in R.RULES])


@query(
    "R09_policy_hash",
    """SELECT c_custkey, sha256('{"allowed_locations":["' || n_name || '","Worldwide"],"allowed_work_models":["remote"],"allowed_timezones":["IST","GMT","BST","CET","EET"],"experience_min":' || (c_custkey % 4) || '.5,"experience_max":6.0,"excluded_regions":["US-only","Canada-only"],"experience_tolerance_years":1.0}') AS policy_hash
  FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def r09(t: Tables) -> DataFrame:
    """The hash of each customer's own policy."""
    lives = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    own = {"allowed_locations": F.array("n_name", F.lit("Worldwide")), "experience_min": (F.col("c_custkey") % 4 + 0.5).cast("double")}
    return lives.select("c_custkey", POLICY.hash(**own).alias("policy_hash"))


@query("R10_snippet", "SELECT doc_id, trim(regexp_replace(substring(text, greatest(0, 30 - 40) + 1, least(length(text), 60 + 40) - greatest(0, 30 - 40)), '\\s+', ' ', 'g'), ' ') AS snippet FROM documents")
def r10(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.snippet(F.col("text"), F.lit(30), F.lit(60)).alias("snippet"))


def _facts(t: Tables) -> DataFrame:
    """Extracted facts made of labels."""
    k = F.col("doc_id") % 6
    facts = F.struct(
        F.when(k == 0, "remote").when(k == 1, "onsite").otherwise("unknown").alias("remote_policy"),
        F.when(k == 2, F.array(F.lit("India"))).when(k == 3, F.array(F.lit("USA"))).otherwise(F.array().cast("array<string>")).alias("permitted_countries"),
        F.when(k == 4, F.array(F.lit("India"))).otherwise(F.array().cast("array<string>")).alias("excluded_countries"),
        F.when(k == 0, F.lit(4.0)).when(k == 5, F.lit(12.0)).alias("minimum_experience"),
        F.lit(None).cast("double").alias("maximum_experience"),
        F.when(k == 1, F.array(F.lit("cet"))).when(k == 5, F.array(F.lit("pst"))).otherwise(F.array().cast("array<string>")).alias("timezone_requirements"),
        F.when(k == 5, "U.S.").alias("residency_requirement"),
        F.when(F.col("doc_id") % 7 == 0, 0.3).otherwise(0.9).alias("confidence"),
    )
    return t.labels.select(F.col("doc_id").alias("job_id"), facts.alias("facts"))


_AI = "CASE CAST(doc_id % 6 AS INT) {} END"
_AI_CASES = {
    "work_model": "WHEN 0 THEN 'pass' WHEN 1 THEN 'fail'",
    "excluded_region": "WHEN 3 THEN 'fail' WHEN 4 THEN 'fail' WHEN 5 THEN 'fail' ELSE 'pass'",
    "location": "WHEN 2 THEN 'pass' WHEN 3 THEN 'fail'",
    "experience": "WHEN 0 THEN 'pass' WHEN 5 THEN 'fail'",
    "timezone": "WHEN 1 THEN 'pass' WHEN 5 THEN 'fail'",
}


@query("R11_ai_rules", "SELECT doc_id AS job_id, " + ", ".join(f"{_AI.format(c)} AS {n}" for n, c in _AI_CASES.items()) + " FROM labels")
def r11(t: Tables) -> DataFrame:
    return _facts(t).select("job_id", *[R.ai_outcome(n, F.col("facts"), POLICY).alias(n) for n in R.RULES])


_MERGED = {n: f"CASE WHEN {own} = 'unknown' AND doc_id % 7 <> 0 THEN coalesce({_AI.format(_AI_CASES[n])}, 'unknown') ELSE {own} END" for n, own in zip(R.RULES, ("work_model", "excluded_region", "location_outcome", "experience", "timezone"))}


@query("R12_apply_intelligence", f"{_EVALUATED}SELECT job_id, " + ", ".join(f"{v} AS {n}" for n, v in _MERGED.items()) + " FROM evaluated JOIN labels ON doc_id = job_id")
def r12(t: Tables) -> DataFrame:
    e = _evaluated(t).join(_facts(t), "job_id").withColumn("rules", R.apply_intelligence(F.col("rules"), F.col("facts"), POLICY))
    return e.select("job_id", *[_outcome(n) for n in R.RULES])


@query("R13_needs_enrichment", f"{_EVALUATED}SELECT job_id FROM evaluated WHERE status = 'eligible' AND 'unknown' IN (work_model, excluded_region, location_outcome, experience, timezone)")
def r13(t: Tables) -> DataFrame:
    return _evaluated(t).where(R.needs_enrichment(F.col("eligibility"))).select("job_id")


@query(
    "R14_route_extraction",
    "SELECT doc_id, CASE WHEN doc_id % 10 < 6 AND doc_id % 3 = 0 AND (doc_id % 8) / 8.0 >= (doc_id % 10) / 10.0 THEN 'deep' ELSE 'cheap' END AS used, 150 + CASE WHEN doc_id % 10 < 6 AND doc_id % 3 = 0 THEN 300 ELSE 0 END AS tokens FROM labels",
)
def r14(t: Tables) -> DataFrame:
    cheap = F.struct((F.col("doc_id") % 10 / 10.0).alias("confidence"), F.lit(100).alias("tokens_in"), F.lit(50).alias("tokens_out"))
    deep = F.when(F.col("doc_id") % 3 == 0, F.struct((F.col("doc_id") % 8 / 8.0).alias("confidence"), F.lit(200).alias("tokens_in"), F.lit(100).alias("tokens_out")))
    routed = t.labels.select("doc_id", R.route_extraction(cheap, deep, (0.1, 0.4), (1.0, 4.0)).alias("r"))
    return routed.select("doc_id", "r.used", "r.tokens")


@query("K01_skill_match", "SELECT doc_id, round(CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 / 2.5 END, 4)::DOUBLE AS value, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'rust' WHEN 1 THEN 'java' ELSE '' END AS missing FROM documents")
def k01(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    none = F.array().cast("array<string>")
    required = F.when(k == 0, F.array(F.lit("python"), F.lit("rust"))).when(k == 1, F.array(F.lit("docker"), F.lit("java"))).otherwise(none)
    preferred = F.when(k == 1, F.array(F.lit("docker"), F.lit("llm"))).otherwise(none)
    made = t.documents.select("doc_id", K.skill_match(required, preferred, HAVE).alias("m"))
    return made.select("doc_id", "m.value", F.array_join("m.missing", ",").alias("missing"))


@query("K02_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 3) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def k02(t: Tables) -> DataFrame:
    profile = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("profile"))
    return t.embeddings.join(F.broadcast(profile)).select("vec_id", F.round(K.cosine(F.col("embedding"), F.col("profile")), 3).alias("similarity"))


@query("K03_semantic", "SELECT a.vec_id, round(greatest(0, least(1, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) - 0.1) / 0.6)), 3) AS value FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def k03(t: Tables) -> DataFrame:
    profile = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("profile"))
    value = K.clamp((K.cosine(F.col("embedding"), F.col("profile")) - 0.1) / 0.6)
    return t.embeddings.join(F.broadcast(profile)).select("vec_id", F.round(value, 3).alias("value"))


def _overlap(role: str) -> str:
    words = "['" + "', '".join(role.split()) + "']"
    return f"len(list_intersect({words}, string_split({_TITLE}, ' '))) / {len(role.split())}.0"


@query(
    "K04_role_overlap",
    f"{WITH_POSTINGS}SELECT job_id, CASE WHEN {_overlap('backend developer')} > {_overlap('artificial intelligence engineer')} THEN 'Backend Developer' ELSE 'AI Engineer' END AS role, round(greatest({_overlap('artificial intelligence engineer')}, {_overlap('backend developer')}), 4)::DOUBLE AS value FROM postings",
)
def k04(t: Tables) -> DataFrame:
    best = t.postings.select("job_id", K.role_similarity(X.normalize_title(F.col("title")), ROLES, ratio=False).alias("r"))
    return best.select("job_id", "r.role", "r.value")


def _best_role(title: str) -> tuple[str, float]:
    """The most similar role of a normalised title, in plain Python."""

    def value(role: str) -> float:
        words = list(dict.fromkeys(role.split()))
        return round(max(SequenceMatcher(None, role, title).ratio(), len(set(words) & set(title.split())) / len(words)), 4)

    scores = [value("artificial intelligence engineer"), value("backend developer")]
    return ROLES[scores.index(max(scores))], max(scores)


#: The titles of postings, normalised by hand.
_PLAIN_TITLES = [
    "senior artificial intelligence engineer", "staff python developer", "junior data analyst", "engineering manager platform", "backend developer 2", "principal machine learning engineer", "intern research",
    "full stack software engineer", "head of data analytics", "lead frontend engineer", "mid-level go developer", "support specialist",
]
_ROLE_OF = "CASE CAST(job_id % 12 AS INT) " + " ".join(f"WHEN {i} THEN {{}}" for i in range(12)) + " END"


@query("K04_role_similarity", f"{WITH_POSTINGS}SELECT job_id, {_ROLE_OF.format(*[repr(_best_role(x)[0]) for x in _PLAIN_TITLES])} AS role, {_ROLE_OF.format(*[_best_role(x)[1] for x in _PLAIN_TITLES])}::DOUBLE AS value FROM postings")
def k04_ratio(t: Tables) -> DataFrame:
    titles = t.postings.select(X.normalize_title(F.col("title")).alias("title")).distinct()  # the ratio is computed once per title
    scored = titles.withColumn("best", K.role_similarity(F.col("title"), ROLES))
    return t.postings.select("job_id", X.normalize_title(F.col("title")).alias("title")).join(scored, "title").select("job_id", "best.role", "best.value")


@query("K05_seniority_fit", f"{WITH_POSTINGS}SELECT job_id, CASE ({_SENIORITY}) WHEN 'unknown' THEN 0.6 WHEN 'senior' THEN 1.0 WHEN 'mid' THEN 0.6 WHEN 'lead' THEN 0.6 WHEN 'staff' THEN 0.6 WHEN 'manager' THEN 0.6 WHEN 'junior' THEN 0.2 WHEN 'principal' THEN 0.2 ELSE 0.0 END::DOUBLE AS value FROM postings")
def k05(t: Tables) -> DataFrame:
    return t.postings.select("job_id", K.seniority_fit(X.seniority(F.col("title")), "senior").alias("value"))


def _credit(x: str) -> str:
    return f"CASE {x} WHEN 'pass' THEN 1.0 WHEN 'unknown' THEN 0.6 ELSE 0.0 END"


_FIT = f"round(({_credit('location_outcome')} + {_credit('timezone')} + {_credit('work_model')}) / 3.0, 4)::DOUBLE"
_FRESH = f"round(pow(0.5, greatest(0, epoch({NOW}) - epoch(published_at)) / 86400.0 / 7), 4)"


@query("K06_location_fit", f"{_EVALUATED}SELECT job_id, {_FIT} AS value FROM evaluated")
def k06(t: Tables) -> DataFrame:
    return _evaluated(t).select("job_id", K.rule_credit(F.col("rules")).alias("value"))


@query("K07_freshness", f"{WITH_POSTINGS}SELECT job_id, {_FRESH} AS value FROM postings")
def k07(t: Tables) -> DataFrame:
    return t.postings.select("job_id", K.freshness(F.col("published_at"), F.expr(NOW)).alias("value"))


def with_components(t: Tables, evaluated: DataFrame) -> DataFrame:
    """``evaluated`` with score ``s`` of all six components; a posting without a vector lacks the semantic one, one without skills theirs."""
    vectors = t.embeddings.groupBy(F.col("vec_id").alias("job_id")).agg(F.min("embedding").alias("vector"))
    profile = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("profile")).limit(1)
    similar = vectors.join(F.broadcast(profile)).select("job_id", K.semantic(K.cosine(F.col("vector"), F.col("profile"))).alias("semantic"))
    titles = evaluated.select("title").distinct()  # the ratio is computed once per title
    roles = titles.select(F.col("title"), K.role_similarity(X.normalize_title(F.col("title")), ROLES).value.alias("role"))
    # each component is a column of its own, so that none is computed once per use
    skilled = evaluated.withColumn("skills", X.extract_skills(F.concat_ws("\n", "title", "description")))
    parts = {
        "skill_match": K.skill_match(F.col("skills"), F.array().cast("array<string>"), HAVE).value,
        "semantic_similarity": F.col("semantic"),
        "role_similarity": F.col("role"),
        "seniority_fit": K.seniority_fit(X.seniority(F.col("title")), "senior"),
        "location_timezone_fit": K.rule_credit(F.col("rules")),
        "freshness": K.freshness(F.col("published_at"), F.expr(NOW)),
    }
    joined = skilled.join(similar, "job_id", "left").join(roles, "title", "left").withColumns({f"part_{k}": v for k, v in parts.items()})
    return joined.withColumn("s", K.total_score({k: F.col(f"part_{k}") for k in parts}))


def _scored(t: Tables) -> DataFrame:
    return with_components(t, _evaluated(t)).select("job_id", F.col("eligibility.status").alias("status"), "s")


_FIT_SENIOR = f"CASE ({_SENIORITY}) WHEN 'unknown' THEN 0.6 WHEN 'senior' THEN 1.0 WHEN 'mid' THEN 0.6 WHEN 'lead' THEN 0.6 WHEN 'staff' THEN 0.6 WHEN 'manager' THEN 0.6 WHEN 'junior' THEN 0.2 WHEN 'principal' THEN 0.2 ELSE 0.0 END::DOUBLE"
_SKILL = f"CASE WHEN len({_SKILLS}) > 0 THEN round(len(list_intersect({_SKILLS}, {HAVE})) / len({_SKILLS}), 4) END"
_SEMANTIC = "CASE WHEN v.vec_id IS NOT NULL THEN round(greatest(0, least(1, (list_cosine_similarity(v.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) - 0.1) / 0.6)), 4) END"
_SCORE = f"""round(CAST(CAST(greatest(0, least(1, coalesce(skill, 0) * round(0.30 / there, 6) + coalesce(semantic, 0) * round(0.20 / there, 6) + role * round(0.15 / there, 6) + senior * round(0.15 / there, 6) + fit * round(0.10 / there, 6) + fresh * round(0.10 / there, 6))) AS VARCHAR) AS DECIMAL(38, 25)), 4)"""  # as decimals, like Spark


def _scores(source: str) -> str:
    """Oracle SQL of the table ``scored`` from a table with outcomes of rules."""
    return f""", parts AS (SELECT e.*, {_SKILL} AS skill, {_SEMANTIC} AS semantic, {_ROLE_OF.format(*[_best_role(x)[1] for x in _PLAIN_TITLES])}::DOUBLE AS role, {_FIT_SENIOR} AS senior, {_FIT} AS fit, {_FRESH} AS fresh, v.vec_id IS NOT NULL AS embedded
    FROM {source} e LEFT JOIN embeddings v ON v.vec_id = e.job_id),
  weighed AS (SELECT *, CASE WHEN skill IS NULL THEN 0.0 ELSE 0.30 END::DOUBLE + CASE WHEN semantic IS NULL THEN 0.0 ELSE 0.20 END::DOUBLE + 0.15::DOUBLE + 0.15::DOUBLE + 0.10::DOUBLE + 0.10::DOUBLE AS there FROM parts),
  scored AS (SELECT *, {_SCORE}::DOUBLE AS score FROM weighed)
"""


@query("K08_score", f"{_EVALUATED}{_scores('evaluated')}SELECT job_id, status, score FROM scored")
def k08(t: Tables) -> DataFrame:
    return _scored(t).select("job_id", "status", F.col("s.final_score").alias("score"))


@query("K09_notify", f"{_EVALUATED}{_scores('evaluated')}SELECT job_id FROM scored WHERE status = 'eligible' AND score >= 0.6")
def k09(t: Tables) -> DataFrame:
    return _scored(t).where((F.col("status") == "eligible") & (F.col("s.final_score") >= 0.6)).select("job_id")


@query(
    "W10_nearest",
    "SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 3) AS similarity FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings v WHERE q.vec_id <> v.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) <= 5",
)
def w10(t: Tables) -> DataFrame:
    found = nearest(t.embeddings.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", "vec_id", F.round("similarity", 3).alias("similarity"))


_MERGED_STATUS = "CASE WHEN 'fail' IN (work_model, excluded_region, location_outcome, experience, timezone) THEN 'ineligible' ELSE 'eligible' END"
_ENRICHED = f""", enriched AS (SELECT *, {_MERGED_STATUS} AS final_status FROM (SELECT evaluated.* EXCLUDE (work_model, excluded_region, location_outcome, experience, timezone), doc_id IS NOT NULL AS extracted,
  {', '.join(f"{_MERGED[n]} AS {c}" for n, c in zip(R.RULES, ('work_model', 'excluded_region', 'location_outcome', 'experience', 'timezone')))} FROM evaluated LEFT JOIN labels ON doc_id = job_id))"""


def _pipeline(t: Tables) -> DataFrame:
    """Evaluation in stages: rules, facts where they were extracted, vectors where there are some, scores."""
    facts = _facts(t)
    e = _evaluated(t).join(facts, "job_id", "left").withColumn("rules", F.when(F.col("facts").isNull(), F.col("rules")).otherwise(R.apply_intelligence(F.col("rules"), F.col("facts"), POLICY)))
    return with_components(t, e.withColumn("status", R.summarise(F.col("rules")).status))


@query(
    "X12_evaluation_pipeline",
    f"{_EVALUATED}{_ENRICHED}{_scores('enriched')}SELECT job_id, final_status AS status, CASE WHEN final_status = 'eligible' THEN score END AS score, CASE WHEN final_status = 'ineligible' THEN 'rejected' WHEN score >= 0.6 THEN 'notified' ELSE 'ranked' END AS state FROM scored",
)
def x12(t: Tables) -> DataFrame:
    eligible = F.col("status") == "eligible"
    state = F.when(~eligible, "rejected").when(F.col("s.final_score") >= 0.6, "notified").otherwise("ranked")
    return _pipeline(t).select("job_id", "status", F.when(eligible, F.col("s.final_score")).alias("score"), state.alias("state"))


@query(
    "X13_degradation",
    f"{_EVALUATED}{_ENRICHED}{_scores('enriched')}SELECT job_id, concat_ws(',', CASE WHEN NOT extracted THEN 'enrich' END, CASE WHEN NOT embedded THEN 'embed' END) AS failed, CASE WHEN extracted AND embedded THEN 'full' ELSE 'degraded' END AS mode, score FROM scored",
)
def x13(t: Tables) -> DataFrame:
    """Stages whose table has nothing for a posting leave nulls, and the posting is scored by what the others gave."""
    p = _pipeline(t)
    missing = F.concat_ws(",", F.when(F.col("facts").isNull(), "enrich"), F.when(F.col("semantic").isNull(), "embed"))
    return p.select("job_id", missing.alias("failed"), F.when(missing == "", "full").otherwise("degraded").alias("mode"), F.col("s.final_score").alias("score"))


def _edited(postings: DataFrame) -> DataFrame:
    """The catalogue after German postings moved to India."""
    return postings.withColumn("location", F.when(F.col("lang") == "de", "India").otherwise(F.col("location")))


def _hash() -> Column:
    return L.content_hash(F.col("title"), F.col("location"), F.col("description")).alias("content_hash")


_EDITED_EVALUATED = _EVALUATED.replace("postings AS (SELECT *, concat_ws(", "postings AS (SELECT * REPLACE (CASE WHEN lang = 'de' THEN 'India' ELSE location END AS location), concat_ws(")


@query(
    "X12_superseded",
    f"{_EDITED_EVALUATED}SELECT job_id, CASE WHEN lang = 'de' AND remote_hint IS NOT NULL THEN 'superseded' ELSE 'landed' END AS first_verdict, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS work_id, CASE WHEN lang = 'de' AND remote_hint IS NULL THEN 2 ELSE 1 END AS version, status FROM evaluated",
)
def x12_superseded(t: Tables) -> DataFrame:
    """Evaluations of the texts before an edit land after it: only those of unchanged postings and forced ones do, and none twice.

    The evaluations of the edited texts land last.
    """
    now = _edited(t.postings)
    catalogue = now.select("job_id", _hash())

    def work(postings: DataFrame, work_id: int, force: Column) -> DataFrame:
        hashes = postings.select("job_id", _hash(), force.alias("force"), F.lit(work_id).alias("work_id"))
        status = R.evaluate(with_policy(postings), POLICY).select("job_id", F.col("eligibility.status").alias("status"))
        return stored(hashes.join(status, "job_id"), "evaluations")

    before = work(t.postings, 1, (F.col("lang") == "de") & F.col("remote_hint").isNull())
    after = work(now.where("lang = 'de'"), 2, F.lit(False))
    none = t.spark.createDataFrame([], "job_id long, work_id int, status string, version int")
    first = stored(L.land(before, catalogue, none), "results")
    second = stored(L.land(before.unionByName(after), catalogue, first), "results")
    verdict = L.verdicts(before, catalogue, none).select("job_id", F.col("verdict").alias("first_verdict"))
    return L.latest(second).join(verdict, "job_id").select("job_id", "first_verdict", "work_id", "version", "status")


@query(
    "X12_resume",
    """SELECT doc_id AS job_id, CASE WHEN lang = 'de' OR l.quality IS NULL THEN 'eligibility' WHEN e.vec_id IS NULL THEN 'embed' ELSE 'rank' END AS stage
  FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id) LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON vec_id = doc_id""",
)
def x12_resume(t: Tables) -> DataFrame:
    """Where evaluations go on: after the labels and vectors that there are, from the beginning where the text was edited since."""
    read = t.postings.select("job_id", _hash())
    labelled = read.join(t.labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("job_id")), "job_id", "left_semi")
    embedded = read.join(t.embeddings.select(F.col("vec_id").alias("job_id")), "job_id", "left_semi")
    finished = labelled.select("*", F.explode(F.array(F.lit("eligibility"), F.lit("enrich"))).alias("stage")).unionByName(embedded.withColumn("stage", F.lit("embed")))
    return L.next_stage(finished, _edited(t.postings).select("job_id", _hash())).select("job_id", "stage")
