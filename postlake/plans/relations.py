"""Queries of visibility, filters, joins, order and pages."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from postlake.functions.text import seniority, trigram_similarity, trigrams
from postlake.operators import scope as S, search as Q
from postlake.operators.dedupe import first_per
from postlake.operators.inverted import Index
from postlake.operators.stored import fresh_path, numbered
from postlake.plans.base import WITH_POSTINGS, Tables, query
from postlake.plans.stems_sql import stems_sql
from postlake.plans.normalisation import _POLICY as _MODEL, _SENIORITY, with_policy

_ME = 7  # the workspace of the examples: a nation
_FAN, _FAN_TASKS, _FAN_BLOCK = 64, 200, 128  # parts that one nation's customers are dealt to, tasks at most, customers that are sent together


@query("F01_tenant_scope", "SELECT 'mine' AS scope, c_custkey FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'system', c_custkey FROM customer")
def f01(t: Tables) -> DataFrame:
    found = None
    for name, scope in (("mine", S.Scope(workspace=_ME)), ("system", S.SYSTEM), ("none", S.NONE)):
        one = S.scoped(t.customer, scope, "c_nationkey").select(F.lit(name).alias("scope"), "c_custkey")
        found = one if found is None else found.union(one)
    return found


@query(
    "F02_scope_variants",
    "SELECT 'null_or_mine' AS kind, o_orderkey AS id FROM orders WHERE o_custkey % 5 = 0 OR o_custkey % 25 = 7 UNION ALL SELECT 'members', c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 25 = 7)",
)
def f02(t: Tables) -> DataFrame:
    runs = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 25).alias("workspace_id"))
    mine = S.scoped(runs, S.Scope(workspace=7), shared_null=True).select(F.lit("null_or_mine").alias("kind"), F.col("o_orderkey").alias("id"))
    memberships = t.orders.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 25).alias("workspace_id"))
    members = S.members_only(t.customer, memberships, S.Scope(workspace=7), "c_custkey").select(F.lit("members").alias("kind"), F.col("c_custkey").alias("id"))
    secrets = S.system_only(t.customer, S.Scope(workspace=7)).select(F.lit("secrets").alias("kind"), F.col("c_custkey").alias("id"))
    return mine.union(members).union(secrets)


@query("F03_visible_sources", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7)")
def f03(t: Tables) -> DataFrame:
    followed = t.supplier.where("s_nationkey = 7").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.join(followed, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


def overlay(t: Tables) -> DataFrame:
    """A profile's view of postings: status and score, where there are labels."""
    status = F.when(F.col("quality") == 1, "eligible").when(F.col("quality") == 0, "ineligible")
    return t.labels.select(F.col("doc_id").alias("job_id"), status.alias("status"), (F.col("doc_id") % 100 / 100.0).alias("score"))


_STATE = "CASE quality WHEN 1 THEN 'eligible' WHEN 0 THEN 'ineligible' END"
_VIEW = f"{WITH_POSTINGS}, seen AS (SELECT p.*, {_STATE} AS status, CASE WHEN quality IS NOT NULL THEN (p.job_id % 100) / 100.0 END AS score FROM postings p LEFT JOIN labels l ON l.doc_id = p.job_id)\n"


def _searchable(t: Tables) -> DataFrame:
    p = with_policy(t.postings).withColumn("seniority", seniority(F.col("title")))
    return p.withColumns({"closed_at": F.when(F.col("job_id") % 10 == 0, F.col("published_at")), "duplicate_of": F.when(F.col("job_id") % 11 == 0, F.col("job_id") - 1), "first_seen_at": F.col("published_at")})


def _followed(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("source_id")).distinct().where("source_id NOT IN ('src1', 'src2')")


@query(
    "F04_ten_filters",
    f"{_VIEW}SELECT job_id FROM seen WHERE source_id NOT IN ('src1', 'src2') AND coalesce(status, 'pending') = 'eligible' AND score >= 0.3 AND ({_MODEL}) = 'remote' AND ({_SENIORITY}) = 'senior' AND published_at >= TIMESTAMP '2024-06-10' AND job_id % 10 <> 0 AND job_id % 11 <> 0",
)
def f04(t: Tables) -> DataFrame:
    f = Q.JobFilters(eligibility="eligible", min_score=0.3, remote_policy="remote", seniority="senior", published_after=datetime.datetime(2024, 6, 10))
    return Q.search(_searchable(t), _followed(t), overlay(t), f).select("job_id")


@query("F05_default_status", f"{_VIEW}SELECT job_id FROM seen WHERE coalesce(status, 'pending') = 'pending'")
def f05(t: Tables) -> DataFrame:
    return t.postings.join(overlay(t), "job_id", "left").where(F.coalesce("status", F.lit("pending")) == "pending").select("job_id")


@query("F06_open_originals", "SELECT doc_id AS job_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 11 <> 0")
def f06(t: Tables) -> DataFrame:
    return _searchable(t).where("closed_at IS NULL AND duplicate_of IS NULL").select("job_id")


@query("F07_least_score", f"{_VIEW}SELECT job_id, score FROM seen WHERE score >= 0.5")
def f07(t: Tables) -> DataFrame:
    return t.postings.join(overlay(t), "job_id", "left").where("score >= 0.5").select("job_id", "score")


@query("F08_visible_runs", "SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def f08(t: Tables) -> DataFrame:
    followed = t.customer.where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("is_followed")).distinct()
    own = F.when(F.col("o_custkey") % 3 == 0, F.lit(7))
    return t.orders.join(followed, "o_custkey", "left").where(own.isNotNull() | F.col("is_followed")).select("o_orderkey")


@query("F09_pending_invitations", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 7 <> 0 AND o_orderdate + INTERVAL '7' DAY > TIMESTAMP '1997-01-01'")
def f09(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_orderstatus") != "O").alias("accepted"), (F.col("o_orderkey") % 7 == 0).alias("revoked"), (F.col("o_orderdate") + F.expr("INTERVAL '7' DAY")).alias("expires_at"))
    return rows.where(~F.col("accepted") & ~F.col("revoked") & (F.col("expires_at") > F.expr("TIMESTAMP_NTZ '1997-01-01'"))).select("o_orderkey")


@query("F10_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def f10(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("F11_equality_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def f11(t: Tables) -> DataFrame:
    df = t.orders
    for name, value in {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None}.items():
        df = df if value is None else df.where(F.col(name) == value)
    return df.select("o_orderkey")


@query("J01_overlay_left_join", f"{_VIEW}SELECT job_id, status, score FROM seen")
def j01(t: Tables) -> DataFrame:
    return t.postings.select("job_id").join(overlay(t), "job_id", "left").select("job_id", "status", "score")


@query("J02_star", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j02(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("J03_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j03(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("J04_decisions", "SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R'")
def j04(t: Tables) -> DataFrame:
    made = t.lineitem.where("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return made.select("l_orderkey", "l_linenumber", "c_name")


@query("J05_unnest", "SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word = 'idiot' OR word = 'der'")
def j05(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word IN ('idiot', 'der')")


@query("J06_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def j06(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("J07_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j07(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("J08_fan_out", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey % 4 <> 0")
def j08(t: Tables) -> DataFrame:
    """Every customer with every supplier of its nation that isn't paused.

    The result is as large as the product of both. A nation's customers are dealt to ``_FAN`` parts, and its suppliers sent to each of them, so that no file or nation is one task.
    Blocks of a part's customers meet the suppliers and are taken apart last: runs of rows share a supplier or repeat a block, and a task has few parts, so that the
    dictionaries of a written file hold its keys and the file stays far smaller than its rows.
    """
    tasks = max(8, min(_FAN_TASKS, t.customer.count() // 4096))
    unpaused = t.supplier.where("s_suppkey % 4 <> 0").select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(_FAN - 1))).alias("s_part"))
    dealt = t.customer.select("c_custkey", "c_nationkey", F.pmod(F.xxhash64("c_custkey"), F.lit(_FAN)).cast("int").alias("c_part")).repartition(tasks, "c_nationkey", "c_part")
    place = F.row_number().over(Window.partitionBy("c_nationkey", "c_part").orderBy("c_custkey")) - 1
    blocks = dealt.withColumn("block", F.floor(place / _FAN_BLOCK)).groupBy("c_nationkey", "c_part", "block").agg(F.collect_list(F.struct("c_custkey")).alias("customers"))
    met = blocks.join(unpaused.repartition(tasks, "s_nationkey", "s_part").hint("merge"), (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_part") == F.col("s_part")))
    # coalesce() moves nothing; it ends the stage's compiled loop, which would hold all rows of a block before it gives the first
    return met.select("s_suppkey", "customers").coalesce(tasks).select("s_suppkey", F.inline("customers")).select("c_custkey", "s_suppkey")


@query("J09_targets", "SELECT p_partkey, r_name FROM part, region")
def j09(t: Tables) -> DataFrame:
    targets = t.region.agg(F.collect_list("r_name").alias("targets"))  # a table of fixed size
    return t.part.join(F.broadcast(targets)).select("p_partkey", F.explode("targets").alias("r_name"))


@query("J10_memberships", "SELECT n_name, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def j10(t: Tables) -> DataFrame:
    return t.nation.join(t.customer.where("c_acctbal > 0"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_name")


@query("J11_applications", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
def j11(t: Tables) -> DataFrame:
    made = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return made.select("o_orderkey", "c_name", "n_name")


@query("J15_oldest_profile", "SELECT c_custkey, (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1) AS profile FROM customer")
def j15(t: Tables) -> DataFrame:
    oldest = t.orders.groupBy().agg(F.min(F.struct("o_orderdate", "o_orderkey")).o_orderkey.alias("profile"))
    return t.customer.join(F.broadcast(oldest)).select("c_custkey", "profile")


@query("J16_update_from", "SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def j16(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 0")
    return t.orders.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("J17_cache_lookup", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END")
def j17(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("quality"))
    facts = t.labels.select("doc_id", "quality", F.col("quality").alias("found"))
    return d.join(facts, ["doc_id", "quality"], "left").select("doc_id", F.col("found").alias("quality"))


@query("W01_latest_per_key", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def w01(t: Tables) -> DataFrame:
    return first_per(t.conversations, ["conv_id"], F.desc("turn")).select("conv_id", "turn", "role")


@query("W02_history", "SELECT conv_id, array_to_string(list(turn ORDER BY turn DESC), ',') AS turns FROM conversations GROUP BY conv_id")
def w02(t: Tables) -> DataFrame:
    turns = F.reverse(F.array_sort(F.collect_list("turn")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x.cast("string")), ",").alias("turns"))


@query("W03_order", f"{_VIEW}SELECT job_id, row_number() OVER (ORDER BY score DESC NULLS LAST, published_at DESC NULLS LAST, job_id DESC) AS place FROM seen")
def w03(t: Tables) -> DataFrame:
    """The place of every posting, numbered in ranges of the whole order; many rows without a score are many ranges."""
    seen = t.postings.join(overlay(t), "job_id", "left").select("job_id", "score", "published_at")
    return numbered(seen, [F.desc_nulls_last("score"), F.desc_nulls_last("published_at"), F.desc("job_id")]).select("job_id", "place")


@query("W04_page", f"{_VIEW}SELECT job_id, score FROM seen ORDER BY score DESC NULLS LAST, published_at DESC NULLS LAST, job_id DESC LIMIT 25 OFFSET 50")
def w04(t: Tables) -> DataFrame:
    return Q.page(Q.ordered(t.postings.join(overlay(t), "job_id", "left")), 25, 50).select("job_id", "score")


@query("W05_top_matches", f"{_VIEW}SELECT job_id, score FROM seen WHERE status = 'eligible' ORDER BY score DESC NULLS LAST, published_at DESC, job_id DESC LIMIT 5")
def w05(t: Tables) -> DataFrame:
    return Q.ordered(t.postings.join(overlay(t).where("status = 'eligible'"), "job_id")).limit(5).select("job_id", "score")


@query("W06_primary", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS primary_id FROM orders GROUP BY o_custkey")
def w06(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("primary_id"))


@query("W07_membership_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal > 5000 DESC, c_custkey) AS at FROM customer")
def w07(t: Tables) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy((F.col("c_acctbal") > 5000).desc(), "c_custkey")
    return t.customer.select("c_custkey", F.row_number().over(order).cast("long").alias("at"))


@query(
    "W08_versions",
    "SELECT conv_id, turn, sum(changed) OVER (PARTITION BY conv_id ORDER BY turn) AS version FROM (SELECT conv_id, turn, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role THEN 1 ELSE 0 END AS changed FROM conversations)",
)
def w08(t: Tables) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    changed = F.when(F.lag("role").over(order).eqNullSafe(F.col("role")), 0).otherwise(1)
    return t.conversations.withColumn("changed", changed).select("conv_id", "turn", F.sum("changed").over(order).alias("version"))


@query("W09_arg_max_first", "SELECT doc_id, CASE WHEN n_chars % 5 >= n_chars % 3 THEN 'five' ELSE 'three' END AS best FROM documents")
def w09(t: Tables) -> DataFrame:
    scores = F.array(F.struct(F.lit("five").alias("name"), (F.col("n_chars") % 5).alias("v")), F.struct(F.lit("three").alias("name"), (F.col("n_chars") % 3).alias("v")))
    best = F.reduce(scores, F.lit(None).cast("struct<name:string,v:bigint>"), lambda b, s: F.when(b.isNull() | (s.v > b.v), s).otherwise(b))
    return t.documents.select("doc_id", best["name"].alias("best"))


@query(
    "Q01_web_search",
    r"""SELECT p_partkey FROM part WHERE regexp_matches(' ' || lower(p_name) || ' ', '[^a-z0-9](hot|blue)[^a-z0-9]') AND NOT regexp_matches(' ' || lower(p_name) || ' ', '[^a-z0-9]ring[^a-z0-9]')""",
)
def q01(t: Tables) -> DataFrame:
    return t.part.where(Q.matches(Q.tokens(F.col("p_name")), "hot or blue -ring")).select("p_partkey")


@query("Q02_tokens", "SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in sorted(Q.STOP_WORDS)) + ")), ' ')) AS words FROM documents")
def q02(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.array_join(Q.words(F.col("text")), " ")).alias("words"))


def _token_tables(docs: str, text: str = "text") -> str:
    """Common table expressions that end in ``tok(doc, place, stem)`` over the table ``docs``, by rules of their own."""
    words = f"SELECT doc_id AS doc, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({_STOPS})) AS w FROM {docs})"
    return f"spread AS ({words}), {stems_sql('spread')},\n  tok AS (SELECT doc, i AS place, stem FROM spread JOIN stems USING (word))"


_STOPS = ", ".join(f"'{w}'" for w in sorted(Q.STOP_WORDS))


@query("Q02_stems", f"WITH {_token_tables('documents')} SELECT doc_id, coalesce(stems, []) AS stems FROM documents LEFT JOIN (SELECT doc AS doc_id, list(stem ORDER BY place) AS stems FROM tok GROUP BY doc) USING (doc_id)")
def q02_stems(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", Q.tokens(F.col("text")).alias("stems"))


_ASKED = "thing eriner attion thanedble anea thly ertion erings ering la der manager platform".split()


def _has(word: str) -> str:
    """Oracle SQL of whether a document holds the stem of a word."""
    return f"list_contains(stems, ask_{word})"


def _phrase(words: str) -> str:
    """Oracle SQL of whether a document's stems hold those of some words in a row."""
    return f"contains(' ' || array_to_string(stems, ' ') || ' ', ' ' || {" || ' ' || ".join(f'ask_{w}' for w in words.split())} || ' ')"


#: Searches, and the same as conditions on a document's stems.
_SEARCHES = {
    "thing eriner": f"{_has('thing')} AND {_has('eriner')}",
    '"attion thanedble anea" -thly': f"{_phrase('attion thanedble anea')} AND NOT {_has('thly')}",
    "ertion or ERINGS": f"{_has('ertion')} OR {_has('erings')}",
    "-la -der": f"NOT {_has('la')} AND NOT {_has('der')}",
    "ering thing or -la": f"{_has('ering')} AND ({_has('thing')} OR NOT {_has('la')})",
    '"the of"': "false",
}


def _searched(docs: str, searches: dict[str, str], text: str = "text", kept: str = "doc_id") -> str:
    tokens = _token_tables(docs, text).replace("FROM spread)", f"FROM (SELECT word FROM spread UNION ALL SELECT unnest({_ASKED})))")
    ask = ", ".join(f"max(CASE WHEN word = '{w}' THEN stem END) AS ask_{w}" for w in _ASKED)
    found = " UNION ALL ".join(f"SELECT '{q}' AS query, doc_id FROM per WHERE {c}" for q, c in searches.items())
    return f"{tokens}, ask AS (SELECT {ask} FROM stems), listed AS (SELECT doc AS doc_id, list(stem ORDER BY place) AS stems FROM tok GROUP BY doc), per AS MATERIALIZED (SELECT {kept}, coalesce(stems, []) AS stems, ask.* FROM {docs} LEFT JOIN listed USING (doc_id) CROSS JOIN ask) {found}"


def _found(index: Index, queries: list[str]) -> DataFrame:
    found = [index.matching(q).select(F.lit(q).alias("query"), F.col("doc").alias("doc_id")) for q in queries]
    return reduce(DataFrame.unionByName, found)


@query("Q01_indexed", f"WITH {_searched('documents', _SEARCHES)}")
def q01_indexed(t: Tables) -> DataFrame:
    """Web searches of the texts of all documents, by postings of their stems alone."""
    index = Index(t.spark, fresh_path(t.spark, "search-index"))
    index.apply(t.documents.select(F.col("doc_id").alias("doc"), F.lit(None).cast("string").alias("title"), "text"), 0)
    return _found(index, list(_SEARCHES))


@query(
    "Q01_index_after_changes",
    f"WITH edited AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' thing eriner' ELSE text END AS text FROM documents WHERE lang <> 'fr'), {_searched('edited', _SEARCHES)}",
)
def q01_after_changes(t: Tables) -> DataFrame:
    """The same after a batch that edits the German documents, one that removes the French, one that comes twice, and a compaction."""
    index = Index(t.spark, fresh_path(t.spark, "search-index"))
    docs = t.documents.select(F.col("doc_id").alias("doc"), F.lit(None).cast("string").alias("title"), "text", "lang")
    index.apply(docs, 0)
    german = docs.where("lang = 'de'").withColumn("text", F.concat("text", F.lit(" thing eriner")))
    for _ in range(2):
        index.apply(german, 1)
    index.compact(2)
    index.apply(docs.where("lang = 'fr'").withColumn("text", F.lit(None).cast("string")), 3)
    return _found(index, list(_SEARCHES))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_A, _B = _GRAMS.format(x="p_name"), _GRAMS.format(x="'small gizmo'")
_SIMILARITY = f"len(list_intersect({_A}, {_B})) / len(list_distinct(list_concat({_A}, {_B})))::DOUBLE"


@query("Q03_trigram_similarity", f"SELECT p_partkey, round({_SIMILARITY}, 6) AS similarity FROM part")
def q03(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(trigram_similarity(trigrams(F.col("p_name")), trigrams(F.lit("small gizmo"))), 6).alias("similarity"))


@query("Q04_trigram_match", f"SELECT p_partkey FROM part WHERE {_SIMILARITY} >= 0.3")
def q04(t: Tables) -> DataFrame:
    return t.part.where(trigram_similarity(trigrams(F.col("p_name")), trigrams(F.lit("small gizmo"))) >= Q.SIMILAR).select("p_partkey")


@query("Q05_text_or_similar", f"SELECT p_partkey FROM part WHERE {_SIMILARITY} >= 0.3 OR regexp_matches(' ' || lower(p_name) || ' ', '[^a-z0-9]blue[^a-z0-9]')")
def q05(t: Tables) -> DataFrame:
    near = trigram_similarity(trigrams(F.col("p_name")), trigrams(F.lit("small gizmo"))) >= Q.SIMILAR
    return t.part.where(near | Q.matches(Q.tokens(F.col("p_name")), "blue")).select("p_partkey")


_TITLE_GRAMS, _ASKED_GRAMS = _GRAMS.format(x="title"), _GRAMS.format(x="'platform manager'")
_TITLE_SIMILARITY = f"len(list_intersect({_TITLE_GRAMS}, {_ASKED_GRAMS})) / len(list_distinct(list_concat({_TITLE_GRAMS}, {_ASKED_GRAMS})))::DOUBLE"
_MANAGERS = f"{_has('platform')} AND {_has('manager')} OR {_TITLE_SIMILARITY} >= 0.3"


@query(
    "Q05_indexed",
    f"{WITH_POSTINGS}, titled AS (SELECT job_id AS doc_id, title, concat_ws(' ', title, text) AS text FROM postings), {_searched('titled', {'platform manager': _MANAGERS}, kept='doc_id, title')}",
)
def q05_indexed(t: Tables) -> DataFrame:
    """Postings whose title and text match, or whose title is similar, by postings of stems and of trigrams."""
    index = Index(t.spark, fresh_path(t.spark, "search-index"))
    index.apply(t.postings.select(F.col("job_id").alias("doc"), "title", "text"), 0)
    return index.matching_or_similar("platform manager").select(F.lit("platform manager").alias("query"), F.col("doc").alias("doc_id"))


@query(
    "search_explained",
    f"{_VIEW}SELECT job_id, title, source_id, coalesce(status, 'pending') AS status, score, ({_MODEL}) AS remote_policy, ({_SENIORITY}) AS seniority FROM seen WHERE source_id NOT IN ('src1', 'src2') AND job_id % 10 <> 0 AND job_id % 11 <> 0 ORDER BY score DESC NULLS LAST, published_at DESC NULLS LAST, job_id DESC LIMIT 50",
)
def search_explained(t: Tables) -> DataFrame:
    found = Q.search(_searchable(t), _followed(t), overlay(t), Q.JobFilters())
    return Q.page(Q.ordered(found), 50).select("job_id", "title", "source_id", F.coalesce("status", F.lit("pending")).alias("status"), "score", "remote_policy", "seniority")
