from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from postlake.functions.stems import stem
from postlake.functions.text import trigram_similarity, trigrams
from postlake.operators import catalog as C, dedupe as D, rules as R, scope as S, score as K, search as Q, states as T

POLICY = R.Policy()


def test_scopes(spark):
    df = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, workspace_id int")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(S.scoped(df, S.NONE)) == []
    assert ids(S.scoped(df, S.SYSTEM)) == [1, 2, 3]
    assert ids(S.scoped(df, S.Scope(workspace=7))) == [1]
    assert ids(S.scoped(df, S.Scope(workspace=7), shared_null=True)) == [1, 3]
    with pytest.raises(ValueError):
        S.Scope(system=True, workspace=7)
    with pytest.raises(Exception, match="outside the scope"):
        S.checked_write(df, S.Scope(workspace=7)).collect()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("5+ years of Python experience", (5.0, None)),
        ("3-5 years of experience", (3.0, 5.0)),
        ("2 years of Go experience and 6 years of Java experience", (6.0, None)),
        ("Nice to have: 8 years of Rust experience", (None, None)),
        ("at least 4 years", (4.0, None)),
        ("40 years of experience", (None, None)),
        ("Requirements: 3 years of experience. Preferred: 9 years of experience", (3.0, None)),
        (None, (None, None)),
    ],
)
def test_experience(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(R.required_experience(F.col("t")).alias("y")).first().y
    assert tuple(None if x is None or x != x else x for x in row) == want


def test_rules_are_three_valued(spark):
    rows = [
        ("remote", "India", "You must reside in the United States."),
        ("unknown", None, "Nothing said."),
        ("remote", "Worldwide", "5 years of experience. Working hours in CET."),
        ("onsite", "Berlin", ""),
    ]
    df = spark.createDataFrame(rows, "remote_policy string, location string, description string")
    got = [({r.rule: r.outcome for r in x.rules}, x.eligibility.status) for x in R.evaluate(df, POLICY).collect()]
    assert got[0][0]["excluded_region"] == "fail" and got[0][1] == "ineligible"
    assert set(got[1][0].values()) == {"unknown"} and got[1][1] == "eligible"
    assert got[2][0] == {"work_model": "pass", "excluded_region": "unknown", "location": "pass", "experience": "pass", "timezone": "pass"}
    assert got[3][0]["location"] == got[3][0]["work_model"] == "fail"


def test_facts_resolve_unknown_rules_only(spark):
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(o).alias("outcome"), F.lit("").alias("evidence"), F.lit("deterministic").alias("source")) for n, o in zip(R.RULES, ("fail", "unknown", "unknown", "pass", "unknown"))])
    none = F.array().cast("array<string>")

    def merged(confidence):
        facts = F.struct(F.lit("remote").alias("remote_policy"), F.array(F.lit("India")).alias("permitted_countries"), none.alias("excluded_countries"), F.lit(20.0).alias("minimum_experience"), F.lit(None).cast("double").alias("maximum_experience"), none.alias("timezone_requirements"), F.lit(None).cast("string").alias("residency_requirement"), F.lit(confidence).alias("confidence"))
        return [r.outcome for r in spark.range(1).select(R.apply_intelligence(rules, facts, POLICY)).first()[0]]

    assert merged(0.9) == ["fail", "pass", "pass", "pass", "unknown"]
    assert merged(0.3) == ["fail", "unknown", "unknown", "pass", "unknown"]


def test_cosine(spark):
    one = lambda a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(K.cosine(F.col("a"), F.col("b"))).first()[0]
    assert one([1e300, 0.0], [1e300, 0.0]) == 1.0
    assert one([0.0, 0.0], [1.0, 2.0]) == 0.0
    assert one(None, [1.0]) is None
    with pytest.raises(Exception, match="equal length"):
        one([1.0], [1.0, 2.0])


def test_scores_share_out_missing_weights(spark):
    row = spark.range(1).select(K.total_score({"skill_match": F.lit(None).cast("double"), "freshness": F.lit(1.0), "role_similarity": F.lit(0.5)})).first()[0]
    assert row.final_score == pytest.approx((0.10 * 1 + 0.15 * 0.5) / 0.25, abs=1e-4)
    assert [c.weight for c in row.components] == [0.0, 0.4, 0.6]


@pytest.mark.parametrize(
    ("outcome", "current", "failures", "retry", "want"),
    [("new_jobs", 900, 0, None, (60, 60, False)), ("no_change", 300, 0, None, (600, 600, False)), ("no_change", 3600, 0, None, (3600, 3600, False)), ("rate_limited", 900, 1, None, (1800, 1800, False)), ("rate_limited", 60, 1, 5000.0, (120, 5000, False)), ("failed", 300, 3, None, (300, 1200, False)), ("failed", 3600, 4, None, (3600, 14400, False)), ("failed", 60, 5, None, (3600, 21600, True))],
)
def test_polls(spark, outcome, current, failures, retry, want):
    row = spark.range(1).select(T.next_poll(F.lit(outcome), F.lit(current), F.lit(60), F.lit(3600), F.lit(failures), F.lit(retry).cast("double"))).first()[0]
    assert tuple(row) == want


@pytest.mark.parametrize(("query", "want"), [("python engineer", [1]), ('"data engineer"', [2]), ("python or data", [1, 2]), ("engineer -data", [1]), ("the", []), ("painting", [3])])
def test_web_search(spark, query, want):
    df = spark.createDataFrame([(1, "Python engineers"), (2, "A data engineer"), (3, "Paints")], "id int, t string")
    assert [r.id for r in df.where(Q.matches(Q.tokens(F.col("t")), query)).orderBy("id").collect()] == want


def test_phrases_are_whole_words_in_a_row(spark):
    df = spark.createDataFrame([(1, "senior data engineers"), (2, "metadata engineering"), (3, "engineer of data"), (4, None), (5, "")], "int_id int, t string")
    assert [r.int_id for r in df.where(Q.matches(Q.tokens(F.col("t")), '"data engineer"')).collect()] == [1]


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ("consign consigned consigning consignment", "consign"), ("consist consisted consistency consistent consisting", "consist"), ("knot knots knotted", "knot"), ("run runs running", "run"),
        ("generate generates generated generating", "generat"), ("general generally", "general"), ("hope hoped hoping hopes", "hope"), ("happy happiness", "happi"), ("ties", "tie"), ("cries cried", "cri"),
        ("relational", "relat"), ("rationalization", "ration"), ("conditional", "condit"), ("agreed", "agre"), ("feed", "feed"), ("luxuriating", "luxuri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"),
        ("say", "say"), ("by", "by"), ("cry", "cri"), ("youth", "youth"), ("boy", "boy"), ("boyish", "boyish"), ("fluently", "fluentli"), ("adoption", "adopt"), ("controlled", "control"), ("skies sky", "sky"),
        ("herring herrings", "herring"), ("succeed succeeds", "succeed"), ("communism", "communism"), ("electricity electrical", "electr"), ("beds", "bed"), ("bee", "bee"), ("knightly", "knight"), ("7", "7"),
    ],
)
def test_english_stems(words, want):
    assert {stem(w) for w in words.split()} == {want}


def listing(spark, rows, source="s"):
    df = spark.createDataFrame([(i, source, e, h, f"fp{h}", f"https://{source}/{e}", None, n) for n, (i, e, h) in enumerate(rows)], "job_id long, source_id string, external_id string, content_hash string, fingerprint string, canonical_url string, published_at timestamp, position int")
    return df


def empty_catalogue(spark):
    return spark.createDataFrame([], "job_id long, source_id string, external_id string, content_hash string, fingerprint string, canonical_url string, published_at timestamp, version int, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp, duplicate_of long, state string")


def test_a_listing_replayed_edited_and_shrunk(spark):
    now = [F.lit(datetime.datetime(2024, 1, d)) for d in (1, 2, 3, 4)]
    count = lambda applied: {k: v for k, v in C.counters(applied).first().asDict().items() if v and k != "source_id"}
    first = C.apply_listing(empty_catalogue(spark), listing(spark, [(1, "a", "x"), (2, "b", "y"), (3, "b", "z")]), now[0]).checkpoint()
    assert count(first) == {"new": 2}
    assert {r.content_hash for r in first.collect()} == {"x", "z"}  # of a repeated id the last counts
    base = first.drop("change")
    again = C.apply_listing(base, listing(spark, [(1, "a", "x"), (3, "b", "z")]), now[1])
    assert count(again) == {"unchanged": 2}
    edited = C.apply_listing(base, listing(spark, [(1, "a", "X")]), now[2]).checkpoint()
    assert count(edited) == {"updated": 1, "closed": 1}
    row = edited.where("external_id = 'a'").first()
    assert row.version == 2 and row.published_at == datetime.datetime(2024, 1, 1)
    reopened = C.apply_listing(edited.drop("change"), listing(spark, [(1, "a", "X"), (3, "b", "z")]), now[3]).where("external_id = 'b'").first()
    assert reopened.closed_at is None and reopened.state == "closed"  # touching reopens, but leaves the state
    mirror = C.apply_listing(base, listing(spark, [(11, "q", "x")], "mirror"), now[1]).where("source_id = 'mirror'").first()
    assert mirror.duplicate_of == 1 and mirror.state == "duplicate"


def test_a_listing_that_shrinks_too_far_closes_nothing(spark):
    many = [(i, f"e{i}", str(i)) for i in range(20)]
    base = C.apply_listing(empty_catalogue(spark), listing(spark, many), F.lit(datetime.datetime(2024, 1, 1))).drop("change").checkpoint()
    assert C.apply_listing(base, listing(spark, many[:3]), F.lit(datetime.datetime(2024, 1, 2))).where("change = 'closed'").count() == 0
    assert C.apply_listing(base, listing(spark, many[:12]), F.lit(datetime.datetime(2024, 1, 2))).where("change = 'closed'").count() == 8


def test_similar_pairs_against_all_pairs(spark):
    names = ["data engineer", "data engineers", "senior data engineer", "cook", "cooks", "date engine"]
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(names)], "id int, block int, t string")
    from postlake.functions.text import trigram_similarity, trigrams

    a, b = df.alias("a"), df.alias("b")
    all_pairs = a.crossJoin(b).where("a.id <> b.id").where(trigram_similarity(trigrams(F.col("a.t")), trigrams(F.col("b.t"))) >= 0.5)
    assert {(r.l_id, r.r_id) for r in D.similar_pairs(df, df, "t", ["block"], 0.5).collect()} == {tuple(r) for r in all_pairs.select("a.id", "b.id").collect()}


def test_top_similar_of_copies_against_all_pairs(spark):
    names = [f"Customer#{i:09d}" for i in (0, 1, 12, 13, 123, 124, 1230, 4567, 4568, 99_999)] + ["", None]
    df = spark.createDataFrame([(100 * c + i, i % 2, x) for c in range(4) for i, x in enumerate(names) if c < 1 or i > 5], "id int, block int, t string")
    grams = df.where("t <> ''").withColumn("g", trigrams(F.col("t")))
    both = grams.alias("a").join(grams.alias("b"), F.expr("a.block = b.block AND a.id <> b.id")).select(F.col("a.id").alias("l"), F.col("b.id").alias("r"), trigram_similarity(F.col("a.g"), F.col("b.g")).alias("s"))
    want = {}
    for x in sorted(both.where("s >= 0.6").collect(), key=lambda x: (x.l, -x.s, x.r)):
        want.setdefault(x.l, []).append((x.r, x.s))
    got = {}
    for x in D.top_similar(df, df, "t", ["block"], 0.6, 3).orderBy("l_id", "rank").collect():
        got.setdefault(x.l_id, []).append((x.r_id, x.similarity))
    assert got == {k: v[:3] for k, v in want.items()}


def test_copies_and_common_trigrams_make_no_candidates(spark):
    def classes(copies):
        rows = [(1000 * c + i, 0, f"Customer#{i:09d}") for c in range(copies) for i in range(200)]
        df = spark.createDataFrame(rows, "id int, block int, t string")
        return D._classes(D._sides(df, df, "t", ["block"]), ["block"])[1]

    once, often = classes(1), classes(5)
    assert once.count() == often.count() == 200
    assert D._similar_classes(once, once, ["block"], 0.6).count() == D._similar_classes(often, often, ["block"], 0.6).count()


def test_similar_pairs_broadcast_no_trigrams(spark):
    df = spark.range(20).selectExpr("id", "0 AS block", "concat('Customer#', id) AS t")  # small enough for the planner to broadcast names
    pairs = D.similar_pairs(df, df, "t", ["block"], 0.85)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().sparkPlan().toString()


def test_similar_pairs_broadcast_nothing_that_grows(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "0 AS block", "concat('Customer#', lpad(id * 7919 % 1000000, 9, '0')) AS t")
    plans = []

    def kept(x, name, stored=D.stored):
        out = stored(x, name)
        plans.append(x)
        return out

    monkeypatch.setattr(D, "stored", kept)
    plans.append(D.similar_pairs(df, df, "t", ["block"], 0.85))
    sent = []
    for x in plans:
        todo = [x._jdf.queryExecution().sparkPlan()]
        while todo:
            plan = todo.pop()
            children = [plan.children().apply(i) for i in range(plan.children().size())]
            todo += children
            if plan.nodeName() == "BroadcastHashJoin":
                sent.append(plan.toString().splitlines()[0])
    assert len(plans) == 6 and len(sent) == 1 and "gram#" in sent[0]  # the numbers of trigrams, 50,653 at most


@pytest.mark.parametrize("least", [0.3, 0.6, 0.7, 0.85, 1.0])
def test_similar_pairs_of_sets_that_miss_few_or_many(spark, least):
    from postlake.functions.text import trigram_similarity, trigrams

    names = [f"Customer#{i * 7919 % 1_000_000:09d}" for i in range(60)] + [f"Customer#{i:09d}" for i in range(60)] + ["a", "a b", "b a", "ab", "", None, "senior data engineer in berlin", "senior data engineers in berlin", "data engineer in berlin"]
    df = spark.createDataFrame([(i, i % 2, n) for i, n in enumerate(names)], "id int, block int, t string")
    grams = df.where("t <> ''").withColumn("g", trigrams(F.col("t")))
    both = grams.alias("a").join(grams.alias("b"), F.expr("a.block = b.block AND a.id <> b.id"))
    want = both.select("a.id", "b.id", trigram_similarity(F.col("a.g"), F.col("b.g")).alias("s")).where(F.col("s") >= least).collect()
    assert sorted(map(tuple, D.similar_pairs(df, df, "t", ["block"], least).collect())) == sorted(map(tuple, want))


def test_candidates_of_different_names_grow_with_the_table(spark):
    def candidates(n):
        df = spark.range(n).selectExpr("id", "0 AS block", "concat('Customer#', lpad(id * 7919 % 1000000, 9, '0')) AS t")
        classes = D._classes(D._sides(df, df, "t", ["block"]), ["block"])[1]
        return D._met(classes, classes, ["block"], 0.85).count()

    assert candidates(8000) < 8 * 8000


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_nearest_vectors_against_all_pairs(spark, monkeypatch, spread):
    import numpy as np

    from postlake.operators import nearest as N

    monkeypatch.setattr(N, "FIRST", 1)
    monkeypatch.setattr(N, "TASK_ROWS", 60)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + spread * rng.normal(size=8)).round(3).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)] + [(500, [0.0] * 8), (501, None), (None, [1.0] * 8)]
    got = N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 7).collect()
    kept = [(i, v) for i, v in rows if i is not None and v]
    unit = np.array([np.array(v) / max(np.linalg.norm(v), 1e-300) for _, v in kept])
    for at, (i, _) in enumerate(kept):
        if i % 10 == 0:
            s = unit @ unit[at]
            want = sorted((-round(x, 9), j) for x, (j, _) in zip(s, kept) if j != i)[:7]
            mine = sorted((-round(r.similarity, 9), r.vec_id) for r in got if r.query_id == i)
            assert [x for x, _ in mine] == pytest.approx([x for x, _ in want], abs=1e-8)
            assert spread < 1 or [j for _, j in mine] == [j for _, j in want]
    assert N.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True), 3).collect() == []


def test_places_of_close_scores_and_many_nulls(spark):
    from postlake.operators.stored import numbered

    rows = [(i, None if i % 3 == 0 else 0.56 + (i % 7) * 0.001, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, score double, day int").repartition(6)
    got = {r.id: r.place for r in numbered(df, [F.desc_nulls_last("score"), F.desc_nulls_last("day"), F.desc("id")]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), -r[2], -r[0]))
    assert got == {r[0]: n for n, r in enumerate(want, 1)}
    assert numbered(df.limit(0), [F.col("id")]).collect() == []


def test_fan_out_of_one_file_is_dealt_to_many_tasks(spark, sf_dir):
    from postlake.plans.registry import QUERIES

    plan = QUERIES["J08_fan_out"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "s_part" in plan.split("SortMergeJoin")[1].splitlines()[0]


def _fan_out(spark, tmp_path, customers, suppliers):
    from postlake.plans.registry import QUERIES

    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    suppliers.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    return QUERIES["J08_fan_out"](spark, str(tmp_path))


def test_a_written_fan_out_stays_smaller_than_its_rows(spark, tmp_path):
    customers, suppliers = spark.range(1280).selectExpr("id AS c_custkey", "1 AS c_nationkey"), spark.range(12_000).selectExpr("id AS s_suppkey", "1 AS s_nationkey")
    _fan_out(spark, tmp_path, customers, suppliers).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1280 * 9000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1280 * 9000 * 0.6


def test_fan_out_of_odd_keys_as_in_sql(spark, tmp_path):
    import duckdb

    from postlake.plans.registry import ORACLES

    customers = spark.createDataFrame([(i % 700 if i % 50 else None, i % 3 if i % 7 else None) for i in range(900)], "c_custkey long, c_nationkey int")
    suppliers = spark.createDataFrame([(i % 20 if i % 9 else None, i % 4 if i % 5 else None) for i in range(40)], "s_suppkey long, s_nationkey int")
    got = _fan_out(spark, tmp_path, customers, suppliers).collect()
    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(ORACLES["J08_fan_out"]).fetchall()
    assert any(c is None for c, _ in want) and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("least", [0.2, 0.6, 1.0])
def test_most_similar_sets_against_all_pairs(least):
    import numpy as np
    import pyarrow as pa

    from postlake.operators.near_sets import most_similar

    rng = np.random.default_rng(7)
    sets = [set(range(k)) | set(rng.choice(60, rng.integers(0, 12)).tolist()) | {1000 + i % 9} for i, k in enumerate(rng.integers(0, 90, 300).tolist())]
    sets += [set(range(5000, 5300)), set(range(5000, 5290)), {7}, {7}]
    left, right = (pa.table({"g": pa.array([sorted(x) for x in part], pa.list_(pa.int64()))}) for part in (sets[100:], sets))
    got = most_similar(left, right, least, 5)
    want = []
    for i, a in enumerate(sets[100:]):
        near = sorted((-len(a & b) / len(a | b), j) for j, b in enumerate(sets) if len(a & b) / len(a | b) >= least)
        want += [(i, j, -x) for x, j in near[:5]]
    assert sorted(zip(*(got[c].to_pylist() for c in ("l", "r", "similarity"))), key=lambda x: (x[0], -x[2], x[1])) == want
    assert most_similar(left.slice(0, 0), right, least, 5).num_rows == most_similar(left, right.slice(0, 0), least, 5).num_rows == 0


def test_top_similar_of_different_names_makes_no_rows_of_pairs(spark, monkeypatch):
    def made(*args):
        raise AssertionError("pairs of names become rows")

    monkeypatch.setattr(D, "_met", made)
    monkeypatch.setattr(D, "_LEFT", 90, raising=False)
    monkeypatch.setattr(D, "_RIGHT", 120, raising=False)
    names = {i: f"Customer#{i * 7919 % 1_000_000:09d}" for i in range(600)} | {600 + i: f"Customer#{i:09d}" for i in range(8)} | {700 + i: "Customer#000000003" for i in range(6)}
    right = spark.createDataFrame([(i, i % 2 if i % 50 else None, x) for i, x in names.items()], "id long, block int, t string")
    for left in (right, right.where("id % 3 = 0")):
        both = [x.withColumn("g", trigrams(F.col("t"))) for x in (left, right)]
        pairs = both[0].alias("a").join(both[1].alias("b"), F.expr("a.block = b.block AND a.id <> b.id")).select("a.id", F.col("b.id").alias("r"), trigram_similarity(F.col("a.g"), F.col("b.g")).alias("s"))
        want = {}
        for x in sorted(pairs.where("s >= 0.6").collect(), key=lambda x: (x.id, -x.s, x.r)):
            want.setdefault(x.id, []).append((x.r, x.s))
        got = {}
        for x in D.top_similar(left, right, "t", ["block"], 0.6, 4).orderBy("l_id", "rank").collect():
            got.setdefault(x.l_id, []).append((x.r_id, x.similarity))
        assert got == {k: v[:4] for k, v in want.items()}
