from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from postlake.llm import language as L, toxicity as T

WORDS = {"en": "the of and to in is that for it with was on are by this be from".split(), "de": "der die und das nicht von sie ist des sich mit dem dass er es ein".split(), "xx": [f"zq{i}" for i in range(20)]}


def text(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ".", ","]) for _ in range(n))


def corpus(seed: int = 1, n: int = 240):
    rng = random.Random(seed)
    return [(i, text(rng, lang := rng.choice(list(WORDS)), rng.choice([8, 40, 200])), lang) for i in range(n)]


SCHEMA = "doc_id long, text string, lang string"


def test_languages_of_held_out_documents(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    got = L.identify(df.withColumn("held_out", L.held_out()), L.train(df.where(~L.held_out()))).where("held_out").collect()
    assert len(got) > 30
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_prediction_does_not_look_at_labels_or_ids(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    model = L.train(df)
    other = df.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", -F.col("doc_id"))
    assert {(r.text, r.lang_pred, r.score) for r in L.identify(df, model).collect()} == {(r.text, r.lang_pred, r.score) for r in L.identify(other, model).collect()}


def test_odd_texts_are_undetermined(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- 34"), (3, "12 -- 34"), (4, "the of and " * 20_000)], "doc_id long, text string")
    df = df.withColumn("score", F.lit("mine")).withColumn("_x", F.lit(1))
    model = L.train(spark.createDataFrame(corpus(), SCHEMA))
    got = sorted((r.doc_id, r.lang_pred, r.accepted) for r in L.identify(df, model).collect())
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (3, "und", False), (4, "en", True)]
    assert L.identify(df.limit(0), model).count() == 0
    nothing = L.train(spark.createDataFrame([(1, None, "en"), (2, "x", None), (None, "y", "en")], SCHEMA))
    assert nothing == ({}, []) and {r.lang_pred for r in L.identify(df, nothing).collect()} == {"und"}
    alone = L.train(spark.createDataFrame([(1, "the of", "en")], SCHEMA))
    assert L.Languages(*alone).predict("und") == ("en", 1.0)


def graded(seed: int, n: int = 1500):
    """Grades 0 to 3 that rise with the weights of marked words."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        marks = rng.choice([0, 0, 0, 1, 2, 3])
        words = [f"w{rng.randrange(60)}" for _ in range(30)] + rng.sample(["badx", "worsey", "worstz"], marks)
        rng.shuffle(words)
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        rows.append((i, " ".join(words), marks if rng.random() < 0.95 else rng.choice([0, 1, 2, 3])))
    return rows


def test_four_grades_share_their_weights(spark):
    df = spark.createDataFrame(graded(1), "doc_id long, text string, grade int")
    model = T.train(df, df)
    assert len(model.thresholds) == 3 and model.thresholds == sorted(model.thresholds)
    assert {"badx", "worsey", "worstz"} <= set(model.weights)
    held = graded(2)
    severity = np.array([model.severity(t) for _, t, _ in held])
    means = [severity[[g == k for *_, g in held]].mean() for k in range(4)]
    assert means == sorted(means) and means[0] < 0.6 and means[3] > 2.2
    got = {r.doc_id: r.severity for r in T.grade_documents(spark.createDataFrame(held, "doc_id long, text string, grade int"), model).collect()}
    assert got == {i: pytest.approx(s) for (i, *_), s in zip(held, severity)}


def test_newton_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 3)) < 0.5).astype(float)
    y = np.clip((x @ [2.0, -1.0, 0.5] + rng.logistic(size=400)).round(), 0, 2).astype(int)
    thresholds, weights = T.fit_ordinal(x, y, 3)

    def loss(p):
        up = 1 / (1 + np.exp(-(x @ p[2:])[:, None] + p[:2]))
        cdf = np.c_[np.ones(400), up, np.zeros(400)]
        return -np.log(cdf[np.arange(400), y] - cdf[np.arange(400), y + 1]).sum() + T.RIDGE / 2 * (p[2:] ** 2).sum()

    best = loss(np.r_[thresholds, weights])
    for step in rng.normal(size=(200, 5)) * 0.02:
        assert loss(np.r_[thresholds, weights] + step) >= best - 1e-6


def test_toxic_documents_of_the_tables_are_caught(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = T.train(docs, T.label_grades(labels.where(~held)))
    got = T.grade_documents(docs, model).join(labels.where(held), "doc_id").groupBy("toxic").agg(F.avg(F.col("rejected").cast("double")).alias("rejected")).collect()
    share = {r.toxic: r.rejected for r in got}
    assert share[1] >= 0.8 and share[0] <= 0.01


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "fine " * 30_000)], "doc_id long, text string").withColumn("severity", F.lit("mine")).withColumn("grade", F.lit("x"))
    model = T.Ordinal([1.0], {"bad": 3.0})
    got = T.grade_documents(df, model).collect()
    assert [r.rejected for r in got] == [False] * 4 and got[0].severity == 0.0
    assert T.grade_documents(df.limit(0), model).count() == 0
    for grades in ([], [(1, None)], [(1, 0), (2, 0)]):
        empty = T.train(df.drop("grade"), spark.createDataFrame(grades, "doc_id long, grade int"))
        assert empty == T.Ordinal() and empty.severity("bad") == 0.0


def test_letters_decide_what_is_undetermined():
    assert L.letters("½ ² ③ 12 _") == b"" and L.letters("é½") and L.letters("我") and L.letters("x²")


def test_dictionaries_are_full_of_long_texts(spark):
    rng = random.Random(7)
    word = lambda lang: lang + "".join(rng.choices("abcdefghij", k=6))
    long = [(i, " ".join(word("aa") for _ in range(11_000)), "aa") for i in range(3)]
    mixed = [(10 + i, " ".join(word("bb") for _ in range(30 if i else 40_000)), "bb") for i in range(5)]
    dictionaries, _ = L.train(spark.createDataFrame(long + mixed, SCHEMA))
    for data in dictionaries.values():
        assert 0.97 * L.DICTIONARY_BYTES < len(data) <= L.DICTIONARY_BYTES
    assert dictionaries["aa"].count(b" aa") > 25_000  # of 33,000
    for _, text, _ in mixed[1:]:
        assert L.letters(text) in dictionaries["bb"]  # short texts are whole, the long one has the rest


def test_texts_that_fit_are_whole(spark):
    docs = [(i, f"Text {chr(97 + i % 26)}{i} " + "words " * i * 3, "x") for i in range(150)]
    dictionaries, _ = L.train(spark.createDataFrame(docs, SCHEMA))
    assert len(dictionaries["x"]) == sum(len(L.letters(t)) for _, t, _ in docs) and all(L.letters(t) in dictionaries["x"] for _, t, _ in docs)


def test_shares():
    assert L.level_share([5, 5, 5], 100) == 5 and L.level_share([100, 100, 100], 30) == 10
    assert L.level_share([1, 2, 100, 100], 43) == 20 and L.level_share([], 5) == 0


def test_every_labelled_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "ALL_BYTES", 3000)
    df = spark.createDataFrame([(i, f"word{i} and more " * 9, f"l{i % 30}") for i in range(90)], SCHEMA)
    dictionaries, prior = L.train(df)
    assert len(dictionaries) == len(prior) == 30 and sum(map(len, dictionaries.values())) <= 3000


def test_language_query_against_a_plain_version(spark, sf_dir):
    """Each text in pieces, each piece compressed with each dictionary, the smallest sum wins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    dictionaries, prior = L.train(docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2"))
    coders = {n: [zstandard.ZstdCompressor(level=v, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for v in (L.LEVEL, L.FINE_LEVEL)] for n, d in dictionaries.items()}
    got = {r.doc_id: r for r in L.op9_language(spark, sf_dir).collect()}
    for d in docs.collect():
        r = got[d.doc_id]
        assert r.held_out == held(d.doc_id)
        words = "".join(c if c.isalnum() and not c.isdecimal() else " " for c in (d.text or "").lower()).split()
        if not any(c.isalpha() for w in words for c in w):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        data = f" {' '.join(words)} ".encode()
        for level in (0, 1):
            size = {n: sum(len(c[level].compress(data[i : i + L.PIECE])) for i in range(0, len(data), L.PIECE)) for n, c in coders.items()}
            first, second = sorted(size, key=lambda n: (size[n], prior.index(n)))[:2]
            if size[first] < size[second]:
                break
        assert (r.lang_pred, r.score) == (first, pytest.approx(1 - size[first] / size[second]))
    right = [r.lang_pred == d.lang for d in docs.collect() if (r := got[d.doc_id]).held_out and d.lang]
    assert np.mean(right) >= 0.97


def test_toxicity_query_against_a_plain_version(spark, sf_dir):
    """Words are counted, kept and fitted anew in plain Python; severities agree."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    words = lambda t: {w for w in "".join(c if c.isalnum() and not c.isdecimal() else " " for c in (t or "").lower()).split()}
    known = sorted(i for i in labels if docs.get(i) is not None)
    keys = {i: T.copy_keys(docs[i]) for i in known}
    kept: list[int] = []
    owner: dict = {}
    for i in known:
        met = [owner[x] for x in enumerate(keys[i]) if x in owner]
        if max((met.count(m) for m in met), default=0) < T.COPY:
            kept.append(i)
            for x in enumerate(keys[i]):
                owner.setdefault(x, i)
    assert len(kept) > 0.8 * len(known)  # few labelled documents are near copies of each other
    y = np.array([labels[i] for i in kept])
    held = [words(docs[i]) for i in kept]
    strength = {}
    for w in set().union(*held):
        has = np.array([w in h for h in held])
        n = has.sum()
        error = abs((y[has] - y.mean()).sum()) / math.sqrt(max(1e-12, y.var() * n * (1 - n / (len(y) + 1))))
        if n >= T.LEAST_DOCS and round(error, 9) >= T.LEAST_ERRORS:
            strength[w] = round(error, 9)
    chosen = sorted(strength, key=lambda w: (-strength[w], w))[: T.MOST]
    x = np.array([[float(w in h) for w in chosen] for h in held]).reshape(len(held), len(chosen))
    weights, threshold = np.zeros(len(chosen)), -math.log(y.mean() / (1 - y.mean()))
    for _ in range(60_000):  # plain gradient steps on the same penalised likelihood
        p = 1 / (1 + np.exp(-(x @ weights - threshold)))
        weights -= 0.05 * (x.T @ (p - y) + T.RIDGE * weights)
        threshold -= 0.05 * -(p - y).sum()
    for r in T.op8_toxicity(spark, sf_dir).collect():
        at = sum(weights[j] for j, w in enumerate(chosen) if w in words(docs[r.doc_id])) - threshold
        want = 1 / (1 + math.exp(-at)) if docs[r.doc_id] else 0.0
        assert r.severity == pytest.approx(want, abs=0.02) and r.rejected == (r.severity >= T.SEVERE)


def test_unlike_documents_that_share_a_passage_are_no_copies():
    rng = random.Random(3)
    passage = " ".join(rng.choices("abcdefgh", k=20))
    own = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=5)) for _ in range(n))
    base = own(80)
    texts = [f"{own(80)} {passage}" for _ in range(20)] + [base, base + " more", base.replace(" ", "  ")]
    assert T.first_of_copies(np.array([T.copy_keys(t) for t in texts])).tolist() == list(range(21))
