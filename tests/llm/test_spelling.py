"""Variants against all pairs of words, and the vocabulary against plain counting."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlake.llm import spelling as S


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(words: dict[str, int]):
    forms, out = {}, []
    for w, n in words.items():
        others = sorted((-words[x], x) for x in words if near(w, x))
        forms[w] = (len(others), others[0][1] if others and -others[0][0] >= 5 * n else None)
    for w, n in words.items():
        root, form = w, forms[w][1]
        while forms[root][1]:
            root = forms[root][1]
        out.append((w, form, root, n, forms[w][0], words[form] if form else None))
    return sorted(out)


def found(spark, words):
    return sorted(map(tuple, S.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)).collect()))


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefgh"])
def test_against_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): 5 ** rng.randint(0, 6) for _ in range(250)}
    assert found(spark, words) == plain(words)


def test_chains_ties_and_odd_words(spark, monkeypatch):
    chain = {"abcdef"[: i + 1] + "z" * i: 5**i for i in range(6)} | {"q" * i: 6**i for i in range(1, 25)}
    words = chain | {"tie": 1, "tia": 50, "tib": 50, "": 7, "é": 40, "x" * 3000: 5, "x" * 2999 + "y": 500}
    assert found(spark, words) == plain(words)
    monkeypatch.setattr(S, "TOGETHER", 10)
    assert found(spark, words) == plain(words)
    assert found(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]
    assert S.variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert S.variants(spark.createDataFrame([(None, 3)], "word string, n long")).collect() == []
    with pytest.raises(ValueError):
        S.variants(spark.createDataFrame([], "word string, n long"), times=1)


def test_vocabulary(spark):
    rows = [(i, f"Straße{i % 3} WÖRTER words Letters-letters ÉCOLE ×÷ {'variant ' * (i % 4)}") for i in range(400)] + [(None, "letters letters"), (9, None), (9, ""), (10, "z" * 20_000)] * 6
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).repartition(7)
    got = dict(map(tuple, S.vocabulary(df).collect()))
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert "z" * 20_000 in got and "wÖrter" in got
    assert S.vocabulary(df.limit(0)).collect() == []
