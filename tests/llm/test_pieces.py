from __future__ import annotations

import random
import struct

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postlake.llm import pieces as P


@pytest.fixture(scope="module")
def model():
    return P.Model(P.read_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def check(model, library, text: str) -> None:
    ids = model.encode(text).tolist()
    assert ids == library.encode(text)
    assert model.decode(ids) == library.decode(ids)
    if P.SPACE not in text:
        assert model.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("abcdeinorst  \n.,THE"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_equals_the_library(model, library, text):
    check(model, library, text)


@pytest.mark.parametrize("text", ["", " ", "   ", "  a  b ", " " * 200 + "x", "a" * 500, "日本語 テキスト 😀🏽", "\x00\t\n", "▁a▁ b", "Hello world.\nNext line", "é" * 50 + "é"])
def test_odd_texts(model, library, text):
    check(model, library, text)


def test_documents_equal_the_library(spark, model, library, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = P.encode_documents(docs, P.read_model()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode(r.text) and r.n_tokens == len(r.ids)


def handmade(pieces: list[tuple[str, float, int]], kind: int, byte_fallback: bool = False) -> bytes:
    """A model file by hand."""

    def field(number: int, value: bytes | int | float) -> bytes:
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        if isinstance(value, int):
            return bytes([number << 3, value]) if number < 16 else bytes([(number << 3 & 127) | 128, number >> 4, value])
        return bytes([number << 3 | 2, len(value)]) + value

    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    return out + field(2, field(3, kind) + field(35, int(byte_fallback))) + field(3, field(3, 1) + field(4, 0))


def test_unigram_scores_equal_all_segmentations():
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(25)} | {"a", "b"})
    pieces = [("<unk>", 0.0, 2), *[(p, -rng.uniform(1, 9), 1) for p in names]]
    m = P.Model(handmade(pieces, P.UNIGRAM))
    assert not m.by_word

    def best(text: str) -> float:
        top = [0.0]
        for end in range(1, len(text) + 1):
            options = [top[end - len(p)] + s for p, s, k in pieces[1:] if text[:end].endswith(p)]
            top.append(max([*options, top[end - 1] + m.least]))
        return top[-1]

    for _ in range(200):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))
        plain = m.normalise(text)
        got = m.segments(plain)
        assert "".join(got) == plain
        assert sum(m.scores[m.ids[x]] if x in m.ids else m.least for x in got) == pytest.approx(best(plain), abs=1e-4)


def test_unigram_ids_equal_the_library(tmp_path):
    names = [("▁the", -2.0), ("▁", -3.0), ("the", -4.0), ("t", -6.0), ("h", -6.1), ("e", -5.5), ("he", -4.4), ("n", -6.2), ("▁then", -5.1)]
    data = handmade([("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(p, s, 1) for p, s in names]], P.UNIGRAM)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    m = P.Model(data)
    for text in ("then the hen", "the", "xthe", "then xyz the", "hhh"):
        assert m.encode(text).tolist() == library.encode(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "a " * 50_000)], "doc_id long, text string").withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(0))
    got = sorted((r.doc_id, r.n_tokens) for r in P.encode_documents(df, P.read_model()).select("doc_id", F.coalesce("n_tokens", F.lit(-1)).alias("n_tokens")).collect())
    assert got[:3] == [(1, -1), (2, 0), (2, 0)] and got[3][1] >= 50_000
    back = P.encode_documents(df, P.read_model()).select("text", P.decoder(P.read_model())("ids").alias("back"))
    assert back.where(~F.col("text").eqNullSafe(F.col("back"))).count() == 0
    assert P.encode_documents(df.limit(0), P.read_model()).count() == 0


def test_models_beyond_these_are_refused():
    with pytest.raises(ValueError):
        P.Model(handmade([("<unk>", 0.0, 2), ("x", 0.0, P.USER_DEFINED)], P.BPE))
