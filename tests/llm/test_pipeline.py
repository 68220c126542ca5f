"""The corpus pipeline against a plain version of its stages."""

from __future__ import annotations

import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from postlake.llm import language, pieces, toxicity


def shingles(text: str | None) -> set[bytes]:
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {b" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    return len(a & b) / len(a | b)


def slow_targets(sizes: dict[str, int]) -> dict[str, float]:
    names = sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed: dict[str, float] = {}
    while True:
        free = [s for s in names if s not in fixed]
        left, weights = sum(sizes.values()) - sum(fixed.values()), sum(weight[f] for f in free)
        over = [s for s in free if left * weight[s] / weights > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / weights for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stage(spark, out[-1][1], sf_dir).checkpoint()))
    return dict(out)


def test_stages_are_five_in_order(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "mixing", "pieces"]
    for name in ("toxicity", "language", "near_copies", "mixing"):
        assert staged[name].columns == staged["documents"].columns


def test_toxic_documents_go(spark, sf_dir, staged):
    model = toxicity.train(staged["documents"], toxicity.label_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    want = {d.doc_id for d in staged["documents"].collect() if model.severity(d.text) < toxicity.SEVERE}
    assert {d.doc_id for d in staged["toxicity"].collect()} == want < {d.doc_id for d in staged["documents"].collect()}


def test_unclear_languages_go(staged):
    languages = language.Languages(*language.train(staged["toxicity"].where(~language.held_out())))
    found = {d.doc_id: languages.predict(d.text) for d in staged["toxicity"].collect()}
    assert {d.doc_id for d in staged["language"].collect()} == {i for i, (lang, score) in found.items() if lang != "und" and score >= language.NARROW}
    assert staged["language"].count() >= 0.95 * staged["toxicity"].count()


def test_near_copies_go(staged):
    """Kept documents aren't alike; one that went was alike to a smaller one; the rest stays."""
    before = {d.doc_id: shingles(d.text) for d in staged["language"].collect()}
    kept = {d.doc_id for d in staged["near_copies"].collect()}
    gone = before.keys() - kept
    assert gone and kept <= before.keys()
    for i in kept:
        assert max([jaccard(before[i], before[j]) for j in kept if j < i], default=0.0) < 0.8
    for i in gone:
        assert max(jaccard(before[i], before[j]) for j in before if j != i) >= 0.8


def test_sources_are_mixed(staged):
    size = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    docs = staged["near_copies"].collect()
    mixed = staged["mixing"].collect()
    taken: Counter = Counter()
    for d in mixed:
        taken[d.source] += size(d)
    sizes: Counter = Counter()
    for d in docs:
        sizes[d.source] += size(d)
    assert max(Counter(d.doc_id for d in mixed).values()) <= 3
    for source, target in slow_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(3, 0.05 * target)
    assert {tuple(d) for d in mixed} <= {tuple(d) for d in docs}


def test_texts_are_encoded(staged):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = Counter((d.doc_id, tuple(library.encode(d.text))) for d in staged["mixing"].collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in staged["pieces"].collect()) == want


def test_run_equals_its_stages(spark, sf_dir, staged):
    key = lambda r: (r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids))
    assert Counter(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(key, staged["pieces"].collect()))


def test_odd_documents(spark, sf_dir, tmp_path):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "some words", None, None, None), (None, None, None, None, None), (10**9, "", "en", "src0", 0), (10**9, "", "en", "src0", 0)], base.schema)
    base.unionByName(odd).withColumn("ids", F.lit("mine")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50
    base.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(str(tmp_path / "empty" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
