"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 < 1 < ... are predicted from the set of words of a text. One weight per word is shared
by all thresholds: P(grade >= k) = sigmoid(w.x - theta_k) with rising theta_k, and the expected severity
is the sum of these over k. Words are screened by how far the mean grade of the documents that hold
them lies from the overall mean, so the model stays sparse; it's then fitted by Newton's method.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from postlake.llm._shared import stored, table, text_batches

_WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents that the fit uses at most, those with the smallest hashes of doc_id.
SAMPLE = 12_000
#: A word needs this many sample documents and this many standard errors between mean grades; the strongest MOST stay.
LEAST_DOCS, LEAST_ERRORS, MOST = 5, 5.0, 512
RIDGE = 0.05
#: Minimum hashes of a sample document, and how many of them a near copy shares with one earlier document.
KEYS, COPY = 16, 10
#: Documents whose expected severity is at least this are rejected.
SEVERE = 0.3


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def copy_keys(text: str, n: int = KEYS) -> list[int]:
    """Minima of ``n`` hashes over three-word shingles; two documents share about as many as their shingles are alike."""
    found = _WORD.findall(text.lower())
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(found[i : i + 3])) for i in range(max(1, len(found) - 2))], np.uint64)
    factors = np.random.default_rng(n).integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return [int((hashes * m).min() >> np.uint64(1)) for m in factors]


def first_of_copies(keys: np.ndarray) -> np.ndarray:
    """Rows of ``keys`` that share fewer than ``COPY`` keys with each earlier row that stays."""
    owner: dict[tuple[int, int], int] = {}
    out = []
    for i, own in enumerate(keys.tolist()):
        met = [owner[x] for x in enumerate(own) if x in owner]
        if met and max(map(met.count, set(met))) >= COPY:
            continue
        out.append(i)
        for x in enumerate(own):
            owner.setdefault(x, i)
    return np.array(out, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """A fitted model: thresholds in rising order and a weight per word."""

    thresholds: list[float] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)

    def severity(self, text: str | None) -> float:
        """Expected grade, 0 for a null or empty text or without a model."""
        if not text or not self.thresholds:
            return 0.0
        at = sum(self.weights[x] for x in sorted(self.weights.keys() & words(text)))
        return float(_sigmoid(at - np.array(self.thresholds)).sum())


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int, ridge: float = RIDGE, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, weights) of the ridge-penalised cumulative-link model, by damped Newton steps.

    Thresholds start at the logits of the grades' shares; a step that would break their order or raise
    the loss is halved.
    """
    n, d = x.shape
    k = n_grades - 1
    at_least = np.clip([(grades >= i + 1).mean() for i in range(k)], 1e-6, 1 - 1e-6)
    p = np.r_[-np.log(at_least / (1 - at_least)), np.zeros(d)]
    p[:k] += np.arange(k) * 1e-6

    def loss(p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = x @ p[k:]
        up = np.c_[np.ones(n), _sigmoid(s[:, None] - p[:k]), np.zeros(n)]
        prob = np.maximum(np.take_along_axis(up, grades[:, None], 1) - np.take_along_axis(up, grades[:, None] + 1, 1), 1e-12)[:, 0]
        return float(-np.log(prob).sum() + ridge / 2 * (p[k:] ** 2).sum()), up, prob

    now, up, prob = loss(p)
    for _ in range(rounds):
        slope = up * (1 - up)
        low, high = np.take_along_axis(slope, grades[:, None], 1)[:, 0], np.take_along_axis(slope, grades[:, None] + 1, 1)[:, 0]
        ds = (low - high) / prob
        curve = slope * (1 - 2 * up)
        low2, high2 = np.take_along_axis(curve, grades[:, None], 1)[:, 0], np.take_along_axis(curve, grades[:, None] + 1, 1)[:, 0]
        h = np.maximum(ds**2 - (low2 - high2) / prob, 1e-9)
        grad, hess = np.empty(k + d), np.zeros((k + d, k + d))
        grad[k:] = -x.T @ ds + ridge * p[k:]
        hess[k:, k:] = (x.T * h) @ x + ridge * np.eye(d)
        for i in range(k):
            is_low, is_high = grades == i + 1, grades == i
            grad[i] = (low[is_low] / prob[is_low]).sum() - (high[is_high] / prob[is_high]).sum()
            di = np.where(is_low, low / prob, 0) - np.where(is_high, high / prob, 0)
            d2 = np.where(is_low, -low2 / prob, 0) + np.where(is_high, high2 / prob, 0)
            cross = di * -ds - np.where(is_low, -low2 / prob, 0) - np.where(is_high, high2 / prob, 0)
            hess[i, k:] = hess[k:, i] = x.T @ cross
            hess[i, i] = (di**2 + d2).sum()
            for j in range(i):
                dj = np.where(grades == j + 1, low / prob, 0) - np.where(grades == j, high / prob, 0)
                hess[i, j] = hess[j, i] = (di * dj).sum()
        values, vectors = np.linalg.eigh(hess)
        step = vectors @ ((vectors.T @ grad) / np.maximum(np.abs(values), 1e-6))
        size = 1.0
        while size > 1e-8:
            new = p - size * step
            if (np.diff(new[:k]) > 0).all() and (tried := loss(new))[0] < now:
                break
            size /= 2
        else:
            break
        done = now - tried[0] < 1e-9 * max(1.0, now)
        p, (now, up, prob) = new, tried
        if done:
            break
    return p[:k], p[k:]


def train(docs: DataFrame, grades: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade") -> Ordinal:
    """The model of graded documents; ``grades`` has doc_id and an integer grade from 0.

    At most ``SAMPLE`` graded documents are used; of near copies among them one counts. Words are counted in Spark,
    and the driver gets the sample's keys and grades, the words that are kept, and which document holds
    which of them. Null grades, ids and texts take no part, the largest grade of a repeated id
    counts. Without two grades the model is empty and every severity is 0.
    """
    text_batches(docs.sparkSession)
    graded = grades.where(F.col(grade).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(grade).cast("int").alias("grade"))
    chosen = stored(graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "toxicity-sample")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "words": [sorted(words(x)) for x in pdf["text"]], "keys": [copy_keys(x) for x in pdf["text"]]})

    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    got = stored(sample.select("doc_id", "grade", "text").mapInPandas(features, "doc_id long, grade int, words array<string>, keys array<long>").withColumn("row", F.monotonically_increasing_id()), "toxicity-features")
    # of rows that repeat a sampled doc_id the one with the smallest keys counts, so SAMPLE bounds what comes to the driver
    heads = got.groupBy("doc_id").agg(F.min(F.struct("keys", "row")).alias("x"), F.first("grade").alias("grade")).select("doc_id", "x.row", "x.keys", "grade").orderBy("doc_id").toPandas()
    if heads["grade"].nunique() < 2:
        return Ordinal()
    heads = heads.iloc[first_of_copies(np.stack(heads["keys"].to_numpy()))]
    y, n = heads["grade"].to_numpy().astype(int), len(heads)
    if y.min() == y.max():
        return Ordinal()
    own = docs.sparkSession.createDataFrame(pd.DataFrame({"row": heads["row"].to_numpy(), "at": np.arange(n)}))
    held = got.join(F.broadcast(own), "row").select("at", "grade", F.explode("words").alias("word"))
    mean, spread = float(y.mean()), float(y.var())
    counted = held.groupBy("word").agg(F.count("*").alias("docs"), F.sum(F.col("grade") - mean).alias("off")).where(F.col("docs") >= LEAST_DOCS)
    errors = F.abs(F.col("off") / F.sqrt(F.greatest(F.lit(1e-12), spread * F.col("docs") * (1 - F.col("docs") / (n + 1)))))
    kept = [r["word"] for r in counted.withColumn("errors", F.round(errors, 9)).where(F.col("errors") >= LEAST_ERRORS).orderBy(F.desc("errors"), "word").limit(MOST).collect()]
    column = {w: i for i, w in enumerate(kept)}
    x = np.zeros((n, len(kept)))
    cells = held.where(F.col("word").isin(kept)).select("at", "word").toPandas() if kept else pd.DataFrame({"at": [], "word": []})
    x[cells["at"].to_numpy().astype(int), cells["word"].map(column).to_numpy().astype(int)] = 1
    thresholds, weights = fit_ordinal(x, y, int(y.max()) + 1)
    return Ordinal([float(v) for v in thresholds], {w: float(v) for w, v in zip(kept, weights)})


def severity(model: Ordinal):
    """A column function from a text to its expected severity."""

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        return pd.Series([model.severity(x) for x in texts], dtype=float)

    return predict


def grade_documents(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """``docs`` with severity (double) and rejected, whether it's at least ``SEVERE``.

    Null and empty texts have severity 0 and are kept. Whole texts count. Columns of these two names
    are replaced; repeated rows stay repeated.
    """
    text_batches(docs.sparkSession)
    return docs.withColumn("severity", severity(model)(F.col(text))).withColumn("rejected", F.col("severity") >= SEVERE)


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades of the table ``labels``: its column ``toxic``, which holds 0 and 1, so that there is one threshold."""
    return labels.select("doc_id", F.col("toxic").alias("grade"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, label_grades(table(spark, sf_dir, "labels")))
    return grade_documents(docs.select("doc_id", "text"), model).select("doc_id", "severity", "rejected")
