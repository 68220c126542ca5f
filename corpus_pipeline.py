"""The corpus pipeline: toxic documents, unclear languages and near copies go, sources are mixed, texts are encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlake.llm import language, mixing, pieces, simhash, toxicity
from postlake.llm._shared import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below ``toxicity.SEVERE``, by a model of the labelled ones."""
    model = toxicity.train(docs, toxicity.label_grades(table(spark, sf_dir, "labels")))
    return toxicity.grade_documents(docs, model).where("NOT rejected").select(docs.columns)


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that stands out by at least ``language.NARROW``."""
    model = language.train(docs.where(~language.held_out()))
    return language.identify(docs, model).where("accepted").select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_copies(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document."""
    return pieces.encode_documents(docs, pieces.read_model()).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("language", clear_language),
    ("near_copies", without_copies),
    ("mixing", mixed),
    ("pieces", encoded),
]
#: SQL can express no stage; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
