"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of sample texts. A text is encoded with every
dictionary, piece by piece so that the dictionary and not the text's own beginning explains each piece,
and the language with the smallest total wins. The margin to the runner-up, relative to its size, is the
score; narrow margins are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.llm._shared import stored, table, text_batches

UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")
#: Bytes of a language's dictionary and of all dictionaries at most, and sample documents per language.
DICTIONARY_BYTES, ALL_BYTES, SAMPLE_DOCS = 256 << 10, 64 << 20, 200
#: Bytes of the pieces that a text longer than its share of a full dictionary is represented by, which lie evenly over it.
EVEN = 256
#: Bytes encoded at a time, the level, and the level that decides between equal sizes.
PIECE, LEVEL, FINE_LEVEL = 2048, 6, 19
#: Texts whose margin is smaller are rejected.
NARROW = 0.01


def letters(text: str) -> bytes:
    """The words of a text in lower case, one space round each; empty without letters."""
    found = _NO_LETTERS.sub(" ", text.lower()).strip()
    return f" {found} ".encode("utf-8", "surrogatepass") if any(map(str.isalpha, found)) else b""


def evenly(data: bytes, most: int) -> bytes:
    """``data``, or pieces of ``EVEN`` bytes from all over it, each from a word's beginning, that make about ``most`` bytes."""
    if len(data) <= most:
        return data
    width = max(1, min(EVEN, most))
    starts = (data.find(b" ", int(x)) for x in np.linspace(0, len(data) - width, most // width))
    return b"".join(data[s : s + width] for s in starts if s >= 0)


def level_share(sizes: list[int], room: int) -> int:
    """The most bytes that a text may bring so that all fit into ``room``: shorter texts leave their rest to longer ones."""
    left = len(sizes)
    for size in sorted(sizes):
        if size * left > room:
            return room // left
        room -= size
        left -= 1
    return max(sizes, default=0)


class Languages:
    """Encoders with one dictionary per language; languages that equal sizes can't tell apart go by ``prior`` order."""

    def __init__(self, dictionaries: dict[str, bytes], prior: list[str]):
        self.dictionaries = dictionaries
        self.names = [x for x in prior if x in dictionaries]
        self.levels: dict[int, list[zstandard.ZstdCompressor]] = {}

    def encoders(self, level: int) -> list[zstandard.ZstdCompressor]:
        """The encoders of a level, made when it's first needed: few texts ask for the finer one."""
        if level not in self.levels:
            self.levels[level] = []
            for name in self.names:
                d = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                self.levels[level].append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self.levels[level]

    def sizes(self, data: bytes, level: int) -> np.ndarray:
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return np.array([sum(len(c.compress(x)) for x in pieces) for c in self.encoders(level)])

    def predict(self, text: str | None) -> tuple[str, float]:
        data = letters(text) if text else b""
        if not data or not self.names:
            return UNKNOWN, 0.0
        if len(self.names) == 1:
            return self.names[0], 1.0
        sizes = self.sizes(data, LEVEL)
        first, second = np.argsort(sizes, kind="stable")[:2]
        if sizes[first] == sizes[second]:
            sizes = self.sizes(data, FINE_LEVEL)
            first, second = np.argsort(sizes, kind="stable")[:2]
        return self.names[first], float(1 - sizes[first] / sizes[second])


def train(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id") -> tuple[dict[str, bytes], list[str]]:
    """Dictionaries by language, and the languages by falling number of documents, from rows with a language and a text.

    The sample is bounded in documents: of each language the ``SAMPLE_DOCS`` with the smallest hashes. A dictionary
    holds all of their texts whole where they fit into ``DICTIONARY_BYTES`` (or an equal share of ``ALL_BYTES``, if there are more than
    256 languages). Where they don't, it's full: each text is whole up to a share that's as large as possible, and longer ones are represented by
    pieces from all over them. This much per language comes to the driver. The ranking is cut down before
    the shuffle, so a hot language is no hot partition.
    """
    text_batches(docs.sparkSession)
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    prior = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE_DOCS)
    chosen = stored(chosen.select("doc_id", "lang", "at").dropDuplicates(["doc_id", "lang"]), "language-sample")

    @F.pandas_udf("binary")
    def plain(texts: pd.Series) -> pd.Series:
        return pd.Series([letters(x) for x in texts], dtype=object)

    # of rows that repeat a sampled doc_id the one with the smallest data counts
    sample = known.join(chosen, ["doc_id", "lang"]).select("lang", "at", plain("text").alias("data")).groupBy("lang", "at").agg(F.min("data").alias("data"))
    sample = stored(sample, "language-texts")
    sizes = sample.select("lang", F.octet_length("data").alias("size")).toPandas().groupby("lang")["size"].apply(list)
    room = min(DICTIONARY_BYTES, ALL_BYTES // max(1, len(sizes)))
    shares = {name: level_share(found, room) for name, found in sizes.items()}

    @F.pandas_udf("binary")
    def taken(langs: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([evenly(bytes(x), shares[name]) for name, x in zip(langs, data, strict=True)], dtype=object)

    rows = sample.select("lang", "at", taken("lang", "data").alias("data")).orderBy("lang", "at").toPandas()
    dictionaries = {name: found for name, part in rows.groupby("lang", sort=True) if (found := b"".join(part["data"]))}
    return dictionaries, prior


def predictor(model: tuple[dict[str, bytes], list[str]]):
    """A column function from a text to (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages = Languages(*model)
        for texts in batches:
            yield pd.DataFrame([languages.predict(x) for x in texts], columns=["lang_pred", "score"])

    return predict


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: tuple[dict[str, bytes], list[str]], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and accepted.

    A text that is null, empty or without letters is ``und`` with score 0; so is every text if nothing
    was learned. With one learned language, texts with letters get it with score 1. ``accepted`` is
    false for ``und`` and for margins below ``NARROW``. Whole texts are encoded. Columns of these three
    names are replaced; repeated rows stay repeated.
    """
    text_batches(docs.sparkSession)
    found = docs.withColumn("_found", predictor(model)(F.col(text)))
    return found.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score"), "accepted": (F.col("_found.lang_pred") != UNKNOWN) & (F.col("_found.score") >= NARROW)}).drop("_found")


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
