"""A stored inverted index of texts, kept up to date by batches of changed documents.

The index is a folder of three Parquet tables. ``postings`` holds a row per field, term and document: the term's
places in a text, or the number of distinct trigrams of a title. It lies in folders by generation, field and
bucket (a hash of the term) and is sorted by term, so a query reads only the buckets of its terms, and of these
only the row groups that may hold them. ``changes`` names the documents that a generation wrote or removed, ``commits``
the generations that count. A batch is one generation: its folders are overwritten if it comes again, and nobody sees it
before its commit. A posting is alive if no later generation names its document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlake.functions.batches import text_batches
from postlake.functions.stems import stem
from postlake.functions.text import trigrams
from postlake.operators.search import SIMILAR, STOP_WORDS, Term, web_search

_SPLIT = re.compile("[^a-z0-9]+")
_POSTING = "field string, bucket int, term string, doc long, places array<int>, size int"
_ROWS = 20_000  # postings that a worker holds before it sends them on
_COMMIT = "generation long, base boolean, documents long"


def text_terms(text: str | None) -> dict[str, list[int]]:
    """The places of each stem in a text, stop words not counted."""
    found: dict[str, list[int]] = {}
    words = (w for w in _SPLIT.split(text.lower() if text else "") if w and w not in STOP_WORDS)
    for place, word in enumerate(words):
        found.setdefault(stem(word), []).append(place)
    return found


def _text_postings(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(terms: list[str], docs: list[int], places: list[list[int]]) -> pa.RecordBatch:
        columns = [
            pa.array(["text"] * len(terms), pa.string()),
            pa.array([crc32(t.encode()) % buckets for t in terms], pa.int32()),
            pa.array(terms, pa.string()),
            pa.array(docs, pa.int64()),
            pa.array(places, pa.list_(pa.int32())),
            pa.array([len(p) for p in places], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["field", "bucket", "term", "doc", "places", "size"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, docs, places = [], [], []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = text_terms(text.as_py())
                terms += found
                places += found.values()
                docs += [doc.as_py()] * len(found)
                if len(terms) >= _ROWS:
                    yield rows(terms, docs, places)
                    terms, docs, places = [], [], []
            yield rows(terms, docs, places)

    return made


@dataclass(frozen=True)
class Index:
    """An inverted index in ``folder``, which driver and executors share.

    ``buckets`` is fixed when the index is made. ``files`` is how many files a bucket of a generation has at most, so that
    the bucket of a very common term isn't written by one task.
    """

    spark: SparkSession
    folder: str
    buckets: int = 32
    files: int = 2

    def apply(self, changed: DataFrame, generation: int, base: bool = False) -> None:
        """Writes one generation from ``changed`` (doc, title, text): new states of documents; those without title and text are removed.

        Rows of one document in a batch count together. The same generation applied again, after a loss, gives the same index.
        """
        text_batches(changed.sparkSession)
        rows = changed.select(F.col("doc").cast("long").alias("doc"), "title", "text").where("doc IS NOT NULL")
        alive = rows.where("title IS NOT NULL OR text IS NOT NULL")
        of_text = alive.select("doc", F.concat_ws(" ", "title", "text").alias("text")).mapInArrow(_text_postings(self.buckets), _POSTING)
        grams = alive.where("title IS NOT NULL").select("doc", trigrams(F.col("title")).alias("grams"))
        of_title = grams.select(F.lit("title").alias("field"), "doc", F.size("grams").alias("size"), F.explode("grams").alias("term"))
        of_title = of_title.select("field", self._bucket(F.col("term")).alias("bucket"), "term", "doc", F.lit(None).cast("array<int>").alias("places"), "size")
        part = F.pmod(F.xxhash64("doc"), F.lit(self.files))
        postings = of_text.unionByName(of_title).repartition("field", "bucket", part).sortWithinPartitions("field", "bucket", "term", "doc")
        postings.write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{self.folder}/postings/generation={generation}")
        removed = (F.col("title").isNull() & F.col("text").isNull()).alias("removed")
        rows.select("doc", removed).write.mode("overwrite").parquet(f"{self.folder}/changes/generation={generation}")
        commit = self._changes(generation).groupBy().agg(F.count("*").alias("documents")).select(F.lit(generation).cast("long").alias("generation"), F.lit(base).alias("base"), "documents")
        commit.write.mode("overwrite").parquet(f"{self.folder}/commits/{generation}")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function: every micro-batch is the generation of its number."""
        return lambda batch, number: self.apply(batch, number)

    def _bucket(self, term: Column) -> Column:
        return (F.crc32(term.cast("binary")) % self.buckets).cast("int")

    def _changes(self, generation: int) -> DataFrame:
        return self.spark.read.schema("doc long, removed boolean").parquet(f"{self.folder}/changes/generation={generation}")

    def generations(self) -> list[int]:
        """The committed generations from the last base on."""
        try:
            commits = self.spark.read.schema(_COMMIT).parquet(f"{self.folder}/commits/*").collect()
        except AnalysisException:
            return []
        start = max((c.generation for c in commits if c.base), default=0)
        return sorted(c.generation for c in commits if c.generation >= start)

    def _latest(self, generations: list[int]) -> DataFrame:
        """(doc, since, removed): the last generation that names each document of the generations given."""
        named = reduce(DataFrame.union, [self._changes(g).withColumn("since", F.lit(g)) for g in generations])
        return named.groupBy("doc").agg(F.max("since").alias("since"), F.max_by("removed", "since").alias("removed"))

    def postings(self, field: str, terms: list[str]) -> DataFrame:
        """(doc, term, places, size): living postings of some terms. Only their buckets are read, and later changes."""
        generations = self.generations()
        if not generations or not terms:
            return self.spark.createDataFrame([], "doc long, term string, places array<int>, size int")
        buckets = sorted({crc32(t.encode()) % self.buckets for t in terms})
        paths = [f"{self.folder}/postings/generation={g}" for g in generations]
        rows = self.spark.read.schema("term string, doc long, places array<int>, size int, generation long, field string, bucket int").option("basePath", f"{self.folder}/postings").parquet(*paths)
        rows = rows.where((F.col("field") == field) & F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        if len(generations) > 1:
            rows = rows.join(self._latest(generations[1:]).select("doc", "since"), "doc", "left").where("since IS NULL OR since <= generation")
        return rows.select("doc", "term", "places", "size")

    def documents(self) -> DataFrame:
        """(doc): the documents that the index holds."""
        generations = self.generations()
        if not generations:
            return self.spark.createDataFrame([], "doc long")
        return self._latest(generations).where("NOT removed").select("doc")

    def matching(self, query: str) -> DataFrame:
        """(doc): documents that match a web search, see :func:`search.web_search`. A query without a word finds nothing.

        The postings of all its stems meet per document, where terms, phrases and negations are tested. Only a query of nothing but
        unwanted terms looks at the list of documents.
        """
        groups = web_search(query)
        if not groups:
            return self.documents().limit(0)
        terms = sorted({s for group in groups for t in group for s in t.stems})
        # a column of places per stem; a document that a batch repeats has those of all its rows
        per = self.postings("text", terms).groupBy("doc").agg(*[F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("places")))).alias(f"at_{t}") for t in terms])
        wanted = [group for group in groups if not all(t.unwanted for t in group)]
        if not wanted or any(t.unwanted for group in wanted for t in group):  # documents without any of the stems may match
            per = self.documents().join(per, "doc", "left")
        tests = [reduce(lambda a, b: a | b, [_matches(t) for t in group]) for group in groups]
        return per.where(reduce(lambda a, b: a & b, tests)).select("doc")

    def similar(self, text: str, least: float = SIMILAR) -> DataFrame:
        """(doc, similarity): documents whose title shares at least so many of all trigrams of both."""
        grams = [r[0] for r in self.spark.range(1).select(F.explode(trigrams(F.lit(text)))).collect()]
        shared = self.postings("title", grams).groupBy("doc").agg(F.count("*").alias("n"), F.max("size").alias("size"))
        return shared.withColumn("similarity", F.col("n") / (F.col("size") + len(grams) - F.col("n"))).where(F.col("similarity") >= least).select("doc", "similarity")

    def matching_or_similar(self, query: str) -> DataFrame:
        """(doc): documents that match the search in their text, or are similar to it in their title."""
        return self.matching(query).union(self.similar(query).select("doc")).distinct()

    def compact(self, generation: int) -> None:
        """Writes all living postings as one base generation, from which readers start; those before it can be deleted."""
        generations = self.generations()
        latest = self._latest(generations)
        rows = self.spark.read.option("basePath", f"{self.folder}/postings").parquet(*[f"{self.folder}/postings/generation={g}" for g in generations])
        alive = rows.join(latest.where("NOT removed"), "doc").where("generation = since").select("field", "bucket", "term", "doc", "places", "size")
        part = F.pmod(F.xxhash64("doc"), F.lit(self.files))
        alive.repartition("field", "bucket", part).sortWithinPartitions("field", "bucket", "term", "doc").write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{self.folder}/postings/generation={generation}")
        latest.where("NOT removed").select("doc", "removed").write.mode("overwrite").parquet(f"{self.folder}/changes/generation={generation}")
        commit = self._changes(generation).groupBy().agg(F.count("*").alias("documents")).select(F.lit(generation).cast("long").alias("generation"), F.lit(True).alias("base"), "documents")
        commit.write.mode("overwrite").parquet(f"{self.folder}/commits/{generation}")


def _matches(term: Term) -> Column:
    """Whether a document, by its stems' places, holds a word, or a phrase's words in a row."""

    def starts_of(stem: str, offset: int) -> Column:
        return F.transform(f"at_{stem}", lambda place: place - offset)

    starts = [starts_of(s, i) for i, s in enumerate(term.stems)]
    holds = F.coalesce(F.size(reduce(F.array_intersect, starts)) > 0, F.lit(False))
    return ~holds if term.unwanted else holds
