"""Vector tables: which rows take part, and searches that send queries to blocks of vectors.

Rows of one length are one search. A bounded sample gives centers, every row joins the cell of its
nearest center, and the cells' covering radii and counts are measured over all rows; this small table is
known to all tasks. Cells above a block's size are dealt into blocks by hash, so a hot vector
doesn't fill one task. A query is sent only to the cells that a search names for it. There the vectors
are read once and queries stream past them, so a task holds one block and one batch of queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postlake.llm._shared import stored, text_batches

#: Cells at most; and numbers in all their centers, which tasks are sent.
CELLS, CENTER_VALUES = 256, 1 << 21
#: Sample rows at most, and numbers in all of them.
SAMPLE, SAMPLE_VALUES = 4096, 1 << 21
#: Vectors of a block: as many as make BLOCKS blocks of all, within these bounds.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 16, 8192, 131_072
#: Queries that stream past one copy of a block, and queries that are searched together.
QUERY_PART, TOGETHER = 262_144, 1024


def usable(vectors: DataFrame, vec_id: str, embedding: str, nonzero: bool = False) -> DataFrame:
    """(id, v, n): rows whose id isn't null and whose vector is neither empty nor holds nulls or non-finite numbers, with its length.

    ``nonzero`` also leaves out zero vectors.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("n", F.size("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of one length in an Arrow column, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def sampled(rows: DataFrame, length: int) -> np.ndarray:
    """Vectors of the rows with the smallest hashes of their ids: at most ``SAMPLE`` rows and ``SAMPLE_VALUES`` numbers, on the driver."""
    most = max(16, min(SAMPLE, SAMPLE_VALUES // length))
    got = rows.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(most).select("v").toArrow()
    return matrix(got.column("v").combine_chunks()) if len(got) else np.empty((0, length))


@dataclass
class Cells:
    """Centers, and per cell the largest distance of a row and of a query, the number of rows, and of blocks."""

    centers: np.ndarray
    radius: np.ndarray
    query_radius: np.ndarray
    count: np.ndarray
    blocks: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.blocks)[:-1]]


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest center and the distance from it."""
    at = np.argmin(np.einsum("ij,ij->i", centers, centers) - 2 * (x @ centers.T), axis=1)
    off = x - centers[at]
    return at, np.sqrt(np.einsum("ij,ij->i", off, off))


def dealt(rows: DataFrame, centers: np.ndarray, scale: float = 1.0) -> tuple[DataFrame, Cells]:
    """``rows`` (id, v, q) with ``cell`` and ``norm``, stored, and the cells; distances and norms are of v / scale."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v")) / scale
            at, far = nearest(x, centers)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far), pa.array(np.sqrt(np.einsum("ij,ij->i", x, x)))], names=["id", "v", "q", "cell", "far", "norm"])

    placed = stored(rows.select("id", "v", "q").mapInArrow(place, "id long, v array<double>, q boolean, cell int, far double, norm double"), "vectors")
    c = len(centers)
    cells = Cells(centers, np.zeros(c), np.zeros(c), np.zeros(c, np.int64), np.zeros(c, np.int64), np.zeros(c), np.zeros(c))
    query_far = F.max(F.when(F.col("q"), F.col("far")))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), query_far.alias("query_far"), F.min("norm").alias("low"), F.max("norm").alias("high")).collect():
        cells.count[r.cell], cells.radius[r.cell], cells.query_radius[r.cell], cells.low[r.cell], cells.high[r.cell] = r.n, r.far, r.query_far or 0.0, r.low, r.high
    block = min(MOST_BLOCK, max(LEAST_BLOCK, math.ceil(cells.count.sum() / BLOCKS)))
    cells.blocks = -(-cells.count // block)
    return placed, cells


def only_queries(placed: DataFrame) -> DataFrame:
    """(id, v, cell) of the queries; of rows that repeat a query's id the one with the smallest vector counts."""
    return placed.where("q").groupBy("id").agg(F.min(F.struct("v", "cell")).alias("x")).select("id", "x.v", "x.cell")


def searched(placed: DataFrame, queries: DataFrame, cells: Cells, reach: Callable[[pa.RecordBatch], np.ndarray], index: Callable[[np.ndarray, np.ndarray], Callable], score: str) -> DataFrame:
    """(query_id, vec_id, score): what each query finds in each block of the cells that it reaches.

    ``queries`` has id, v and more columns; ``reach`` gives, for a batch of them, whether a query (row)
    reaches a cell (column). ``index`` makes of a block's ids, in rising order, and vectors a search, which takes a
    batch of queries and returns (query row, vector row, score) arrays.
    """
    spark = placed.sparkSession
    text_batches(spark)
    first, blocks = cells.first, cells.blocks

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = np.count_nonzero(reach(batch) & (blocks > 0), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["cell", "n"])

    parts = np.ones(len(blocks), np.int64)
    for r in queries.mapInArrow(reaching, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        parts[r.cell] = math.ceil(r.n / QUERY_PART)
    most = int(parts.max())
    extra = [f for f in queries.schema if f.name not in ("id", "v")]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, cell = np.nonzero(reach(batch) & (blocks > 0))
            n = blocks[cell]
            block = np.repeat(first[cell] - np.cumsum(n) + n, n) + np.arange(n.sum())
            row, split = np.repeat(row, n), np.repeat(parts[cell], n)
            for s in range(0, len(row), TOGETHER):
                took = batch.take(pa.array(row[s : s + TOGETHER]))
                where = [pa.array(x[s : s + TOGETHER].astype(np.int64)) for x in (block, split)]
                yield pa.RecordBatch.from_arrays([*took.columns, *where], names=[*batch.schema.names, "block", "parts"])

    names = "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra)
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))
    asked = queries.select("id", "v", *[f.name for f in extra]).mapInArrow(route, f"id long, v array<double>{names}, block long, parts long")
    asked = asked.select((F.col("block") * most + part).alias("block"), F.lit(1).alias("kind"), "id", "v", *[f.name for f in extra])
    of_cell = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)
    own = of_cell(first) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), of_cell(blocks))
    given = placed.select(own.alias("block"), "id", "v", F.explode(F.sequence(F.lit(0), of_cell(parts) - 1)).alias("part"))
    given = given.select((F.col("block") * most + F.col("part")).alias("block"), F.lit(0).alias("kind"), "id", "v", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])]) if len(block) else []
            for s, e in zip(edges, [*edges[1:], len(block)]):
                if block[s] != now:
                    now, held, found = block[s], [], None
                piece = batch.slice(s, e - s)
                if kind[s] == 0:
                    held.append((piece.column("id").to_numpy(), matrix(piece.column("v"))))
                    continue
                if not held and found is None:
                    continue
                if found is None:
                    ids, v = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    order = np.argsort(ids, kind="stable")
                    ids, held = ids[order], []
                    found = index(ids, v[order])
                for at in range(0, e - s, TOGETHER):
                    asking = piece.slice(at, TOGETHER)
                    i, j, got = found(asking)
                    yield pa.RecordBatch.from_arrays([asking.column("id").take(pa.array(i)), pa.array(ids[j]), pa.array(got)], names=["query_id", "vec_id", "score"])

    both = given.union(asked).repartition("block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(run, f"query_id long, vec_id long, score {score}")


def best_rows(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of each query, higher scores first, then smaller ids."""
    value = F.col("score")
    if dict(found.dtypes)["score"] == "double":
        value = F.nanvl(value, F.lit(float("-inf")))
    best = Window.partitionBy("query_id").orderBy(value.desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def by_length(rows: DataFrame, search: Callable[[DataFrame, int], DataFrame], score: str) -> DataFrame:
    """The results of ``search`` (rows, length) for each length of vectors that has a query, one after another."""
    found = [search(rows.where(F.col("n") == r.n).drop("n"), r.n) for r in rows.groupBy("n").agg(F.max("q").alias("q")).where("q").orderBy("n").collect()]
    if not found:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def best_of(row: np.ndarray, ids: np.ndarray, col: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best entries of each row: higher scores first, then smaller ids."""
    falling = ~score if score.dtype == np.int64 else -score
    order = np.lexsort((ids[col], falling, row))
    r = row[order]
    first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
    return order[np.arange(len(r)) - start < k]
