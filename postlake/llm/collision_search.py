"""Approximate nearest neighbours by collision counting.

Every projection of a block keeps its vectors in one sorted array. Round a query's own projection a window
is opened in each array; vectors within it collide with the query there. Windows widen round by round
(virtual rehashing: the arrays stay as they are, and only entries that newly enter are counted), and
vectors that collide in the threshold's share of projections are verified by their exact inner
products. A query's windows stop widening once they're wide enough for its kth nearest so far, and at a
width, found on a bounded sample, at which a fixed share of all vectors collides. A query first searches the cell
of vectors that promises most; its kth score there bounds the widest windows in all other cells, and cells
that these can't reach in enough projections are never sent the query. Queries that end with
too few vectors are asked again with wider windows.

Largest inner product becomes smallest distance by one more coordinate: vectors get
sqrt(M^2 - |x|^2), with M the largest norm, and queries 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlake.llm import vectors as V
from postlake.llm._shared import stored, table
from postlake.llm.vectors import best_of, best_rows, by_length, usable

#: Directions, share of them that must collide, and share of all vectors that is verified before windows stop widening.
DIRECTIONS, THRESHOLD, ENOUGH = 64, 0.85, 0.1
#: As many times k vectors more, which matters in small tables.
FEW = 10
#: Sample vectors that this share is measured on.
TRIED = 512
#: Rounds of windows, as shares of the widest one; and how many root mean square projections of the kth distance make a window wide enough.
ROUNDS, COVERED = (0.125, 0.25, 0.5, 0.75, 1.0), 1.8
#: Queries with too few vectors are asked again with windows this much wider.
WIDEN = 2.0
#: Rows that make another cell, up to ``vectors.CELLS``.
CELL_ROWS = 16_384
SEED = 20


def directions(dim: int, m: int, seed: int = SEED) -> np.ndarray:
    """``m`` random directions as columns, orthonormal in sets of ``dim``."""
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(math.ceil(m / dim))]
    return np.concatenate(sets, axis=1)[:, :m]


class Space:
    """What brings vectors to one scale, lifts and projects them; ``most`` is the largest norm at that scale."""

    def __init__(self, length: int, scale: float, most: float):
        self.scale, self.most, self.axes = scale, most, directions(length + 1, DIRECTIONS)
        self.least = math.ceil(THRESHOLD * DIRECTIONS)

    def rows(self, v: np.ndarray) -> np.ndarray:
        x = v / self.scale
        return np.c_[x, np.sqrt(np.maximum(self.most**2 - np.einsum("ij,ij->i", x, x), 0))] @ self.axes

    def queries(self, v: np.ndarray) -> np.ndarray:
        """Projections of queries, which only count by their direction, at the largest norm."""
        x = v / np.abs(v).max(axis=1, keepdims=True)
        return (x * (self.most / np.sqrt(np.einsum("ij,ij->i", x, x)))[:, None]) @ self.axes[:-1]

    def enough(self, kth: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Half-widths wide enough for all that is as near as the kth score of queries with these norms; without bound where that's unknown."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            cos = kth / (norm * self.scale * self.most)
        far = self.most * np.sqrt(np.maximum(0.0, 2 - 2 * np.where(np.isfinite(cos), cos, 0.0)))
        return np.where(np.isfinite(cos), COVERED * far / math.sqrt(len(self.axes)) + 1e-9 * self.most, np.inf)


class Block:
    """The sorted arrays of one block. ``counted`` counts entries of windows, and ``verified`` exact scores."""

    def __init__(self, space: Space, ids: np.ndarray, v: np.ndarray, k: int):
        self.space, self.ids, self.v, self.k = space, ids, v, k
        self.counted = self.verified = 0
        at = np.ascontiguousarray(space.rows(v).T)
        self.order = np.argsort(at, axis=1, kind="stable")
        self.arrays = np.take_along_axis(at, self.order, 1)

    def windows(self, asked: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places [low, high) of the windows: (queries, directions)."""
        sides = [(np.searchsorted(a, q - half, "left"), np.searchsorted(a, q + half, "right")) for a, q in zip(self.arrays, asked.T)]
        return np.array([x for x, _ in sides]).T, np.array([x for _, x in sides]).T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector row, score) of each query's ``k`` best vectors among those that reach the threshold within ``width``."""
        asked = self.space.queries(queries)
        rounds = [self.windows(asked, width * x) for x in ROUNDS]
        m, n = DIRECTIONS, len(self.ids)
        norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        out = []
        for i in range(len(queries)):
            counts = np.zeros(n, np.int64)
            fresh = self.ids != query_ids[i]
            rows, scores = np.empty(0, np.int64), np.empty(0)
            before: tuple | None = None
            for share, (low, high) in zip(ROUNDS, rounds):
                lo, hi = low[i], high[i]
                if before is None:
                    entered = [self.order[j, lo[j] : hi[j]] for j in range(m)]
                else:
                    entered = [self.order[j, lo[j] : before[0][j]] for j in range(m)] + [self.order[j, before[1][j] : hi[j]] for j in range(m)]
                before = lo, hi
                places = np.concatenate(entered)
                self.counted += len(places)
                if len(places) < n:  # narrow windows: only what entered is touched
                    some, times = np.unique(places, return_counts=True)
                    counts[some] += times
                    new = some[(counts[some] >= self.space.least) & fresh[some]]
                else:
                    counts += np.bincount(places, minlength=n)
                    new = np.flatnonzero((counts >= self.space.least) & fresh)
                if len(new):
                    self.verified += len(new)
                    fresh[new] = False
                    with np.errstate(over="ignore", invalid="ignore"):
                        got = np.einsum("ij,j->i", self.v[new], queries[i])
                    rows, scores = np.r_[rows, new], np.r_[scores, got]
                if len(rows) >= self.k and share < 1:
                    kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                    if width[i] * share >= self.space.enough(kth, norm[i]):
                        break
            best = best_of(np.zeros(len(rows), np.int64), self.ids, rows, scores, self.k)
            out.append((np.full(len(best), i), rows[best], scores[best]))
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _search_length(rows: DataFrame, length: int, k: int) -> DataFrame:
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = stored(rows.withColumn("largest", largest), "vector-rows")
    n, scale = rows.groupBy().agg(F.count("*"), F.max("largest")).first()
    sample = V.sampled(rows, length)
    most = min(V.CELLS, max(1, V.CENTER_VALUES // length), max(1, n // CELL_ROWS))
    placed, cells = V.dealt(rows, np.unique(sample[:most] / scale, axis=0), scale)
    space = Space(length, scale, float(cells.high.max()))
    share = ENOUGH + FEW * k / n
    tried = space.rows(sample[:TRIED])

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The half-width at which the share of the sample collides; without bound where it's all of it."""
        for batch in batches:
            asked = space.queries(V.matrix(batch.column("v"))) if batch.num_rows else np.empty((0, DIRECTIONS))
            out = np.full(len(asked), np.inf)
            if share < 1:
                for i, q in enumerate(asked):
                    reached = np.partition(np.abs(tried - q), space.least - 1, axis=1)[:, space.least - 1]
                    at = min(len(tried), math.ceil(share * len(tried))) - 1
                    out[i] = np.partition(reached, at)[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "width"])

    # where a cell's vectors may lie on each direction
    middle = cells.centers @ space.axes[:-1]
    reach = cells.radius[:, None] * np.sqrt((space.axes[:-1] ** 2).sum(axis=0))[None, :] * (1 + 1e-9) + 1e-9
    lifted = [np.sqrt(np.maximum(space.most**2 - x**2, 0))[:, None] * space.axes[-1] for x in (cells.high, cells.low)]
    low, high = middle - reach + np.minimum(*lifted), middle + reach + np.maximum(*lifted)

    def opened(batch: pa.RecordBatch) -> np.ndarray:
        asked, width = space.queries(V.matrix(batch.column("v"))), batch.column("width").to_numpy()
        hits = np.zeros((len(asked), len(low)), np.int64)
        for j in range(DIRECTIONS):
            hits += (asked[:, j, None] - width[:, None] <= high[None, :, j]) & (asked[:, j, None] + width[:, None] >= low[None, :, j])
        return hits >= space.least

    def index(ids: np.ndarray, v: np.ndarray):
        block = Block(space, ids, v, k)
        return lambda batch: block.search(batch.column("id").to_numpy(), V.matrix(batch.column("v")), batch.column("width").to_numpy())

    usual = np.where(cells.count > k, 0.0, -np.inf)  # cells that can give k scores come first

    def promising(batch: pa.RecordBatch) -> np.ndarray:
        x = V.matrix(batch.column("v"))
        x = x / np.abs(x).max(axis=1, keepdims=True)
        best = np.argmax(np.maximum(x @ cells.centers.T + usual, np.where(cells.count > 0, -1.7e308, -np.inf)), axis=1)
        return best[:, None] == np.arange(len(cells.centers))[None, :]

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, kth = V.matrix(batch.column("v")), batch.column("kth").to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                width = np.minimum(batch.column("width").to_numpy(), space.enough(kth, norm))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(width)], names=["id", "v", "width"])

    def ask(queries: DataFrame) -> DataFrame:
        if len(cells.centers) == 1:
            return stored(best_rows(V.searched(placed, queries, cells, opened, index, "double"), k), "vector-found")
        near = stored(best_rows(V.searched(placed, queries, cells, promising, index, "double"), k), "vector-found")
        kth = near.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
        rest = stored(queries.join(kth, "id", "left").select("id", "v", "width", "kth").mapInArrow(narrowed, "id long, v array<double>, width double"), "vector-queries")
        far = V.searched(placed, rest, cells, lambda batch: opened(batch) & ~promising(batch), index, "double")
        return stored(best_rows(near.drop("rank").unionByName(far), k), "vector-found")

    queries = stored(V.only_queries(placed).select("id", "v").mapInArrow(widths, "id long, v array<double>, width double"), "vector-queries")
    found = []
    while True:
        found.append(ask(queries))
        if share >= 1:
            break
        full = found[-1].groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= k).select("id")
        wider = F.col("width") * WIDEN
        short = queries.where("width < double('inf')").join(full, "id", "left_anti").select("id", "v", F.when(wider > 3 * space.most, F.lit(float("inf"))).otherwise(wider).alias("width"))
        queries = stored(short, "vector-queries")
        if queries.isEmpty():
            break
        found[-1] = found[-1].join(queries.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(found[-1].columns)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def approximate_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): about the ``k`` rows with the largest inner products per query.

    ``is_query`` is a predicate on the column ``id``. Scores are exact, in double precision, on the
    original vectors; ties go to the smaller vec_id. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do rows with a null id. Rows of different lengths have no
    inner product: a query's candidates are the rows of its own length. A query with fewer than ``k``
    candidates gets all of them. Rows with the query's own id are no candidates; repeated rows are
    candidates as often as they occur; of rows that repeat a query's id the smallest vector asks. Other
    columns are not read. No candidate above the threshold is left out, however many there are. A
    score that overflows is infinite; one that isn't a number ranks last.
    """
    rows = usable(vectors, vec_id, embedding, nonzero=True).withColumn("q", F.coalesce(is_query, F.lit(False)))
    return by_length(rows, lambda df, length: _search_length(df, length, k), "double")


def op1_collision_search(spark, sf_dir: str) -> DataFrame:
    return approximate_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
