"""Exact top-k inner products with two cover trees.

Queries and data are indexed together. A node has a center, a level, and children at a lower level. Levels
halve: with R the largest distance from a net's first center, centers of level i are more than R / 2^i apart,
all of them and not just siblings; each lies within R / 2^(i-1) of its parent, a center of the level above; and a center
stays one on all levels below. Such nets come from farthest-first order: the distance of each
next center from those before falls, so every prefix of the order is a net as wide apart as it covers, and its
distance tells a center's level. A net ends after ``NET`` centers; rows then belong to their nearest center, and
what holds more rows than a leaf gets a net of its own below. Levels at which a center has no new
children are left out, and covering radii are measured over all rows below.

The top of the tree is a net of a bounded sample, and its centers are cells that all rows join and that
tasks index further, so one tree spans the whole table; each cell is a node of the queries' tree as well.

For nodes Q and P the best score is at most ``q.p + |q| r_P + |p| r_Q + r_Q r_P``; a pair below the
worst kth score of Q's queries is pruned. Queries first search the cell that promises most, which gives kth
scores; with these, pairs of cells are pruned and queries go only to cells left. Inside a cell pairs of nodes
are taken best bound first, down to leaves, where scores are computed together.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlake.llm import vectors as V
from postlake.llm._shared import stored, table
from postlake.llm.vectors import best_of, best_rows, by_length, usable

#: Rows of a leaf of the data and of the queries, which a leaf prunes one by one as well; centers of a net at most.
LEAF, QUERY_LEAF, NET = 128, 256, 128
#: Rows that make another cell, up to ``vectors.CELLS``.
CELL_ROWS = 4096
#: No score: below all others.
NONE = -(2**63)
#: Components are cut here, so that squares stay finite; scores of such rows lie beyond a long anyway, unless huge terms cancel.
MOST = 2.0**500


class Node:
    """A center, its level's distance ``scale``, the rows below it, and the centers, norms and radii of its children."""

    __slots__ = ("center", "scale", "radius", "norm", "points", "children", "centers", "norms", "radii", "worst", "at")

    def __init__(self, x: np.ndarray, at: int, points: np.ndarray, scale: float = np.inf):
        self.at, self.center, self.points, self.children, self.scale = at, x[at], points, None, scale
        self.radius = float(distances(x[points], self.center).max())
        self.norm = float(np.sqrt(self.center @ self.center))
        self.worst = -np.inf

    def adopt(self, children: list[Node]) -> None:
        self.children = children
        self.centers = np.array([c.center for c in children])
        self.norms, self.radii = np.array([c.norm for c in children]), np.array([c.radius for c in children])


def distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    off = x - center
    return np.sqrt(np.einsum("ij,ij->i", off, off))


def net(x: np.ndarray, first: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``most`` centers in farthest-first order (rows of ``x``), the distance of each from those before, and each row's nearest center."""
    at, gap = [first], [np.inf]
    far, near = distances(x, x[first]), np.zeros(len(x), np.int64)
    while len(at) < most:
        new = int(np.argmax(far))
        if far[new] == 0:
            break
        # a row nearer to its center than half the way to the new one can't change
        open_ = np.flatnonzero(2 * far > distances(x[at], x[new])[near])
        away = distances(x[open_], x[new])
        closer = away < far[open_]
        at.append(new)
        gap.append(float(far[new]))
        far[open_[closer]], near[open_[closer]] = away[closer], len(at) - 1
    return np.array(at), np.array(gap), near


def levels(gap: np.ndarray) -> np.ndarray:
    """The smallest level i of each center with gap > R / 2^i, with R the second center's gap; 0 for the first center."""
    return np.r_[0, np.floor(np.log2(gap[1] / gap[1:])).astype(np.int64) + 1] if len(gap) > 1 else np.zeros(1, np.int64)


def grow(x: np.ndarray, node: Node, most: int) -> list[Node]:
    """Gives a node of positive radius the net of its rows as descendants; returns those without children."""
    points = node.points
    own = x[points]
    at, gap, near = net(own, int(np.searchsorted(points, node.at)), most)
    level = levels(gap)
    below: list[list[int]] = [[] for _ in at]
    for j in range(1, len(at)):
        above = int(np.searchsorted(level, level[j]))
        below[int(np.argmin(distances(own[at[:above]], own[at[j]])))].append(j)
    rows = np.split(points[np.argsort(near, kind="stable")], np.cumsum(np.bincount(near, minlength=len(at)))[:-1])
    leaves = []

    def place(j: int, now: int) -> Node:
        """Center j from level ``now`` down."""
        later = [c for c in below[j] if level[c] > now]
        scale = float(np.ldexp(gap[1], -int(now)))
        if not later:
            leaves.append(Node(x, int(points[at[j]]), rows[j], scale))
            return leaves[-1]
        down = level[later[0]]
        children = [place(c, down) for c in (j, *(c for c in later if level[c] == down))]
        made = Node(x, int(points[at[j]]), np.sort(np.concatenate([c.points for c in children])), scale)
        made.adopt(children)
        return made

    top = place(0, 0)
    node.scale = top.scale
    node.adopt(top.children)
    return leaves


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[Node, list[Node]]:
    """A cover tree over the rows of ``x`` and its leaves, which hold row numbers in rising order: ``leaf`` rows at most, or equal ones only."""
    root = Node(x, 0, np.arange(len(x)))
    open_, done = [root], []
    while open_:
        node = open_.pop()
        if len(node.points) <= leaf or node.radius == 0:
            done.append(node)
        else:
            open_ += grow(x, node, min(NET, max(2, -(-2 * len(node.points) // leaf))))
    return root, done


def bound(dot: np.ndarray, q_norm: np.ndarray | float, p_norm: np.ndarray | float, q_radius: np.ndarray | float, p_radius: np.ndarray | float) -> np.ndarray:
    """The best score of two nodes at most, and a little more, so that rounding never prunes a pair that reaches it."""
    reach = q_norm * p_radius + p_norm * q_radius + q_radius * p_radius
    return dot + reach + 1e-9 * (q_norm * p_norm + reach) + 1e-9


class Search:
    """A block's tree, which batches of queries are compared with. ``compared`` counts pairs of a query and a row whose score was computed."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int):
        self.ids, self.data, self.k, self.compared = ids, data, k, 0
        self.root = cover_tree(data)[0]
        self.norms = np.sqrt(np.einsum("ij,ij->i", data, data))

    def __call__(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, data row, score) of each query's ``k`` best rows that reach ``least``, the score it asks for."""
        self.query_ids, self.queries = query_ids, queries
        self.query_norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        self.least = np.full(len(queries), NONE) if least is None else least
        self.score = np.full((len(queries), self.k), NONE)
        self.row = np.full((len(queries), self.k), -1)
        serial = count()
        q, p = cover_tree(queries, QUERY_LEAF)[0], self.root
        heap = [(-np.inf, next(serial), q, p)]
        while heap:
            up, _, q, p = heapq.heappop(heap)
            if -up < self._worst(q):
                continue
            if q.children is None and p.children is None:
                self._compare(q, p)
            elif p.children is None or (q.children is not None and q.radius > p.radius):
                for c, best in zip(q.children, bound(q.centers @ p.center, q.norms, p.norm, q.radii, p.radius)):
                    heapq.heappush(heap, (-best, next(serial), c, p))
            else:
                up, worst = bound(p.centers @ q.center, q.norm, p.norms, q.radius, p.radii), self._worst(q)
                for i in np.flatnonzero(up >= worst):
                    heapq.heappush(heap, (-up[i], next(serial), q, p.children[i]))
        i, j = np.nonzero(self.row >= 0)
        return i, self.row[i, j], self.score[i, j]

    def _worst(self, q: Node) -> float:
        """The worst kth score of a node's queries; it rises as children improve."""
        if q.children is None:
            now = np.maximum(self.score[q.points, -1], self.least[q.points]).min()
            now = -np.inf if now == NONE else float(now)
        else:
            now = min(c.worst for c in q.children)
        q.worst = max(q.worst, now)
        return q.worst

    def _exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores in whole numbers of any size; those beyond a long become the nearest long."""
        out = [sum(int(a) * int(b) for a, b in zip(self.queries[i], self.data[j])) for i, j in zip(r, c)]
        return np.array([min(2**63 - 1, max(1 - 2**63, x)) for x in out], np.int64)

    def _compare(self, q: Node, p: Node) -> None:
        points, ids, k = p.points, self.ids, self.k
        kth = np.maximum(self.score[q.points, -1], self.least[q.points])
        mine = q.points[bound(self.queries[q.points] @ p.center, self.query_norms[q.points], p.norm, 0.0, p.radius) >= np.where(kth == NONE, -np.inf, kth)]
        if not len(mine):
            return
        if p.radius == 0:  # equal rows have equal scores, so only the smallest ids can count; a query may be one of them
            distinct = np.flatnonzero(np.r_[True, ids[points][1:] != ids[points][:-1]])
            points = points[: distinct[k + 1]] if len(distinct) > k + 1 else points
        s = self.queries[mine] @ self.data[points].T
        self.compared += s.size
        size = self.query_norms[mine][:, None] * self.norms[points][None, :]
        inexact = size >= 2.0**52  # whole numbers below are exact in double precision, however they are added up
        slack = np.where(inexact, size * (self.data.shape[1] * 2.0**-50), 0.0) if inexact.any() else None
        low, high = (s, s) if slack is None else (s - slack, s + slack)
        own = self.query_ids[mine][:, None] == ids[points][None, :]
        if own.any():
            low, high = np.where(own, -np.inf, low), np.where(own, -np.inf, high)
        kth = np.maximum(self.score[mine, -1], self.least[mine])
        floor = np.where(kth == NONE, -np.inf, np.nextafter(kth.astype(float), -np.inf) if slack is not None else kth)
        if len(points) > k:
            floor = np.maximum(floor, np.partition(low, len(points) - k, axis=1)[:, len(points) - k])
        r, c = np.nonzero((high >= floor[:, None]) & (high > -np.inf))
        if not len(r):
            return
        new = np.zeros(len(r), np.int64)
        wide = inexact[r, c]
        new[~wide] = s[r, c][~wide].astype(np.int64)
        new[wide] = self._exact(mine[r[wide]], points[c[wide]])
        old_r, old_c = np.nonzero(self.row[mine] >= 0)
        touched = np.isin(old_r, r)
        old_r, old_c = old_r[touched], old_c[touched]
        rows = np.r_[r, old_r]
        cols = np.r_[points[c], self.row[mine][old_r, old_c]]
        scores = np.r_[new, self.score[mine][old_r, old_c]]
        top = best_of(rows, ids, cols, scores, k)
        rows, cols, scores = rows[top], cols[top], scores[top]
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        self.score[mine[rows], place], self.row[mine[rows], place] = scores, cols


def _search_length(rows: DataFrame, length: int, k: int) -> DataFrame:
    rows = stored(rows, "vector-rows")
    most = min(V.CELLS, max(1, V.CENTER_VALUES // length), max(1, rows.count() // CELL_ROWS))
    sample = V.sampled(rows, length)
    centers = sample[net(sample, 0, most)[0]]
    placed, cells = V.dealt(rows, centers)
    queries = stored(V.only_queries(placed), "vector-queries")
    norms = np.sqrt(np.einsum("ij,ij->i", centers, centers))

    def index(ids: np.ndarray, v: np.ndarray):
        search = Search(ids, v, k)

        def run(batch: pa.RecordBatch):
            least = batch.column("least").to_numpy() if "least" in batch.schema.names else None
            return search(batch.column("id").to_numpy(), V.matrix(batch.column("v")), least)

        return run

    usual = np.where(cells.count > k, 0.0, -np.inf)  # cells that can give k scores come first

    def promising(batch: pa.RecordBatch) -> np.ndarray:
        best = np.argmax(np.maximum(V.matrix(batch.column("v")) @ centers.T + usual, np.where(cells.count > 0, -1.7e308, -np.inf)), axis=1)
        return best[:, None] == np.arange(len(centers))[None, :]

    found = best_rows(V.searched(placed, queries, cells, promising, index, "long"), k)
    if len(centers) == 1:
        return found
    found = stored(found, "vector-found")
    reached = found.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("least"), F.count("*").alias("n"))
    queries = stored(queries.join(reached, "id", "left").select("id", "v", "cell", F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(NONE)).alias("least")), "vector-queries")
    worst = np.full(len(centers), np.inf)  # of each cell's queries
    for r in queries.groupBy("cell").agg(F.min("least").alias("least")).collect():
        worst[r.cell] = -np.inf if r.least == NONE else float(r.least)
    pairs = bound(centers @ centers.T, norms[:, None], norms[None, :], cells.query_radius[:, None], cells.radius[None, :]) >= worst[:, None]

    def unpruned(batch: pa.RecordBatch) -> np.ndarray:
        x, least = V.matrix(batch.column("v")), batch.column("least").to_numpy()
        own = bound(x @ centers.T, np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], norms[None, :], 0.0, cells.radius[None, :])
        return pairs[batch.column("cell").to_numpy()] & ~promising(batch) & (own >= np.where(least == NONE, -np.inf, least.astype(float))[:, None])

    rest = V.searched(placed, queries, cells, unpruned, index, "long")
    return best_rows(found.drop("rank").unionByName(rest), k)


def exact_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): exactly the ``k`` rows with the largest integer inner products per query.

    Every component x becomes floor(scale * x), x as double; ``is_query`` is a predicate on the column
    ``id``. Ties go to the smaller vec_id. Vectors that are null, empty, or hold
    null or non-finite components take no part, nor do rows with a null id; zero vectors do. Rows of
    different lengths have no inner product: a query's candidates are the rows of its own length. A query with
    fewer than ``k`` candidates gets all of them. Rows with the query's own id are no candidates;
    repeated rows are candidates as often as they occur; of rows that repeat a query's id the smallest vector asks.
    Other columns are not read. Scores are exact whole numbers; those beyond a long are ranked and
    returned as the largest (smallest) long.
    """

    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x
        y = F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # doubles beyond are whole numbers
        return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), y))

    rows = usable(vectors, vec_id, embedding).withColumn("v", F.transform("v", whole)).withColumn("q", F.coalesce(is_query, F.lit(False)))
    return by_length(rows, lambda df, length: _search_length(df, length, k), "long")


def op4_cover_tree(spark, sf_dir: str) -> DataFrame:
    return exact_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


#: The same by comparing every query with every row, for DuckDB.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5"""
