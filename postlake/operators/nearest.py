"""Nearest vectors by cosine, through an inverted file of cells that is exact.

A bounded sample gives the centers of cells. Every vector lies in the cell of its nearest center, and a cell knows the
widest angle to its center. Each query first searches the cells nearest to it, which gives it a worst score that it has to beat; then it's sent to
those of the other cells whose angle lets them hold a better one. Vectors are shuffled twice, to their own cells, and queries once for each cell that they
have to see, so what is shuffled grows with the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.operators.stored import stored

#: Vectors sampled and cells at most, rounds of moving centers, cells that a query looks at first, and rows of a cell that one task holds.
SAMPLE, CELLS, ROUNDS, FIRST, TASK_ROWS = 4096, 128, 5, 4, 50_000
#: What rounding may add to an angle's cosine.
SLACK = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1)), 1e-300)[:, None]


def _centers(sample: np.ndarray, n: int) -> np.ndarray:
    """Centers of about even cells of the sample, by some rounds of moving them to their rows' mean."""
    units = _unit(sample)
    centers = units[np.linspace(0, len(units) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        near = (units @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, units)
        full = np.sqrt((sums**2).sum(axis=1)) > 1e-12
        centers[full] = _unit(sums[full])
    return centers


def _stacked(column: pd.Series) -> np.ndarray:
    return _unit(np.stack(column.to_numpy()).astype(float))


def _best(k: int):
    def best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        d = d.sort_values("id")
        own, ids, out = _stacked(d["v"]), d["id"].to_numpy(), []
        for at in range(0, len(q), 512):
            asked = q["id"].to_numpy()[at : at + 512]
            s = _stacked(q["v"].iloc[at : at + 512]) @ own.T
            s[asked[:, None] == ids[None, :]] = -np.inf
            if s.shape[1] > k:  # all that are as good as the k-th best, so that ties are settled by id
                worst = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                row, col = np.nonzero(s >= worst[:, None])
            else:
                row, col = np.nonzero(np.ones_like(s, dtype=bool))
            found = pd.DataFrame({"query_id": asked[row], "vec_id": ids[col], "similarity": s[row, col]})
            found = found[found["similarity"] > -np.inf].sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True], kind="stable")
            out.append(found.groupby("query_id").head(k))
        return pd.concat(out)

    return best


def nearest(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, vec_id, similarity): the ``k`` rows of highest cosine similarity of each query, itself left out, ties to the smaller id. Exact.

    Vectors are of one length; rows without id or vector take no part. A zero vector has similarity 0 to all.
    """
    rows = stored(vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0"), "vectors")
    n = rows.count()
    schema = "query_id long, vec_id long, similarity double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    sample = np.array([r.v for r in rows.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(SAMPLE).collect()])
    centers = _centers(sample, max(1, min(CELLS, int(len(sample) ** 0.5))))

    @F.pandas_udf("cell int, near double")
    def placed(v: pd.Series) -> pd.DataFrame:
        s = _stacked(v) @ centers.T
        return pd.DataFrame({"cell": s.argmax(axis=1).astype("int32"), "near": s.max(axis=1)})

    data = stored(rows.withColumn("p", placed("v")).select("id", "v", "q", "p.cell", "p.near"), "vector-cells")
    cells = data.groupBy("cell").agg(F.min("near").alias("near"), F.count("*").alias("n")).collect()  # CELLS rows at most
    widest = np.full(len(centers), np.nan)
    tasks = {c.cell: max(1, -(-c.n // TASK_ROWS)) for c in cells}
    for c in cells:
        widest[c.cell] = np.arccos(np.clip(c.near, -1, 1))

    @F.pandas_udf("array<struct<cell:int,most:double>>")
    def reached(v: pd.Series) -> pd.Series:
        """The cells, nearest first, with the best similarity that one of their rows can have."""
        angle = np.arccos(np.clip(_stacked(v) @ centers.T, -1, 1))
        most = np.cos(np.maximum(0, angle - widest[None, :])) + SLACK
        order = np.argsort(angle, axis=1, kind="stable")
        return pd.Series([[(int(c), float(m[c])) for c in o if not np.isnan(widest[c])] for o, m in zip(order, most, strict=True)], dtype=object)

    asked = stored(data.where("q").select("id", "v", reached("v").alias("cells")), "vector-queries")
    parts = F.element_at(F.create_map(*[F.lit(x) for pair in tasks.items() for x in pair]), F.col("cell"))
    dealt = data.select("id", "v", "cell", F.pmod(F.xxhash64("id"), parts).alias("part"))

    def searched(queries: DataFrame) -> DataFrame:
        """The best ``k`` of each query in each part of the cells that it's sent to (id, v, cell)."""
        sent = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
        return sent.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(_best(k), schema)

    first = stored(searched(asked.select("id", "v", F.explode(F.slice("cells", 1, FIRST)).alias("c")).select("id", "v", "c.cell")), "vectors-near")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    worst = first.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("worst"))
    rest = asked.join(worst, "id", "left").select("id", "v", "worst", F.explode(F.slice("cells", FIRST + 1, CELLS)).alias("c")).where("worst IS NULL OR c.most >= worst").select("id", "v", "c.cell")
    found = first.unionByName(searched(rest)).withColumn("place", place)
    return found.where(F.col("place") <= k).drop("place")
