from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import collision_search as A, cover_tree as C, vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n: int, d: int, seed: int, spread: float = 1.0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(1, n // 20), d))
    return (centers[rng.integers(0, len(centers), n)] + spread * rng.normal(size=(n, d))).astype(np.float32)


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if y is None else float(y) for y in v], 0) for i, v in zip(ids, x)], SCHEMA)


def brute(x: np.ndarray, ids: np.ndarray, every: int, k: int) -> dict[int, list[tuple[int, float]]]:
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = x @ x[q]
        keep = np.flatnonzero(ids != ids[q])
        order = keep[np.lexsort((ids[keep], -scores[keep]))][:k]
        out[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def result(df) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list] = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize(("n", "d", "spread"), [(900, 16, 1.0), (900, 32, 0.05), (60, 3, 1.0)])
def test_cover_tree_equals_brute_force(spark, monkeypatch, n, d, spread):
    monkeypatch.setattr(C, "CELL_ROWS", 20)  # many cells, several blocks in some
    monkeypatch.setattr(V, "LEAST_BLOCK", 40)
    monkeypatch.setattr(V, "QUERY_PART", 7)
    x, ids = vectors(n, d, n, spread), np.arange(n)
    got = result(C.exact_neighbours(table(spark, x), F.col("id") % 50 == 0, 5))
    want = brute(np.floor(256 * x.astype(float)), ids, 50, 5)
    assert got == {q: [(i, int(s)) for i, s in v] for q, v in want.items()}


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_cover_tree_covers_all_points(spread):
    x = np.repeat(np.random.default_rng(0).normal(size=(40, 8)) * 50 * (spread < 1), 100, axis=0) + np.random.default_rng(1).normal(size=(4000, 8))
    tree, leaves = C.cover_tree(x, leaf=16)
    assert len(leaves) > 100 and sorted(np.concatenate([n.points for n in leaves])) == list(range(4000))
    assert max(len(n.points) for n in leaves) <= 16
    todo = [tree]
    while todo:
        node = todo.pop()
        assert np.sqrt(((x[node.points] - node.center) ** 2).sum(1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == list(node.points)
            assert node.children[0].at == node.at and all(c.scale < node.scale or c.children for c in node.children)
            for c in node.children:  # a center lies within its parent's scale, and siblings are more than their own apart
                assert np.linalg.norm(c.center - node.center) <= node.scale * (1 + 1e-9)
            todo += node.children


@pytest.mark.parametrize(("n", "d", "spread"), [(2000, 2, 1.0), (2000, 8, 0.01), (300, 32, 1.0)])
def test_nets_keep_the_invariants_of_levels(n, d, spread):
    x = vectors(n, d, 4, spread).astype(float)
    at, gap, near = C.net(x, 0, 128)
    level = C.levels(gap)
    assert (np.diff(level) >= 0).all() and (np.diff(gap) <= 0).all() and (level[1:] >= 1).all()
    away = np.linalg.norm(x[:, None] - x[at][None, :], axis=2)
    assert np.allclose(away[np.arange(n), near], away.min(axis=1))
    for i in range(int(level.max())):
        above = np.flatnonzero(level <= i)
        apart = away[at[above]][:, above] + 1e9 * np.eye(len(above))
        assert apart.min() > gap[1] / 2**i * (1 - 1e-9)  # all centers of a level, not just siblings
        assert away[:, above].min(axis=1).max() <= gap[1] / 2**i * (1 + 1e-9)  # and they cover every row


def test_a_net_hangs_each_center_below_the_level_above():
    x = vectors(500, 3, 6).astype(float)
    root = C.Node(x, 0, np.arange(500))
    leaves = C.grow(x, root, 60)
    assert len(leaves) == 60 and len({n.at for n in leaves}) == 60
    at, gap, _ = C.net(x, 0, 60)
    level = dict(zip(at.tolist(), C.levels(gap).tolist()))
    todo = [root]
    while todo:
        node = todo.pop()
        for c in node.children or []:
            assert c.at == node.at or node.scale >= gap[1] / 2 ** (level[c.at] - 1) and level[node.at] < level[c.at]
            todo.append(c)


def test_tree_of_equal_rows_and_of_scales():
    x = np.r_[np.ones((500, 2)), 2.0 ** np.arange(300)[:, None] * np.ones(2)]
    _, leaves = C.cover_tree(x, leaf=4)
    assert sorted(np.concatenate([n.points for n in leaves])) == list(range(800)) and max((len(n.points) for n in leaves if n.radius > 0), default=0) <= 4


def test_dual_search_prunes_clustered_vectors():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(60, 32)) * 20
    x = np.floor(256 * (np.repeat(centers, 100, axis=0) + rng.normal(size=(6000, 32))))
    search = C.Search(np.arange(6000), x, 5)
    q = np.arange(0, 6000, 50)
    i, j, s = search(q, x[q])
    assert search.compared < 0.2 * len(q) * len(x)
    for n in range(len(q)):
        scores = x @ x[q[n]]
        scores[q[n]] = -np.inf
        assert list(j[i == n]) == list(np.lexsort((np.arange(6000), -scores))[:5])


def test_scores_beyond_double_precision_are_exact(spark):
    rng = np.random.default_rng(1)
    x = [[float(v) for v in rng.integers(-(2**22), 2**22, 4)] for _ in range(60)]  # scores up to 2^62
    x += [[v + w for v, w in zip(x[0], d)] for d in ((0, 0, 0, 1.0), (0, 0, 1.0, 0), (0, 1.0, 0, 0))]
    x += [[3e11, 4e11, 0.0, 0.0], [1e300, 1.0, 0.0, 0.0], [-1e300, 1.0, 0.0, 0.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = result(C.exact_neighbours(df, F.col("id") < 60, 5))
    whole = [[math.floor(256 * v) for v in row] for row in x]
    for q in range(60):
        scores = [max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[i])))) for i in range(len(x))]
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert got[q] == [(i, scores[i]) for i in order]


def test_collision_search_recall(spark):
    x, ids = vectors(1500, 24, 3), np.arange(1500)
    got = result(A.approximate_neighbours(table(spark, x), F.col("id") % 20 == 0, 20))
    want = brute(x.astype(float), ids, 20, 20)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, rows in got.items():
        for i, s in rows:
            assert s == pytest.approx(float(x[q].astype(float) @ x[i].astype(float)), abs=1e-9)


@pytest.mark.parametrize("search", [lambda df: C.exact_neighbours(df, F.col("id") % 50 == 0, 5), lambda df: A.approximate_neighbours(df, F.col("id") % 50 == 0, 5)])
def test_odd_vectors_and_ties(spark, search):
    nan, inf = float("nan"), float("inf")
    x = [[1.0, 0.0]] * 8 + [None, [None, 1.0], [nan, 1.0], [inf, 1.0], [], [1.0, 2.0, 3.0]] + [[0.5, 0.5]]
    df = table(spark, x, [0, 7, 6, 5, 4, 3, 2, 1, 50, 100, 150, 200, 250, 300, 8])
    assert [i for i, _ in result(search(df))[0]] == [1, 2, 3, 4, 5]
    assert set(result(search(df))) == {0}  # 300 has a length of its own and no candidates
    assert result(search(df.limit(0))) == {}
    few = table(spark, [[1.0, 0.0], [0.0, 1.0]])
    assert len(result(search(few))[0]) == 1


def test_zero_vectors_take_part_in_the_exact_search_only(spark):
    df = table(spark, [[1.0, 0.0], [0.0, 0.0], [-1.0, 0.0]])
    assert [i for i, _ in result(C.exact_neighbours(df, F.col("id") == 0, 5))[0]] == [1, 2]
    assert [i for i, _ in result(A.approximate_neighbours(df, F.col("id") == 0, 5))[0]] == [2]


def test_huge_and_tiny_components_end_the_search(spark):
    x = [[1e200, 0.0], [1e-200, 1e-200], [1e180, -1e200], [3.0, 4.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {i for i, _ in result(A.approximate_neighbours(df, F.col("id") == 3, 5))[3]} == {0, 1, 2}


@pytest.mark.parametrize("search", [lambda df: C.exact_neighbours(df, F.col("id") % 10 == 0, 5), lambda df: A.approximate_neighbours(df, F.col("id") % 10 == 0, 5)])
def test_each_length_is_searched_among_its_own(spark, search):
    rng = np.random.default_rng(5)
    x = [list(rng.normal(size=2 + i % 3)) for i in range(90)]
    got = result(search(table(spark, x)))
    assert set(got) == set(range(0, 90, 10))
    assert all(len(rows) == 5 and {len(x[i]) for i, _ in rows} == {len(x[q])} for q, rows in got.items())


@pytest.mark.parametrize("search", [lambda df: C.exact_neighbours(df, F.col("id") == 0, 5), lambda df: A.approximate_neighbours(df, F.col("id") == 0, 5)])
def test_repeated_rows(spark, search):
    df = table(spark, [[1.0, 0.0], [1.0, 0.0], [0.5, 0.5], [1.0, 1.0], [1.0, 1.0], [0.0, 1.0]], [0, 0, 0, 3, 3, 4])
    assert [i for i, _ in result(search(df))[0]] == [3, 3, 4]  # the query is the smallest vector of its id, (0.5, 0.5)


def test_windows_widen_until_enough_collide(spark, monkeypatch):
    monkeypatch.setattr(A, "ENOUGH", 0.0)
    monkeypatch.setattr(A, "FEW", 0)  # windows so narrow that queries end short and are asked again
    monkeypatch.setattr(A, "CELL_ROWS", 50)
    monkeypatch.setattr(V, "LEAST_BLOCK", 60)
    x = vectors(400, 12, 9)
    got = result(A.approximate_neighbours(table(spark, x), F.col("id") % 40 == 0, 20))
    assert set(got) == set(range(0, 400, 40)) and all(len(rows) == 20 for rows in got.values())


def test_entries_that_newly_enter_are_all_that_is_counted():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16))
    space = A.Space(16, 1.0, float(np.sqrt((v**2).sum(1)).max()))
    block = A.Block(space, np.arange(300), v, 300)
    width = np.full(10, 0.9)
    i, j, _ = block.search(np.full(10, -1), v[:10], width)
    hits = (np.abs(space.rows(v)[None, :, :] - space.queries(v[:10])[:, None, :]) <= 0.9).sum(axis=2) >= space.least
    assert {(a, b) for a, b in zip(*np.nonzero(hits))} == set(zip(i.tolist(), j.tolist()))


def test_windows_stay_narrow_where_near_vectors_are_found():
    rng = np.random.default_rng(8)
    v = np.repeat(rng.normal(size=(40, 32)), 100, axis=0) + 0.02 * rng.normal(size=(4000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    space = A.Space(32, 1.0, float(np.sqrt((v**2).sum(1)).max()))
    block, asked = A.Block(space, np.arange(4000), v, 20), np.arange(0, 4000, 100)
    i, j, s = block.search(asked, v[asked], np.full(40, 0.4 * space.most))
    assert block.counted < 0.5 * len(asked) * v.shape[0] * A.DIRECTIONS and block.verified < 0.1 * len(asked) * len(v)
    for n, q in enumerate(asked):
        scores = v @ v[q]
        scores[q] = -np.inf
        assert len(set(j[i == n]) & set(np.argsort(-scores)[:20])) >= 18
        width = float(space.enough(np.sort(scores)[-20], np.linalg.norm(v[q])))
        assert 0 < width < 2 * space.most and space.enough(np.nan, 1.0) == np.inf


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_the_promising_cell_narrows_the_others_without_loss(spark, monkeypatch, spread):
    monkeypatch.setattr(A, "CELL_ROWS", 60)
    monkeypatch.setattr(V, "LEAST_BLOCK", 70)
    monkeypatch.setattr(V, "QUERY_PART", 5)
    x, ids = vectors(1200, 16, 11, spread), np.arange(1200)
    got = result(A.approximate_neighbours(table(spark, x), F.col("id") % 30 == 0, 20))
    want = brute(x.astype(float), ids, 30, 20)
    assert set(got) == set(want) and all(len({i for i, _ in rows}) == 20 for rows in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
