"""Joins and neighbours of wide vectors against whole distance tables."""

import math
from collections import Counter

import numpy as np
import pytest

from netloom.operators import nearest as nn
from netloom.operators.nearest import nearest_neighbours, nearest_vectors, vector_rows
from netloom.operators.vectors import vector_join
from netloom.runtime import cut


def clusters(n=240, d=24, seed=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, d)) * 6
    x = centres[draw.integers(0, 12, n)] + draw.normal(size=(n, d)) * 0.4
    x[:30] = x[0]  # a group of copies
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "key long, v array<double>")


def table_of(x, metric):
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1)[:, None]
        return 1 - u @ u.T
    gaps = np.abs(x[:, None] - x[None, :])
    return {
        "euclidean": lambda: np.sqrt((gaps**2).sum(2)), "sqeuclidean": lambda: (gaps**2).sum(2), "cityblock": lambda: gaps.sum(2), "chebyshev": lambda: gaps.max(2),
        "minkowski": lambda: (gaps**3).sum(2) ** (1 / 3),
    }[metric]()


@pytest.mark.parametrize(("metric", "bound"), [("euclidean", 2.6), ("cosine", 0.02), ("sqeuclidean", 6.5)])
def test_edges_against_all_pairs(spark, metric, bound):
    x = clusters()
    want = table_of(x, metric)
    found = vector_join(frame(spark, x), "key", "v", bound, metric, cell_rows=15)
    rows = found.edges().collect()
    got = {(r["source"], r["target"]): r["dist"] for r in rows}
    assert len(got) == len(rows)
    near = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if want[i, j] < bound - 1e-12}
    assert near <= got.keys() <= {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if want[i, j] < bound + 1e-12}
    assert all(abs(d - want[p]) < 1e-9 for p, d in got.items())
    assert len(near) > 1000
    counts = Counter(v for p in got for v in p)
    assert {r["id"]: r["n_links"] for r in found.link_counts().collect()} == {i: counts[i] for i in range(len(x))}
    assert found.compared < 0.35 * math.comb(len(x), 2)  # twelve clusters and a group of copies: a tenth of all pairs is near


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "cityblock", "chebyshev", "minkowski"])
def test_nearest_against_all_pairs(spark, metric):
    x, k = clusters(seed=9), 4
    want = table_of(x, metric)
    found = nearest_vectors(frame(spark, x), "key", "v", k, metric, cell_rows=16, p=3.0).collect()
    assert len(found) == k * len(x)
    for i in range(len(x)):
        mine = sorted((r["rank"], r["dist"], r["target"]) for r in found if r["source"] == i)
        assert [m[0] for m in mine] == list(range(1, k + 1))
        best = np.sort(np.delete(want[i], i))[:k]
        assert np.allclose([m[1] for m in mine], best, atol=1e-9)
        if i < 30:  # copies: the smallest other ids
            assert [m[2] for m in mine] == [j for j in range(k + 1) if j != i][:k]


def comparisons(points, k, metric="euclidean"):
    shared = points.sparkSession.sparkContext.broadcast(nn._cells(points, k, metric, 2.0))
    home = cut(nn.at_home(points, shared))
    near = cut(nn._first(nn._met(home, home, k, metric, 2.0, 500), k))
    own = Counter(r["cell"] for r in home.select("cell").collect())
    more = Counter(r["cell"] for r in nn.asking_elsewhere(home, near, k, metric, shared).select("cell").collect())
    return sum(n * (n + more[c]) for c, n in own.items())


def test_rows_ask_only_where_neighbours_can_be(spark):
    x = clusters(n=1200, d=16)
    points = cut(vector_rows(frame(spark, x[30:]), "key", "v", "euclidean"))
    assert comparisons(points, 6) < 0.2 * 1170**2


def test_a_plane_of_points_has_few_comparisons(spark):
    side = 60
    points = [(i * side + j, [float(i), float(j)]) for i in range(side) for j in range(side)]
    rows = cut(spark.createDataFrame(points, "id long, vec array<double>"))
    assert comparisons(rows, 3) < 0.12 * len(points) ** 2
    found = nearest_neighbours(rows.selectExpr("id", "vec[0] AS x", "vec[1] AS y"), "id", ["x", "y"], 2, cell_rows=64)
    assert found.count() == 2 * len(points) and found.where("dist > 1").count() == 0


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0, float("nan")]), (6, [1.0, 0.0]), (7, [-0.0, 0.0])]
    df = spark.createDataFrame(rows, "key long, v array<double>")
    assert sorted(tuple(r)[:2] for r in vector_join(df, "key", "v", 0.0, inclusive=True).edges().collect()) == [(0, 6), (3, 7)]
    assert sorted(tuple(r)[:2] for r in vector_join(df, "key", "v", 0.1, "cosine").edges().collect()) == [(0, 4), (0, 6), (4, 6)]
    near = {(r["source"], r["target"]): r["dist"] for r in nearest_vectors(df, "key", "v", 1).collect()}
    assert near == {(0, 6): 0.0, (6, 0): 0.0, (3, 7): 0.0, (7, 3): 0.0, (4, 0): 1.0}
    assert nearest_vectors(df.where("false"), "key", "v", 3).count() == 0
    assert vector_join(df.where("false"), "key", "v", 1.0).edges().count() == 0
    assert nearest_vectors(df.where("key = 0"), "key", "v", 3).count() == 0
    mixed = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "key long, v array<double>")
    with pytest.raises(ValueError, match="1 and of 2"):
        vector_join(mixed, "key", "v", 1.0)
    with pytest.raises(ValueError):
        vector_join(df, "key", "v", math.inf)


def test_blocks_of_wide_vectors_are_large_and_compared_in_parts(spark, monkeypatch):
    asked, cells = [], nn._cells
    monkeypatch.setattr(nn, "_cells", lambda points, k, metric, p, wanted: asked.append(wanted) or cells(points, k, metric, p, wanted))
    nearest_vectors(frame(spark, np.random.default_rng(1).normal(size=(4500, 8))), "key", "v", 2).count()
    assert asked == [1]
    x, y = np.random.default_rng(2).normal(size=(2, 50, 8))
    whole = nn._best("euclidean", x, y, 3, 2.0)
    monkeypatch.setattr(nn, "AT_ONCE", 350)
    assert all((a == b).all() for a, b in zip(whole, nn._best("euclidean", x, y, 3, 2.0), strict=True))
