"""Graphs that tasks hold whole, against searches by joins and against plain ones."""

import random
import time

import numpy as np
import pytest

from netloom.operators import centrality, traverse, whole
from netloom.operators.graph import build_graph


def random_graph(spark, n, m, directed):
    draw = random.Random(n + m)
    pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(0, v) for v in range(1, 100)]  # a hub, loops and repeats
    vertices = spark.createDataFrame([(i,) for i in range(n)], "name long")
    return build_graph(spark.createDataFrame(pairs, "s long, t long"), vertices, directed=directed)


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    time.sleep(1)  # the tracker hears of jobs a little later
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("directed", [False, True])
def test_searches_in_tasks_find_what_joins_find(spark, monkeypatch, directed):
    graph = random_graph(spark, 130, 160, directed)

    def found():
        hops, sums = traverse.all_hops(graph, words=1)
        shares = [sorted((r[0], round(r[-1], 6)) for r in f(graph).collect()) for f in (centrality.betweenness, lambda g: centrality.betweenness(g, pivots=20))]
        edges = sorted((r[0], r[1], round(r[2], 6)) for r in centrality.edge_betweenness(graph).collect())
        return hops, sorted(map(tuple, sums.collect())), shares, edges

    in_tasks = found()
    monkeypatch.setattr(whole, "WHOLE_ARCS", 0)
    assert in_tasks == found()


def test_jobs_do_not_grow_with_the_hops(spark):
    """Fifty levels of a path: a search by joins takes several jobs for each."""
    path = build_graph(spark.createDataFrame([(i, i + 1) for i in range(50)], "s long, t long"))
    assert jobs(spark, "hops", lambda: traverse.hop_histogram(path)) < 25
    assert jobs(spark, "closeness", lambda: traverse.closeness(path)) < 25
    assert jobs(spark, "betweenness", lambda: centrality.betweenness(path)) < 25


def test_a_graph_without_arcs(spark):
    vertices = spark.createDataFrame([(i,) for i in range(3)], "name long")
    graph = build_graph(spark.createDataFrame([(1, 1)], "s long, t long"), vertices)
    assert traverse.all_hops(graph)[0] == [(0, 3)]
    assert [tuple(r) for r in traverse.closeness(graph).orderBy("vid").collect()] == [(v, -1.0) for v in range(3)]
    assert [r[1] for r in centrality.betweenness(graph).collect()] == [0.0] * 3


def test_pieces_and_ranks():
    assert whole.pieces(7, np.array([5, 1, 2]), np.array([1, 6, 3])).tolist() == [0, 1, 2, 2, 4, 1, 1]
    assert whole.ranks(np.array([4, 1, 4, 1, 4])).tolist() == [0, 0, 1, 1, 2]
    assert whole.ranks(np.array([4, 1, 4, 1, 4]), np.array([9, 2, 8, 1, 7])).tolist() == [2, 1, 1, 0, 0]


@pytest.mark.parametrize(("n", "m", "seed"), [(60, 55, 1), (200, 210, 2), (300, 700, 3), (40, 0, 4)])
def test_diameter_of_a_held_graph(spark, n, m, seed):
    """Against searches from every vertex; nothing is left to chance by the bounds."""
    draw = np.random.default_rng(seed)
    ends = np.vstack([draw.integers(0, n, (m, 2)), [[i, i + 1] for i in range(0, n - 1, 3)]])
    ends = ends[ends[:, 0] != ends[:, 1]]
    arcs = whole.Net(np.arange(n), np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]]), ())
    order = np.argsort(arcs.src, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(arcs.src, minlength=n)))
    want = max(int(whole._hops(starts, arcs.dst[order], np.array([v])).max()) for v in range(n))
    assert whole.diameter(spark, arcs)[0] == want


def test_few_searches_settle_a_diameter(spark, monkeypatch):
    """A random graph, where the fringe of a middle vertex is half of it."""
    draw = np.random.default_rng(1)
    n, ends = 20_000, draw.integers(0, 20_000, (60_000, 2))
    arcs = whole.Net(np.arange(n), np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]]), ())
    assert whole.diameter(spark, arcs)[1] < n / 4
