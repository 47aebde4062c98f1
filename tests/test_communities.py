"""Planted communities and invariants every algorithm must keep."""

import itertools
import time

import pytest

from netloom.operators.community import ALGORITHMS, dealt, detect, divide, moves, quality
from netloom.operators.graph import build_graph
from netloom.plans import ENTRIES, communities

# four complete groups of five in a ring, and a separate triangle
RING = [(5 * c + i, 5 * c + j) for c in range(4) for i, j in itertools.combinations(range(5), 2)]
RING += [(5 * c, (5 * c + 6) % 20) for c in range(4)]
RING += [(20, 21), (21, 22), (20, 22)]
OPTIONS = {"EdgeBetweenness": {"batch": 4}, "SpinGlass": {"cooling": 0.8, "stop": 0.05}}


@pytest.fixture(scope="module")
def ring(spark):
    return build_graph(spark.createDataFrame(RING, "source long, target long"))


@pytest.mark.parametrize("name", sorted(ALGORITHMS))
def test_planted_groups(spark, ring, name):
    member = detect(ring, name, **OPTIONS.get(name, {}))
    rows = {r["vid"]: r["community"] for r in member.collect()}
    assert sorted(rows) == list(range(23)) and len(rows) == member.count()
    labels = sorted(set(rows.values()))
    assert labels == list(range(len(labels)))
    groups = sorted(sorted(v for v in rows if rows[v] == c) for c in labels)
    if name != "LeadingEigenvector":  # equal eigenvalues leave its cut open
        assert groups == [list(range(5 * c, 5 * c + 5)) for c in range(4)] + [[20, 21, 22]]
    assert quality.modularity(ring, member).first()[0] > 0.3


def test_spin_glass_offers_spins_that_no_neighbour_has(spark):
    # at this rate every vertex is best off alone, and there are five spins to spare
    pairs = list(itertools.combinations(range(20), 2))
    graph = build_graph(spark.createDataFrame(pairs, "source long, target long"))
    member = detect(graph, "SpinGlass", gamma=50.0, start=0.001)
    assert member.select("community").distinct().count() == 20


def _jobs(spark, graph, algorithm, **options):
    """Jobs of a run that ends because its rounds are used up."""
    group = f"{algorithm} {moves.MAX_ROUNDS} {options}"
    spark.sparkContext.setJobGroup(group, group)
    with pytest.raises(RuntimeError):
        detect(graph, algorithm, **options)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    time.sleep(1)  # the tracker hears of jobs a little later
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_heated_round_is_one_job(spark, ring, monkeypatch):
    monkeypatch.setattr(moves, "MAX_ROUNDS", 0)  # no cold rounds
    assert _jobs(spark, ring, "SpinGlass", stop=0.99**11.5) - _jobs(spark, ring, "SpinGlass", stop=0.99**1.5) == 10


@pytest.mark.parametrize("name", ["MultiLevel", "Leiden"])
def test_a_round_of_moves_on_a_small_level_writes_once(spark, ring, monkeypatch, name):
    monkeypatch.setattr(moves, "MAX_ROUNDS", 1)
    one = _jobs(spark, ring, name)
    monkeypatch.setattr(moves, "MAX_ROUNDS", 3)
    assert _jobs(spark, ring, name) - one <= 2 * 5  # the round, and broadcasts of the totals and masses it joins


@pytest.mark.parametrize("name", ["community_spin_glass", "community_planted_spin_glass"])
def test_spin_glass_queries_run_the_whole_schedule(spark, monkeypatch, name):
    asked = []

    def noted(graph, algorithm, **options):
        asked.append((algorithm, options))
        return graph.vertices.selectExpr("vid", "0 as community")

    monkeypatch.setattr(communities, "detect", noted)
    ENTRIES[name].run(spark, "/root/testdata/sf0.001")
    assert asked == [("SpinGlass", {})]


def test_small_communities_are_split_in_one_task(spark, monkeypatch):
    # groups of 3, 5 and 8, one joined with the next
    ends = (0, 3, 8, 16)
    pairs = [p for a, b in itertools.pairwise(ends) for p in itertools.combinations(range(a, b), 2)] + [(2, 3), (7, 8)]
    graph = build_graph(spark.createDataFrame(pairs, "source long, target long"))
    spark.sparkContext.setJobGroup("split", "split")
    split = {r["vid"]: r["community"] for r in detect(graph, "LeadingEigenvector").collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    time.sleep(1)  # the tracker hears of jobs a little later
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("split")) < 60  # the cycles of the first split alone take more
    monkeypatch.setattr(divide, "COMMUNITY_ARCS", 30)  # the whole graph is split by jobs, its parts are not
    assert split == {r["vid"]: r["community"] for r in detect(graph, "LeadingEigenvector").collect()}


def _apart(edges, vertices):
    """Components, as sorted lists."""
    of = {v: v for v in vertices}
    for _ in vertices:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    return sorted(sorted(v for v in of if of[v] == c) for c in set(of.values()))


def _shares(edges, vertices):
    """Shortest paths through every edge, over all pairs of vertices."""
    near = {v: [b if a == v else a for a, b in edges if v in (a, b)] for v in vertices}
    share = dict.fromkeys(edges, 0.0)
    for s, t in itertools.combinations(vertices, 2):
        paths = [[s]]
        while paths and not any(p[-1] == t for p in paths):
            paths = [[*p, n] for p in paths for n in near[p[-1]] if n not in p] if len(paths[0]) <= len(vertices) else []
        paths = [p for p in paths if p[-1] == t]
        for p in paths:
            for a, b in itertools.pairwise(p):
                share[min(a, b), max(a, b)] += 1 / len(paths)
    return share


def _girvan_newman(edges, vertices):
    """The best components while single edges go, the most used first."""
    def quality(parts):
        degree = {v: sum(v in e for e in edges) for v in vertices}
        inner = lambda p: sum(a in p and b in p for a, b in edges)
        return sum(inner(p) / len(edges) - (sum(degree[v] for v in p) / 2 / len(edges)) ** 2 for p in parts)

    left, best = list(edges), _apart(edges, vertices)
    while left:
        share = _shares(left, vertices)
        left.remove(min(left, key=lambda e: (-round(share[e], 9), e)))
        parts = _apart(left, vertices)
        if quality(parts) > quality(best) + 1e-9:
            best = parts
    return best


# two triangles with a bridge; a path with a triangle at its end; a separate edge
SMALL = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (6, 7), (7, 8), (8, 9), (9, 10), (8, 10), (11, 12)]


def test_edge_betweenness_removes_one_edge_at_a_time(spark):
    graph = build_graph(spark.createDataFrame(SMALL, "source long, target long"))
    member = {r["vid"]: r["community"] for r in detect(graph, "EdgeBetweenness").collect()}
    name = {r["vid"]: r["name"] for r in graph.vertices.collect()}
    groups = sorted(sorted(int(name[v]) for v in member if member[v] == c) for c in set(member.values()))
    assert groups == _girvan_newman(SMALL, range(13))


def test_small_components_lose_their_edges_in_one_task(spark, monkeypatch):
    graph = build_graph(spark.createDataFrame(SMALL, "source long, target long"))
    spark.sparkContext.setJobGroup("whole", "whole")
    whole = {r["vid"]: r["community"] for r in detect(graph, "EdgeBetweenness").collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    time.sleep(1)  # the tracker hears of jobs a little later
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole")) < 150  # a round for each of seven removals takes more
    monkeypatch.setattr(divide, "WHOLE_VERTICES", 3)  # the largest component is broken up in rounds, its triangles are not
    assert whole == {r["vid"]: r["community"] for r in detect(graph, "EdgeBetweenness").collect()}


@pytest.mark.parametrize("name", ["community_edge_betweenness", "community_planted_edge_betweenness"])
def test_edge_betweenness_queries_remove_one_edge_at_a_time(spark, monkeypatch, name):
    asked = []

    def noted(graph, algorithm, **options):
        asked.append((algorithm, options.get("batch", 1)))
        return graph.vertices.selectExpr("vid", "0 as community")

    monkeypatch.setattr(communities, "detect", noted)
    ENTRIES[name].run(spark, "/root/testdata/sf0.001")
    assert asked == [("EdgeBetweenness", 1)]


@pytest.mark.parametrize(("name", "options"), [("SpinGlass", {"cooling": 0.7, "stop": 0.1, "seed": 3}), ("Leiden", {}), ("Leiden", {"objective_name": "CPM", "resolution": 0.2}), ("MultiLevel", {"seed": 5})])
def test_rounds_over_slices_find_what_joins_find(spark, monkeypatch, name, options):
    monkeypatch.setattr(dealt, "ROWS", 6)  # several slices
    pairs = [*RING, *((i, 5 * i % 23) for i in range(23))]
    graph = build_graph(spark.createDataFrame(pairs, "source long, target long"))
    in_slices = sorted(map(tuple, detect(graph, name, **options).collect()))
    monkeypatch.setattr(dealt, "fits", lambda level: False)
    assert in_slices == sorted(map(tuple, detect(graph, name, **options).collect()))


@pytest.mark.parametrize("name", ["MultiLevel", "Leiden"])
def test_a_round_over_slices_is_one_job(spark, ring, monkeypatch, name):
    monkeypatch.setattr(moves, "MAX_ROUNDS", 1)
    one = _jobs(spark, ring, name)
    monkeypatch.setattr(moves, "MAX_ROUNDS", 3)
    assert _jobs(spark, ring, name) - one == 2
