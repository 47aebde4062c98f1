"""Hand-worked graphs with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import centrality, cliques, components, graph as gb, links as lk, metrics, summary, traverse


def make(spark, pairs, directed=False, vertices=None):
    edges = spark.createDataFrame(pairs, "source long, target long")
    if vertices is not None:
        vertices = spark.createDataFrame([(v,) for v in vertices], "name long")
    return gb.build_graph(edges, vertices, directed)


PATH = [(0, 1), (1, 2), (2, 3), (3, 4)]
STAR = [(0, i) for i in range(1, 6)]
FULL = list(itertools.combinations(range(5), 2))


def test_path_summary(spark):
    row = summary.summarize(make(spark, PATH)).first()
    assert (row["vertices"], row["edges"], row["max_degree"], row["diameter"]) == (5, 4, 2, 4)
    assert row["avg_path"] == 2.0 and row["clustering"] == 0.0 and row["clique_number"] == 2
    assert row["density"] == 0.4


def test_loop_repeat_and_isolated(spark):
    g = make(spark, [(0, 0), (0, 1), (0, 1)], vertices=[0, 1, 2])
    assert {r["vid"]: r["degree"] for r in metrics.degrees(g).collect()} == {0: 4, 1: 2, 2: 0}
    assert [tuple(r) for r in gb.simplify(g).collect()] == [(0, 1)]
    assert {r["vid"]: r["closeness"] for r in traverse.closeness(g).collect()} == {0: 1.0, 1: 1.0, 2: -1.0}


def test_betweenness_star_and_repeats(spark):
    got = {r[0]: r[1] for r in centrality.betweenness(make(spark, STAR)).collect()}
    assert got[0] == 10.0 and got[3] == 0.0
    # two ways 0-1-3 through a doubled edge, one way 0-2-3
    doubled = make(spark, [(0, 1), (0, 1), (1, 3), (0, 2), (2, 3)])
    got = {r[0]: r[1] for r in centrality.betweenness(doubled).collect()}
    assert got[1] == pytest.approx(2 / 3, abs=1e-4) and got[2] == pytest.approx(1 / 3, abs=1e-4)


def test_directed_cycle(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 0)], directed=True)
    row = traverse.path_measures(traverse.hop_histogram(g)).first()
    assert (row["diameter"], row["avg_path"]) == (2, 1.5)
    assert {r[0]: r[1] for r in centrality.betweenness(g).collect()} == {0: 1.0, 1: 1.0, 2: 1.0}
    ranks = [r["pagerank"] for r in centrality.pagerank(g).collect()]
    assert ranks == pytest.approx([1 / 3] * 3)


def test_pagerank_with_dangling_vertex(spark):
    g = make(spark, [(0, 1), (1, 2), (0, 2)], directed=True)
    x = [1 / 3] * 3
    for _ in range(300):
        spread = 0.85 * x[2] / 3 + 0.05
        x = [spread, spread + 0.85 * x[0] / 2, spread + 0.85 * (x[0] / 2 + x[1])]
    got = {r["vid"]: r["pagerank"] for r in centrality.pagerank(g).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(x, abs=1e-8)


def test_sliced_hubs_send_everything(spark):
    g = make(spark, STAR + [(1, 2)])
    arcs = lk.both_ways(gb.simplify(g))
    plain, sliced = lk.prepare(arcs), lk.prepare(arcs, hub_arcs=2)
    assert sliced.hubs is not None
    state = g.vertices.select("vid", F.col("vid").alias("x"))
    rows = [sorted(tuple(r) for r in l.send(state).select("vid", "dst", "x").collect()) for l in (plain, sliced)]
    assert rows[0] == rows[1] and len(rows[0]) == 12


def test_cliques_and_cores(spark):
    g = make(spark, FULL + [(4, 5), (5, 6), (6, 4), (6, 7)])
    assert cliques.clique_number(g) == 5
    cores = {r[0]: r[1] for r in cliques.core_numbers(g).collect()}
    assert cores == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 2, 6: 2, 7: 1}
    assert metrics.triangle_count(g).first()[0] == 11


def test_components_of_a_long_chain(spark):
    n = 300
    g = make(spark, [(i, i + 1) for i in range(n) if i != 150])
    found = {r[0]: r[1] for r in components.connected_components(g, max_rounds=40).collect()}
    assert set(found.values()) == {0, 151} and found[150] == 0 and found[300] == 151


def test_shortest_path(spark):
    g = make(spark, [(0, 1), (1, 3), (0, 2), (2, 3), (3, 4), (6, 5)])
    assert [r["vid"] for r in traverse.shortest_path(g, 0, 4).collect()] == [0, 1, 3, 4]
    assert traverse.shortest_path(g, 0, 5).count() == 0
    assert [r["label"] for r in traverse.shortest_path(g, 2, 2).collect()] == ["2"]


def test_batched_sources_give_the_same(spark):
    g = make(spark, PATH + [(4, 0)])
    whole = sorted(map(tuple, traverse.hop_histogram(g).collect()))
    parts = sorted(map(tuple, traverse.hop_histogram(g, state_rows=10).collect()))
    assert whole == parts == [(1, 10), (2, 10)]


def test_missing_ends(spark):
    edges = spark.createDataFrame([(0, 9)], "source long, target long")
    vertices = spark.createDataFrame([(0,)], "name long")
    with pytest.raises(ValueError):
        gb.build_graph(edges, vertices)
    assert gb.build_graph(edges, vertices, missing="drop").edges.count() == 0
    assert gb.build_graph(edges, vertices, missing="add").vertices.count() == 2


def test_overlay_rejects_unknown_target(spark):
    a, b = make(spark, [(0, 1)]), make(spark, [(10, 11)])
    relation = spark.createDataFrame([(0, 10), (77, 11)], "a long, b long")
    stack = gb.overlay([a, b], [None, relation])
    assert [tuple(r) for r in stack.links.collect()] == [(0, 2, 1, 3.0)]
    bad = spark.createDataFrame([(0, 99)], "a long, b long")
    with pytest.raises(ValueError):
        gb.overlay([a, b], [None, bad])


def test_repeated_and_null_ids_are_refused(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", None)], "s string, t string")
    with pytest.raises(ValueError, match="null end"):
        gb.build_graph(edges)
    graph = gb.build_graph(edges, missing="drop")
    assert graph.vertices.count() == 2 and graph.edges.count() == 1
    twice = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    with pytest.raises(ValueError, match="repeated"):
        gb.build_graph(edges.na.drop(), twice)


def test_neighbourhood_function_of_a_path(spark):
    path = gb.build_graph(spark.createDataFrame([(i, i + 1) for i in range(9)], "s long, t long"))
    got = {r["hops"]: r["pairs"] for r in traverse.neighbourhood_function(path).collect()}
    assert got == {h: 10 + 2 * sum(10 - k for k in range(1, h + 1)) for h in range(10)}


def test_clique_search_is_deep_and_exact():
    assert cliques.largest_clique([((1 << 1500) - 1) & ~(1 << v) for v in range(1500)]) == 1500
    draw = random.Random(3)
    for n in (1, 6, 12):
        for _ in range(20):
            near = [set() for _ in range(n)]
            for a, b in itertools.combinations(range(n), 2):
                if draw.random() < 0.6:
                    near[a].add(b), near[b].add(a)
            most = max(k for k in range(1, n + 1) if any(all(b in near[a] for a, b in itertools.combinations(c, 2)) for c in itertools.combinations(range(n), k)))
            assert cliques.largest_clique([sum(1 << w for w in x) for x in near]) == most
    assert cliques.largest_clique([0, 0], floor=4) == 4


def random_graph(spark, n, m, seed, directed=False):
    draw = random.Random(seed)
    pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
    vertices = spark.createDataFrame([(i,) for i in range(n)], "name long")
    return pairs, gb.build_graph(spark.createDataFrame(pairs, "s long, t long"), vertices, directed=directed)


def plain_hops(pairs, n, both):
    near = [set() for _ in range(n)]
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            if both:
                near[b].add(a)
    out = {}
    for s in range(n):
        d, at, last = {s: 0}, 0, {s}
        while last:
            at += 1
            last = {w for v in last for w in near[v] if w not in d}
            d.update(dict.fromkeys(last, at))
        out[s] = d
    return out


@pytest.mark.parametrize("directed", [False, True])
def test_bits_against_plain_searches(spark, directed):
    n = 150  # three words of bits, the last not full
    pairs, graph = random_graph(spark, n, 190, 5, directed)
    hops = plain_hops(pairs, n, not directed)
    want = {}
    for d in hops.values():
        for x in d.values():
            want[x] = want.get(x, 0) + 1
    for kw in ({}, {"words": 1}):
        found, sums = traverse.all_hops(graph, **kw)
        assert dict(found) == want
        far = {v: [0, 0] for v in range(n)}
        for s, d in hops.items():
            for v, x in d.items():
                far[v][0] += x
                far[v][1] += v != s
        assert {r["vid"]: [r["far"], r["reached"]] for r in sums.collect()} == far


def stars(spark, n, size):
    return make(spark, [(size * k, size * k + i) for k in range(n) for i in range(1, size)])


def test_components_are_searched_side_by_side(spark):
    """Three stars of 70 share two batches of 64 places, where 210 vertices in a row would take four."""
    graph = stars(spark, 3, 70)
    assert [used for used, _ in traverse._batches(graph, 1, None)] == [1, 1]
    found, sums = traverse.all_hops(graph, words=1)
    assert found == [(0, 210), (1, 3 * 69 * 2), (2, 3 * 69 * 68)]
    far = {r["vid"]: (r["far"], r["reached"]) for r in sums.collect()}
    assert far == {v: (69 if v % 70 == 0 else 1 + 2 * 68, 69) for v in range(210)}


def test_a_batch_takes_two_thousand_sources(spark):
    assert [used for used, _ in traverse._batches(stars(spark, 1, 2000), traverse.WORDS, None)] == [32]


def test_source_batches_count_what_sources_reach(spark):
    graph = stars(spark, 6, 5)
    assert len(list(traverse.source_batches(graph, 150))) == 1  # 6 · 5² rows, not 30²
    assert len(list(traverse.source_batches(graph, 75))) == 2


def test_state_is_not_broadcast(spark):
    graph = make(spark, STAR)
    plan = lk.simple_links(graph).send(graph.vertices.select("vid"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize(("n", "m"), [(60, 55), (5, 0)])
def test_fringe_diameter(spark, n, m):
    pairs, graph = random_graph(spark, n, max(m, 1), n + m) if m else ([], gb.build_graph(spark.createDataFrame([], "s long, t long"), spark.createDataFrame([(i,) for i in range(n)], "name long")))
    want = max(max(d.values()) for d in plain_hops(pairs, n, True).values())
    assert traverse.exact_diameter(graph)[0] == want


def test_fringe_diameter_searches_from_few(spark):
    """A tree of 100,000 vertices: a handful of searches, where all pairs would take 100,000."""
    n = 100_000
    edges = spark.range(1, n).selectExpr("id AS s", "(id - 1) div 50 AS t")
    found, searched = traverse.exact_diameter(gb.build_graph(edges, scan=True))
    depth = lambda v: 0 if v == 0 else 1 + depth((v - 1) // 50)
    assert found == 2 * depth(n - 1)
    assert searched <= 64 * traverse.WORDS


def test_sketches_stay_within_their_error(spark):
    n = 1000
    pairs, graph = random_graph(spark, n, 2500, 11)
    exact = {r["vid"]: r["closeness"] for r in traverse.closeness(graph).collect()}
    got = {r["vid"]: r for r in traverse.sketch_closeness(graph).collect()}
    errors = [abs(got[v]["closeness"] - c) / c for v, c in exact.items() if c > 0]
    assert got.keys() == exact.keys()
    assert sorted(errors)[len(errors) * 95 // 100] < 0.06
    assert all((got[v]["closeness"] == -1.0) == (c == -1.0) for v, c in exact.items())
    true = 0
    histogram = dict(traverse.all_hops(graph)[0])
    for r in sorted(traverse.neighbourhood_function(graph).collect()):
        true += histogram[r["hops"]]
        assert abs(r["pairs"] - true) <= 0.05 * true


def test_effective_diameter(spark):
    frame = lambda rows: spark.createDataFrame(rows, "hops int, pairs long")
    assert traverse.effective_diameter(frame([(0, 10), (1, 50), (2, 100)])) == 1.8
    assert traverse.effective_diameter(frame([(0, 10)])) == 0.0
    assert traverse.effective_diameter(frame([])) == 0.0
