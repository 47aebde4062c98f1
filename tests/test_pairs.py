"""Similarity joins against brute force, hot cells included."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import pairs
from netloom.operators.nearest import nearest_neighbours
from netloom.operators.pairs import similarity_edges
from netloom.plans import fixtures

RNG = np.random.default_rng(5)
POINTS = np.vstack([RNG.normal(size=(60, 2)), np.zeros((40, 2)), RNG.normal(size=(20, 2)) * 1e-3])


def _frame(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double")


@pytest.mark.parametrize("bound", [0.3, math.inf])
def test_hot_cells_keep_every_pair(spark, bound):
    out = similarity_edges(_frame(spark, POINTS), "id", ["x", "y"], "euclidean", bound, tile_rows=7).collect()
    want = {
        (i, j)
        for i, j in itertools.combinations(range(len(POINTS)), 2)
        if np.linalg.norm(POINTS[i] - POINTS[j]) < bound
    }
    assert len(out) == len(want) and {(r["source"], r["target"]) for r in out} == want


def test_missing_coordinates_make_no_pairs(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, None, 1.0), (2, 1.0, 1.0)], "id long, x double, y double")
    assert [tuple(r) for r in similarity_edges(df, "id", ["x", "y"]).collect()] == [(0, 2, 0.0)]


def test_equal_blocks_with_copies(spark):
    rows = [(i, float(i % 3), float(i % 2), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {(r[0], r[1]) for r in similarity_edges(df, "id", ["a", "b", "c"], "hamming", 0.5, tile_rows=5).collect()}
    want = {
        (p[0], q[0]) for p, q in itertools.combinations(rows, 2) if sum(x != y for x, y in zip(p[1:], q[1:])) / 3 < 0.5
    }
    assert got == want


def test_nearest_with_copies(spark):
    k = 4
    out = nearest_neighbours(_frame(spark, POINTS), "id", ["x", "y"], k, cell_rows=10).collect()
    assert len(out) == k * len(POINTS)
    for i, p in enumerate(POINTS):
        ranked = sorted((np.linalg.norm(p - q), j) for j, q in enumerate(POINTS) if j != i)[:k]
        mine = sorted((r["rank"], r["target"], r["dist"]) for r in out if r["source"] == i)
        assert [t for _, t, _ in mine] == [j for _, j in ranked]


def test_tiny_bounds_on_large_values(spark):
    df = spark.createDataFrame([(0, 1e9), (1, 1e9), (2, 1e9 + 1e-6), (3, -5.0)], "id long, x double")
    for bound, inclusive in ((0.0, True), (1e-10, False)):
        rows = similarity_edges(df, "id", ["x"], "euclidean", bound, inclusive=inclusive).collect()
        assert [(r["source"], r["target"], r["dist"]) for r in rows] == [(0, 1, 0.0)]
    assert similarity_edges(df, "id", ["x"], "euclidean", 0.0).count() == 0


def test_a_bound_that_spans_the_data_is_announced(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "id long, x double")
    with pytest.warns(UserWarning, match="100.0"):
        assert similarity_edges(df, "id", ["x"], "euclidean", 100.0).count() == 1


def test_tasks_follow_the_pairs_compared(spark, monkeypatch):
    """A key with many rows gets tasks by what it compares, not by the bytes of its rows."""
    df = spark.range(200).selectExpr("id", "cast(id < 0 AS int) AS k")
    monkeypatch.setattr(pairs, "TASK_PAIRS", 1000)
    joined = pairs.tiled_join(df, df, ["k"], F.col("a.id") < F.col("b.id"), 20)
    assert joined.rdd.getNumPartitions() == 40
    assert joined.count() == 199 * 100


def test_contacts_of_events_with_one_id(spark, tmp_path):
    """Users meet by type and time, whatever the ids of their events."""
    rows = [(7, 1, "a", "2024-01-01 00:00:00"), (7, 2, "a", "2024-01-01 00:00:01"), (8, 3, "b", "2024-01-01 00:00:01"), (9, 2, "b", "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    for graph, want in ((fixtures.contact, [(0, 1), (1, 2)]), (fixtures.follow, [(0, 1), (1, 2)])):
        assert sorted(map(tuple, graph(spark, str(tmp_path)).edges.select("src", "dst").collect())) == want


@pytest.mark.parametrize("metric", pairs.FLAG_METRICS)
def test_flags_meet_as_classes(spark, monkeypatch, metric):
    """Against the distance of each pair, with copies, hot classes and ids that come twice; the distance is taken once a class."""
    rows = [(i % 45, *(float((i * k) % m) for k, m in ((1, 3), (2, 5), (3, 2)))) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double")
    a, b = df.alias("a"), df.alias("b")
    dist = pairs.distance(metric, [F.col(f"a.x{i}") for i in range(3)], [F.col(f"b.x{i}") for i in range(3)])
    plain = a.join(b, F.col("a.id") < F.col("b.id")).select("a.id", "b.id", dist.alias("dist")).where("dist < 0.7")
    seen = []
    monkeypatch.setattr(pairs, "_flag_classes", lambda prep, inner=pairs._flag_classes: seen.append(inner(prep)) or seen[0])
    found = similarity_edges(df, "id", ["x0", "x1", "x2"], metric, 0.7, tile_rows=7)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    assert seen[0][0].rows.count() <= 8 and seen[0][1].count() == 50


@pytest.mark.parametrize("inclusive", [False, True])
def test_minkowski_at_the_bound(spark, inclusive):
    points = np.vstack([POINTS, [[5.0, 5.0], [5.25, 5.0], [5.0, 5.25]]])
    out = similarity_edges(_frame(spark, points), "id", ["x", "y"], "minkowski", 0.25, p=3.0, inclusive=inclusive)
    gap = lambda a, b: (abs(a[0] - b[0]) ** 3.0 + abs(a[1] - b[1]) ** 3.0) ** (1 / 3)
    near = (lambda d: d <= 0.25) if inclusive else (lambda d: d < 0.25)
    assert sorted((r["source"], r["target"]) for r in out.collect()) == [
        (i, j) for i, j in itertools.combinations(range(len(points)), 2) if near(gap(points[i], points[j]))
    ]
    # a power is taken only where products leave a doubt
    assert "1.000000001" in str(pairs._minkowski_below([F.col("a")], [F.col("b")], 1.0, 1.0, F.lit(True)))
