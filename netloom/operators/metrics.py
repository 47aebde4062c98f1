"""Graph measures that need no traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.graph import Graph, simplify
from netloom.operators.links import prepare


def degrees(graph: Graph) -> DataFrame:
    """``(vid, degree, in_degree, out_degree)``; a loop counts twice, isolated vertices are 0."""
    ends = graph.edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("vid"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("vid"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    ).select("e.*")
    counted = ends.groupBy("vid").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    none = F.lit(0).cast("bigint")
    out, into = F.coalesce("o", none), F.coalesce("i", none)
    if not graph.directed:
        out = into = out + into
        degree = out
    else:
        degree = out + into
    return graph.vertices.select("vid").join(counted, "vid", "left").select(
        "vid", degree.alias("degree"), into.alias("in_degree"), out.alias("out_degree")
    )


def degree_distribution(graph: Graph) -> DataFrame:
    """How many vertices have each degree, ascending."""
    return degrees(graph).groupBy("degree").agg(F.count(F.lit(1)).alias("n")).orderBy("degree")


def forward_pairs(graph: Graph) -> DataFrame:
    """``(u, v, ahead_u, ahead_v)`` for each simple edge, pointing up the degree order.

    ``ahead_x`` are the neighbours of x further up the order. Pointing towards higher degree
    leaves at most √(2E) of them for any vertex, hubs included, so the arrays stay
    small; a hub with many edges pointing at it is sliced like any other sender.
    """
    pairs = simplify(graph)
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("vid"))
    degree = ends.groupBy("vid").agg(F.count(F.lit(1)).alias("d"))
    lo, hi = degree.toDF("src", "ds"), degree.toDF("dst", "dd")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    arcs = (
        pairs.join(lo, "src")
        .join(hi, "dst")
        .select(
            F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"),
            F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"),
        )
    )
    back = prepare(arcs.select(F.col("v").alias("src"), F.col("u").alias("dst")))
    forward = back.arcs.select(F.col("dst").alias("u"), F.col("src").alias("v"))
    ahead = forward.groupBy("u").agg(F.collect_list("v").alias("ahead"))
    told = back.send(ahead.withColumnRenamed("u", "vid")).select(
        F.col("dst").alias("u"), F.col("vid").alias("v"), F.col("ahead").alias("ahead_v")
    )
    return told.join(ahead.withColumnRenamed("ahead", "ahead_u"), "u")


def triangle_count(graph: Graph) -> DataFrame:
    """One row: triangles of the simple undirected view."""
    shared = F.size(F.array_intersect("ahead_u", "ahead_v")).cast("bigint")
    return forward_pairs(graph).agg(F.coalesce(F.sum(shared), F.lit(0)).alias("triangles"))


def connected_triples(graph: Graph) -> DataFrame:
    """One row: paths of length two, counted at their middle vertex."""
    ends = simplify(graph).select(F.explode(F.array("src", "dst")).alias("vid"))
    d = ends.groupBy("vid").agg(F.count(F.lit(1)).alias("d"))
    return d.agg(F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).alias("triples"))


def clustering_coefficient(graph: Graph) -> float | None:
    """3 · triangles / connected triples; None without triples."""
    triples = connected_triples(graph).first()["triples"]
    if not triples:
        return None
    return 3 * triangle_count(graph).first()["triangles"] / triples


def size_measures(graph: Graph) -> DataFrame:
    """One row: vertices, edges, average and maximum degree, density."""
    counts = degrees(graph).agg(
        F.count(F.lit(1)).alias("vertices"),
        F.expr("sum(degree) div 2").alias("edges"),
        F.round(F.avg("degree"), 4).alias("avg_degree"),
        F.max("degree").alias("max_degree"),
    )
    v = F.col("vertices").cast("double")
    share = 1.0 if graph.directed else 2.0
    return counts.select(
        F.lit(graph.directed).alias("directed"),
        "vertices",
        "edges",
        "avg_degree",
        "max_degree",
        F.round(F.try_divide(share * F.col("edges"), v * (v - 1)), 4).alias("density"),
    )
