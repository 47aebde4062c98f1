"""Modularity and summaries of a membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.graph import Graph, simplify


def modularity(graph: Graph, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of ``membership(vid, community)`` on the simple undirected view."""
    mine, theirs = (membership.select("vid", "community").toDF(v, c) for v, c in (("src", "_a"), ("dst", "_b")))
    same = (F.col("_a") == F.col("_b")).cast("int").alias("same")
    ends = simplify(graph).join(mine, "src").join(theirs, "dst").select(
        F.explode(F.array("_a", "_b")).alias("community"), same
    )
    per = ends.groupBy("community").agg(F.sum("same").alias("inside"), F.count(F.lit(1)).alias("total"))
    m2 = F.sum("total").cast("double")
    return per.agg(
        F.coalesce(
            F.try_divide(F.sum("inside").cast("double"), m2)
            - resolution * F.try_divide(F.sum(F.col("total").cast("double") * F.col("total")), m2 * m2),
            F.lit(0.0),
        ).alias("modularity")
    )


def community_summary(membership: DataFrame) -> DataFrame:
    """``(community, size, share)``."""
    sizes = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return sizes.withColumn("share", F.col("size") / F.lit(float(total)))


def community_count(membership: DataFrame) -> DataFrame:
    """One row: how many communities there are."""
    return membership.select("community").distinct().agg(F.count(F.lit(1)).alias("communities"))


def split_disconnected(graph: Graph, membership: DataFrame) -> DataFrame:
    """Cut each community into its connected pieces; this never lowers modularity."""
    from netloom.operators.components import connected_components

    pairs = simplify(graph)
    mine, theirs = membership.toDF("src", "a"), membership.toDF("dst", "b")
    inside = pairs.join(mine, "src").join(theirs, "dst").where("a = b").select("src", "dst")
    return connected_components(Graph(membership.select("vid"), inside)).withColumnRenamed(
        "component", "community"
    )
