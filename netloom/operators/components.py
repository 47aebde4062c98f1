"""Connected components and membership helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.graph import Graph
from netloom.operators.links import simple_links
from netloom.runtime import cut, dense_index, shuffle_width


def connected_components(graph: Graph, max_rounds: int = 200) -> DataFrame:
    """``(vid, component)`` ignoring direction; the component is its smallest vertex id.

    Every vertex keeps a parent with a smaller-or-equal id. Each round hooks parents onto the
    smallest grandparent seen across an edge and halves the path to the root, so long
    chains collapse in about log(n) rounds (after Zhang, Azad and Hu, 2020). All
    updates meet in one ``min`` that combines map-side.
    """
    links = simple_links(graph)
    state = cut(graph.vertices.select("vid", F.col("vid").alias("parent")))
    with shuffle_width(graph.edges.sparkSession, links.n_arcs):
        for _ in range(max_rounds):
            state, changed = _hook(links, state)
            if not changed:
                break
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    links.release()
    return state.select("vid", F.col("parent").alias("component"))


def _hook(links, state: DataFrame) -> tuple[DataFrame, int]:
    # parents that are roots need no lookup, so in later rounds the right side is tiny
    above = state.where("vid <> parent").select(F.col("vid").alias("parent"), F.col("parent").alias("grand"))
    now = state.join(above, "parent", "left").select("vid", "parent", F.coalesce("grand", "parent").alias("grand"))
    seen = links.send(now.select("vid", "grand")).groupBy(F.col("dst").alias("vid")).agg(F.min("grand").alias("low"))
    offered = now.join(seen, "vid", "left")
    updates = offered.select(
        F.explode(
            F.array(
                F.struct(F.col("vid"), F.least("grand", "low").alias("to"), F.col("parent").alias("was")),
                F.struct(F.col("parent").alias("vid"), F.least("grand", "low").alias("to"), F.lit(None).cast("bigint").alias("was")),
            )
        ).alias("u")
    ).select("u.*")
    settled = cut(
        updates.groupBy("vid")
        .agg(F.min("to").alias("to"), F.max("was").alias("was"))
        .select("vid", F.least("to", "was").alias("parent"), "was")
    )
    # settled only when no parent moved and no vertex is more than one step from its root
    changed = settled.where("parent <> was").count()
    return settled.select("vid", "parent"), changed


def relabel(membership: DataFrame, column: str = "community") -> DataFrame:
    """Number communities 0 … k−1, in order of their smallest vertex."""
    firsts = membership.groupBy(column).agg(F.min("vid").alias("_first"))
    numbers = dense_index(firsts, "_number", "_first").select(column, "_number")
    return membership.join(numbers, column).select("vid", F.col("_number").alias(column))
