"""Adjacency prepared once for loops that pass messages along edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.graph import Graph, simplify
from netloom.runtime import cut, tasks_for

HUB_ARCS = 100_000


@dataclass(frozen=True)
class Links:
    """Arcs ``(src, dst, …)`` hash-partitioned by sender and kept for the whole loop.

    The arcs of a hub — a vertex with more than ``hub_arcs`` — are cut into slices that land
    in different tasks, and whatever the hub sends is repeated per slice. There are at
    most arcs / hub_arcs hubs, so their table stays small against the graph.
    """

    arcs: DataFrame
    hubs: DataFrame | None
    n_arcs: int
    max_degree: int

    def send(self, state: DataFrame) -> DataFrame:
        """Join rows keyed by ``vid`` with the arcs leaving it; the receiver is ``dst``.

        The state grows with the vertices and its files are much smaller than its rows, so it is never broadcast.
        """
        if self.hubs is None:
            return state.hint("merge").join(self.arcs, F.col("vid") == F.col("src")).drop("src")
        spread = state.join(self.hubs, "vid", "left").withColumn(
            "slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices") - 1, F.lit(0))))
        )
        arcs = self.arcs.withColumnRenamed("slice", "_slice")
        return spread.hint("merge").join(
            arcs, (F.col("vid") == F.col("src")) & (F.col("slice") == F.col("_slice"))
        ).drop("src", "slice", "slices", "_slice")

    def release(self) -> None:
        self.arcs.unpersist()


def prepare(arcs: DataFrame, hub_arcs: int = HUB_ARCS, settled: bool = False) -> Links:
    """Arrange ``(src, dst, …)`` rows for :meth:`Links.send`.

    The rows are written out first, unless they are ``settled``: cheap to derive again.
    """
    spark = arcs.sparkSession
    if not settled:
        arcs = cut(arcs)
    degrees = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    total, top = degrees.agg(F.sum("n"), F.max("n")).first()
    total, top = total or 0, top or 0
    width = tasks_for(spark, total)
    if top <= hub_arcs:
        return Links(arcs.repartition(width, "src").sortWithinPartitions("src").persist(), None, total, top)
    hubs = cut(
        degrees.where(F.col("n") > hub_arcs).select(
            F.col("src").alias("vid"), F.ceil(F.col("n") / hub_arcs).cast("int").alias("slices")
        )
    )
    sliced = (
        arcs.join(hubs.withColumnRenamed("vid", "src"), "src", "left")
        .withColumn("slice", F.pmod(F.xxhash64("dst"), F.coalesce("slices", F.lit(1))).cast("int"))
        .drop("slices")
    )
    return Links(sliced.repartition(width, "src", "slice").sortWithinPartitions("src", "slice").persist(), hubs, total, top)


def both_ways(pairs: DataFrame, *cols: str) -> DataFrame:
    """Each ``(src, dst)`` row in both directions; a loop stays one row."""
    back = pairs.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols)
    return pairs.select("src", "dst", *cols).unionByName(back)


def simple_links(graph: Graph, hub_arcs: int = HUB_ARCS) -> Links:
    """Undirected simple view, each edge both ways."""
    return prepare(both_ways(simplify(graph)), hub_arcs)


def walk_arcs(graph: Graph, mode: str = "out") -> DataFrame:
    """Loop-free arcs a walk may take: along (out), against (in) or across (all) the edges.

    Repeated edges are one arc with their number in ``m``: they are that many ways to step.
    """
    arcs = graph.edges.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    if not graph.directed or mode == "all":
        arcs = both_ways(arcs, "m").groupBy("src", "dst").agg(F.sum("m").alias("m"))
    elif mode == "in":
        arcs = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "m")
    return arcs


def walk_links(graph: Graph, mode: str = "out", hub_arcs: int = HUB_ARCS) -> Links:
    """:func:`walk_arcs`, arranged for sending."""
    return prepare(walk_arcs(graph, mode), hub_arcs)
