"""Label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.community.levels import coin
from netloom.operators.components import relabel
from netloom.operators.graph import Graph
from netloom.operators.links import simple_links
from netloom.runtime import cut, shuffle_width


def label_propagation(graph: Graph, seed: int = 0, max_rounds: int = 10_000) -> DataFrame:
    """Every vertex takes the label most of its neighbours hold (Raghavan et al. 2007).

    A hash lets half the vertices update per round, which breaks two-cycles; a vertex keeps its
    label while that is among the most frequent, and the loop ends when all do; not to settle is an error.
    """
    links = simple_links(graph)
    state = cut(graph.vertices.select("vid", F.col("vid").alias("community")))
    with shuffle_width(graph.edges.sparkSession, links.n_arcs):
        for turn in range(max_rounds):
            heard = links.send(state).select(F.col("dst").alias("vid"), "community", F.lit(1).alias("n"), F.lit(0).alias("here"))
            mine = state.select("vid", "community", F.lit(0).alias("n"), F.lit(1).alias("here"))
            votes = heard.unionByName(mine).groupBy("vid", "community").agg(
                F.sum("n").alias("n"), F.max("here").alias("here")
            )
            looked = cut(
                votes.groupBy("vid").agg(
                    F.max(F.struct("n", "here", F.xxhash64("vid", "community", F.lit(seed + turn)).alias("tie"), "community")).alias("best"),
                    F.max(F.when(F.col("here") == 1, F.col("community"))).alias("home"),
                )
            )
            wants = F.col("best.community") != F.col("home")
            if looked.where(wants).isEmpty():
                break
            goes = wants & (coin("vid", F.lit(seed), F.lit(turn)) < 0.5)
            state = looked.select("vid", F.when(goes, F.col("best.community")).otherwise(F.col("home")).alias("community"))
        else:
            raise RuntimeError(f"labels did not settle in {max_rounds} rounds")
    links.release()
    return relabel(state)
