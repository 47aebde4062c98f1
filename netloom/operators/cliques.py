"""Core numbers and the size of the largest clique."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.graph import Graph, simplify
from netloom.operators.links import simple_links
from netloom.operators.metrics import forward_pairs
from netloom.runtime import cut, shuffle_width


def core_numbers(graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    """``(vid, core)`` of the simple undirected view.

    Starts from degrees and lets every vertex take the largest h such that h neighbours hold at
    least h, until nothing changes; that fixed point is the core number (Montresor et al.
    2013). Neighbour values above a vertex's own are capped to it and counted before the
    window, so a hub brings at most one row per distinct value.
    """
    links = simple_links(graph)
    start = links.arcs.groupBy("src").agg(F.count(F.lit(1)).alias("h")).select(F.col("src").alias("vid"), "h")
    with shuffle_width(graph.edges.sparkSession, links.n_arcs):
        state = cut(start)
        for _ in range(max_rounds):
            heard = links.send(state).select(F.col("dst").alias("vid"), F.col("h").alias("other"))
            counts = (
                heard.groupBy("vid", "other")
                .agg(F.count(F.lit(1)).alias("n"))
                .join(state, "vid")
                .groupBy("vid", "h", F.least("other", "h").alias("value"))
                .agg(F.sum("n").alias("n"))
            )
            down = Window.partitionBy("vid").orderBy(F.desc("value"))
            lower = (
                counts.withColumn("have", F.sum("n").over(down))
                .groupBy("vid")
                .agg(F.max(F.least("value", "have")).alias("h"), F.first("h").alias("was"))
            )
            lower = cut(lower)
            state = lower.select("vid", "h")
            if lower.where("h <> was").isEmpty():
                break
        else:
            raise RuntimeError(f"core numbers did not settle in {max_rounds} rounds")
    links.release()
    return graph.vertices.select("vid").join(state, "vid", "left").select(
        "vid", F.coalesce("h", F.lit(0)).alias("core")
    )


def _coloured(members: int, adjacent: list[int]) -> list[tuple[int, int]]:
    """Members with a greedy colour each, lowest first: no clique among the first ones has more vertices than colours."""
    out, colour = [], 0
    while members:
        colour += 1
        rest = members
        while rest:
            v = (rest & -rest).bit_length() - 1
            out.append((v, colour))
            members ^= 1 << v
            rest &= ~(adjacent[v] | 1 << v)
    return out


def largest_clique(adjacent: list[int], floor: int = 0) -> int:
    """Size of the largest clique above ``floor``, else ``floor``; neighbours are bit masks.

    Branch and bound with colours as the bound (Tomita and Seki 2003) on a stack of its own, so no depth is too deep.
    """
    best = floor
    everyone = (1 << len(adjacent)) - 1
    stack = [(everyone, _coloured(everyone, adjacent), 0)]
    while stack:
        members, order, size = stack.pop()
        if not order or size + order[-1][1] <= best:
            continue
        v = order.pop()[0]
        stack.append((members & ~(1 << v), order, size))
        inside = members & adjacent[v]
        best = max(best, size + 1)
        if inside:
            stack.append((inside, _coloured(inside, adjacent), size + 1))
    return best


def _largest_near(group: pd.DataFrame) -> pd.DataFrame:
    pairs = [(v, w) for v, shared in zip(group["v"], group["shared"]) for w in shared]
    number = {v: i for i, v in enumerate(sorted({*group["v"], *(w for _, w in pairs)}))}
    adjacent = [0] * len(number)
    for v, w in pairs:
        adjacent[number[v]] |= 1 << number[w]
        adjacent[number[w]] |= 1 << number[v]
    return pd.DataFrame({"size": [1 + largest_clique(adjacent, int(group["floor"].iloc[0]) - 1)]})


def clique_number(graph: Graph, max_ahead: int | None = None) -> int:
    """Size of the largest clique.

    Each clique is found at its first vertex in degree order, inside the neighbours further
    up the order: at most √(2E) of them per task group, hubs included. Vertices whose core
    number cannot beat a clique already known are dropped first. A caller may have neighbourhoods
    above ``max_ahead`` refused.
    """
    if graph.vertices.isEmpty():
        return 0
    if simplify(graph).isEmpty():
        return 1
    cores = cut(core_numbers(graph))
    deepest = cores.agg(F.max("core")).first()[0]
    # a clique of k vertices needs cores of k − 1: the innermost core usually settles the rest
    known = _search(_core_part(graph, cores, deepest), 2, max_ahead)
    if known <= deepest:
        known = _search(_core_part(graph, cores, known), known, max_ahead)
    return known


def _core_part(graph: Graph, cores: DataFrame, least: int) -> Graph:
    keep = cores.where(F.col("core") >= least).select("vid")
    edges = (
        simplify(graph)
        .join(keep.toDF("src"), "src", "left_semi")
        .join(keep.toDF("dst"), "dst", "left_semi")
        .select("src", "dst")
    )
    return Graph(keep, cut(edges), False)


def _search(part: Graph, known: int, max_ahead: int | None) -> int:
    pairs = cut(forward_pairs(part))
    widest = pairs.agg(F.max(F.size("ahead_u"))).first()[0] or 0
    if max_ahead is not None and widest > max_ahead:
        raise ValueError(f"a vertex has {widest} neighbours up the order; raise max_ahead to search it")
    groups = pairs.where(F.size("ahead_u") >= known).select(
        "u", "v", F.array_intersect("ahead_u", "ahead_v").alias("shared"), F.lit(known).alias("floor")
    )
    found = groups.groupBy("u").applyInPandas(_largest_near, "size int").agg(F.max("size")).first()[0]
    return max(known, found or 0)
