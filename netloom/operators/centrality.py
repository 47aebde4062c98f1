"""Betweenness of vertices and edges, and PageRank."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.graph import Graph
from netloom.operators.links import Links, both_ways, prepare, walk_arcs, walk_links
from netloom.operators.traverse import STATE_ROWS, levels, search_rows, source_batches, union_all
from netloom.operators.whole import net, path_shares
from netloom.runtime import cut, shuffle_width


def _dependencies(links: Links, back: Links, batch: DataFrame, symmetric: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per source: dependency ``(s, vid, delta)`` of each vertex and flow ``(v, w, flow)`` of each arc.

    Path counts go forward level by level, dependencies come back the same way.
    """
    found = levels(links, batch, symmetric, carry="sigma")
    vertex, arcs = [], []
    below = found[-1].select("s", "vid", (1 / F.col("sigma")).alias("c"))
    for here in reversed(found[:-1]):
        flows = (
            back.send(below)
            .select("s", F.col("vid").alias("w"), F.col("dst").alias("vid"), "m", "c")
            .join(here.hint("merge"), ["s", "vid"])
            .select("s", "vid", "w", "sigma", (F.col("sigma") * F.col("m") * F.col("c")).alias("flow"))
        )
        arcs.append(flows.groupBy(F.col("vid").alias("v"), "w").agg(F.sum("flow").alias("flow")))
        delta = cut(flows.groupBy("s", "vid").agg(F.sum("flow").alias("delta"), F.first("sigma").alias("sigma")))
        vertex.append(delta.where("s <> vid").select("vid", "delta"))
        below = here.join(delta.select("s", "vid", "delta").hint("merge"), ["s", "vid"], "left").select(
            "s", "vid", ((1 + F.coalesce("delta", F.lit(0.0))) / F.col("sigma")).alias("c")
        )
    return vertex, arcs


def _pivots(graph: Graph, pivots: int | None, seed: int) -> tuple[DataFrame | None, float]:
    """A hash-chosen share of the vertices as sources, and the factor that scales them up."""
    if pivots is None:
        return None, 1.0
    total = graph.vertices.count()
    if pivots >= total:
        return None, 1.0
    chosen = cut(
        graph.vertices.select(F.col("vid").alias("s")).orderBy(F.md5(F.concat_ws(":", "s", F.lit(seed))), "s").limit(pivots)
    )
    return chosen, total / pivots


def _accumulate(graph: Graph, pivots: int | None, seed: int, state_rows: int, edges: bool) -> tuple[DataFrame, float]:
    sources, factor = _pivots(graph, pivots, seed)
    parts = []
    key = ["v", "w"] if edges else ["vid"]
    value = "flow" if edges else "delta"
    arcs = cut(walk_arcs(graph, "out"))
    held = net(arcs) if state_rows == STATE_ROWS else None
    if held is not None and held.n:
        asked = None if sources is None else np.array([r["s"] for r in sources.collect()], np.int64)  # as many as pivots
        return path_shares(graph.edges.sparkSession, held, asked, edges).groupBy(*key).agg(F.sum(value).alias(value)), factor
    links = prepare(arcs, settled=True)
    back = walk_links(graph, "in") if graph.directed else links
    try:
        with shuffle_width(graph.edges.sparkSession, search_rows(graph, links, state_rows, sources)):
            for batch in source_batches(graph, state_rows, sources):
                vertex, arcs = _dependencies(links, back, batch, not graph.directed)
                chosen = arcs if edges else vertex
                if chosen:
                    parts.append(cut(union_all(chosen).groupBy(*key).agg(F.sum(value).alias(value))))
    finally:
        links.release()
        back.release()
    if not parts:
        schema = "v long, w long, flow double" if edges else "vid long, delta double"
        return graph.edges.sparkSession.createDataFrame([], schema), factor
    return union_all(parts).groupBy(*key).agg(F.sum(value).alias(value)), factor


def betweenness(
    graph: Graph, pivots: int | None = None, seed: int = 0, state_rows: int = STATE_ROWS
) -> DataFrame:
    """``(vid, betweenness)``, unnormalised; direction respected, undirected pairs count once.

    ``pivots`` asks for the estimate from that many sources, scaled up, instead of all.
    """
    sums, factor = _accumulate(graph, pivots, seed, state_rows, edges=False)
    share = factor * (1.0 if graph.directed else 0.5)
    return graph.vertices.select("vid").join(sums, "vid", "left").select(
        "vid", F.round(F.coalesce(F.col("delta") * share, F.lit(0.0)), 5).alias("betweenness")
    )


def edge_betweenness(
    graph: Graph, pivots: int | None = None, seed: int = 0, state_rows: int = STATE_ROWS
) -> DataFrame:
    """``(src, dst, betweenness)`` per distinct loop-free edge."""
    flows, factor = _accumulate(graph, pivots, seed, state_rows, edges=True)
    if graph.directed:
        return flows.select(F.col("v").alias("src"), F.col("w").alias("dst"), (F.col("flow") * factor).alias("betweenness"))
    return flows.groupBy(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst")).agg(
        (F.sum("flow") * F.lit(factor / 2)).alias("betweenness")
    )


def pagerank(
    graph: Graph,
    damping: float = 0.85,
    tolerance: float = 1e-10,
    max_rounds: int = 500,
    weight: str | None = None,
    cycle: int = 6,
) -> DataFrame:
    """``(vid, pagerank)`` summing to 1; undirected edges lead both ways, repeats count.

    Rank that reaches a vertex without out-edges is spread evenly. Spreading it only rescales
    the fixed point, so the loop leaves it out and normalises once at the end. The state
    is written every ``cycle`` rounds; there the iterates of the cycle are combined so that
    their residual is smallest (reduced rank extrapolation, Sidi 2008), which takes far
    fewer rounds than plain iteration. The driver sees only the cycle × cycle products.
    """
    spark = graph.edges.sparkSession
    n = graph.vertices.count()
    if not n:
        return spark.createDataFrame([], "vid long, pagerank double")
    one = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    arcs = graph.edges.select("src", "dst", one.alias("w"))
    if not graph.directed:
        # a loop is two ends of one edge, so it leads back to its vertex twice
        arcs = arcs.withColumn("w", F.when(F.col("src") == F.col("dst"), 2 * F.col("w")).otherwise(F.col("w")))
        arcs = both_ways(arcs, "w")
    arcs = arcs.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = arcs.groupBy("src").agg(F.sum("w").alias("total"))
    shares = arcs.join(out, "src").select("src", "dst", (damping * F.col("w") / F.col("total")).alias("share"), F.lit(False).alias("own"))
    # an arc to itself carries the vertex's history along, so a round reads the state once
    own = graph.vertices.select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0.0).alias("share"), F.lit(True).alias("own"))
    links = prepare(shares.unionByName(own))
    base = (1 - damping) / n
    state = graph.vertices.select("vid", F.lit(1.0 / n).alias("x0"))
    xs = [f"x{i}" for i in range(cycle + 1)]
    steps = [F.col(b) - F.col(a) for a, b in zip(xs, xs[1:])]
    products = [(steps[i] * steps[j], f"g{i}_{j}") for i in range(cycle) for j in range(i + 1)]
    with shuffle_width(spark, links.n_arcs):
        for _ in range(0, max_rounds, cycle):
            for i in range(cycle):
                mine = [F.max(F.when(F.col("own"), F.col(x))).alias(x) for x in xs[: i + 1]]
                passed = F.sum(F.when(F.col("own"), F.lit(base)).otherwise(F.col(xs[i]) * F.col("share")))
                state = links.send(state).groupBy(F.col("dst").alias("vid")).agg(*mine, passed.alias(xs[i + 1]))
            state = cut(state)
            seen = state.agg(
                F.sum(F.abs(steps[-1])).alias("change"),
                F.sum(xs[-1]).alias("total"),
                *(F.sum(product).alias(name) for product, name in products),
            ).first()
            if seen["change"] <= tolerance * seen["total"]:
                break
            gram = np.array([[seen[f"g{max(i, j)}_{min(i, j)}"] for j in range(cycle)] for i in range(cycle)])
            mix = _least_residual(gram)
            state = state.select("vid", sum((F.lit(float(m)) * F.col(x) for m, x in zip(mix, xs[1:])), F.lit(0.0)).alias("x0"))
        else:
            raise RuntimeError(f"ranks did not settle in {max_rounds} rounds")
    links.release()
    return state.select("vid", (F.col(xs[-1]) / F.lit(seen["total"])).alias("pagerank"))


def _least_residual(gram: np.ndarray) -> np.ndarray:
    """Weights summing to 1 that make the combined step smallest, given the steps' products."""
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    scaled = gram / np.outer(scale, scale)
    weights = np.linalg.lstsq(scaled + 1e-14 * np.eye(len(gram)), 1 / scale, rcond=1e-13)[0] / scale
    return weights / weights.sum()
