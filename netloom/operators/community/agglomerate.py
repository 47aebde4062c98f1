"""Bottom-up merging: greedy modularity and random-walk distance.

Communities merge around mutually nearest pairs, many pairs per round, instead of one pair at a
time; results can therefore differ from the sequential originals. Ties are broken by a hash of the
pair, which keeps equal chains from resolving one link per round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.community.levels import Level, base_level, contract, follow, own
from netloom.operators.components import relabel
from netloom.operators.graph import Graph
from netloom.functions.quantiles import exact_quantiles
from netloom.operators.links import prepare
from netloom.operators.traverse import STATE_ROWS
from netloom.runtime import cut, shuffle_width

EPSILON = 1e-12


def _pair_tie(a: str, b: str):
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def _pointers(scored: DataFrame) -> DataFrame:
    """From ``(a, b, score, …)`` in both directions, the best ``b`` of each ``a``."""
    return scored.groupBy("a").agg(
        F.max(F.struct("score", _pair_tie("a", "b").alias("tie"), "b", "m_a", "m_b")).alias("p")
    ).select("a", "p.score", "p.b", "p.m_a", "p.m_b")


def _centres(pointers: DataFrame) -> DataFrame:
    """``(centre, partner, m_partner)`` of each mutually best pair; the heavier end is the centre."""
    back = pointers.select(F.col("a").alias("b"), F.col("b").alias("a"))
    heavier = (F.col("m_a") > F.col("m_b")) | ((F.col("m_a") == F.col("m_b")) & (F.col("a") < F.col("b")))
    return pointers.join(back, ["a", "b"]).where(heavier).select(
        F.col("a").alias("centre"), F.col("b").alias("partner"), F.col("m_b").alias("m_partner")
    )


def fast_greedy(graph: Graph, weight: str | None = None, one_per_round: bool = False) -> DataFrame:
    """Merge neighbours by modularity gain until no merge gains (Clauset, Newman, Moore 2004).

    Around each mutually best pair, every other community whose best choice is the centre joins
    too, as long as the whole group is sure to gain: a star collapses in one round. Gains
    only shrink once none is left, so stopping there is the cut at highest modularity.
    ``one_per_round`` merges the single best pair each time, as the original does.
    """
    level = base_level(graph, weight)
    member = cut(own(level.nodes))
    with shuffle_width(graph.edges.sparkSession, level.links.n_arcs):
        while level.total:
            rate = 1.0 / level.total
            masses = level.nodes.select("vid", F.col("mass").alias("m_a"))
            gains = level.links.send(masses).select(
                F.col("dst").alias("a"),
                F.col("vid").alias("b"),
                F.col("m_dst").alias("m_a"),
                F.col("m_a").alias("m_b"),
                (F.col("w") - rate * F.col("m_a") * F.col("m_dst")).alias("score"),
            ).where(F.col("score") > EPSILON)
            if one_per_round:
                top = gains.orderBy(F.desc("score"), _pair_tie("a", "b"), "a").limit(1)
                merges = cut(top.select(F.greatest("a", "b").alias("vid"), F.least("a", "b").alias("community")))
            else:
                merges = _gaining_groups(cut(_pointers(gains)), rate)
            if merges.isEmpty():
                break
            step = cut(
                level.nodes.select("vid").join(merges, "vid", "left").select(
                    "vid", F.coalesce("community", "vid").alias("community")
                )
            )
            member = follow(member, step)
            level = contract(level, step)
    level.links.release()
    return relabel(member)


def _gaining_groups(pointers: DataFrame, rate: float) -> DataFrame:
    centres = _centres(pointers)
    tails = cut(
        pointers.join(centres, F.col("b") == F.col("centre")).select(
            "a", "centre", "score", F.col("m_a").alias("m"), "m_partner", (F.col("a") == F.col("partner")).alias("sure")
        )
    )
    # written out, so that the join can split a centre that everybody points to
    crowd = cut(tails.where("not sure").groupBy("centre").agg(F.sum("m").alias("crowd")))
    # a joiner must outweigh the partner and, by halves, all other joiners
    worth = F.col("score") - rate * F.col("m") * (F.col("m_partner") + (F.col("crowd") - F.col("m")) / 2)
    return cut(
        tails.join(crowd, "centre", "left")
        .where(F.col("sure") | (worth > EPSILON))
        .select(F.col("a").alias("vid"), F.col("centre").alias("community"))
    )


def _walks(level: Level, steps: int, sketch: int | None, seed: int) -> DataFrame:
    """``(vid, k, x)``: where a walk of ``steps`` from each vertex ends, scaled by 1/√degree.

    Each vertex also has a loop, as walks may pause. With ``sketch`` the end vertices are
    folded into that many random ±1 directions, so the state is V × sketch rows on any graph.
    """
    degree = F.col("mass") + 1
    if sketch:
        start = level.nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(sketch - 1)).cast("array<bigint>")))
        sign = F.when(F.xxhash64("vid", "k", F.lit(seed)) % 2 == 0, 1.0).otherwise(-1.0)
        start = start.select("vid", "k", (sign / F.sqrt(degree * sketch)).alias("x"))
    else:
        start = level.nodes.select("vid", F.col("vid").alias("k"), (1 / F.sqrt(degree)).alias("x"))
    pause = level.nodes.select(
        F.col("vid").alias("src"), F.col("vid").alias("dst"), (1 / degree).alias("share")
    )
    go = level.links.arcs.select("src", "dst", (F.col("w") / (F.col("m_dst") + 1)).alias("share"))
    links = prepare(go.unionByName(pause))
    state = start
    for _ in range(steps):
        state = cut(
            links.send(state).groupBy(F.col("dst").alias("vid"), "k").agg(F.sum(F.col("x") * F.col("share")).alias("x"))
        )
    links.release()
    return state


def walktrap(
    graph: Graph, steps: int = 4, sketch: int | None = None, seed: int = 0, weight: str | None = None
) -> DataFrame:
    """Merge neighbours whose random walks end alike, cut at best modularity (Pons and Latapy 2005).

    A round merges the nearer three quarters of the mutually nearest pairs (and others whose nearest is a
    centre), so each round is one level of the dendrogram. Exact walk ends take up to V × V
    rows; ``sketch`` bounds them for large graphs.
    """
    level = base_level(graph, weight)
    member = cut(own(level.nodes))
    best, best_quality = member, -math.inf
    ends = level.nodes.count() * (sketch or level.nodes.count())
    with shuffle_width(graph.edges.sparkSession, max(level.links.n_arcs, min(ends, STATE_ROWS))):
        spots = _walks(level, steps, sketch, seed)
        while level.total:
            quality = _level_modularity(level)
            if quality > best_quality:
                best, best_quality = member, quality
            if not level.links.n_arcs:
                break
            step = _near_groups(level, spots)
            member = follow(member, step)
            sizes = level.nodes.select("vid", F.col("size").cast("double").alias("s"))
            joined = step.join(sizes, "vid")
            whole = cut(joined.groupBy("community").agg(F.sum("s").alias("whole")))
            spots = cut(
                spots.join(joined.join(whole, "community"), "vid")
                .groupBy(F.col("community").alias("vid"), "k")
                .agg(F.sum(F.col("x") * F.col("s") / F.col("whole")).alias("x"))
            )
            level = contract(level, step)
    level.links.release()
    return relabel(best)


def _level_modularity(level: Level) -> float:
    squares = level.nodes.agg(F.sum(F.col("mass") * F.col("mass"))).first()[0] or 0.0
    return level.inner / level.total - squares / level.total**2


def _near_groups(level: Level, spots: DataFrame) -> DataFrame:
    norms = spots.groupBy("vid").agg(F.sum(F.col("x") * F.col("x")).alias("norm"))
    about = level.nodes.select("vid", "mass", F.col("size").cast("double").alias("s")).join(norms, "vid")
    pairs = level.links.arcs.where("src < dst").select("src", "dst")
    left = spots.select(F.col("vid").alias("src"), "k", F.col("x").alias("xa"))
    right = spots.select(F.col("vid").alias("dst"), "k", F.col("x").alias("xb"))
    dots = (
        pairs.join(left, "src").join(right, ["dst", "k"]).groupBy("src", "dst").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    )
    a = about.select(F.col("vid").alias("src"), F.col("mass").alias("m_a"), F.col("s").alias("s_a"), F.col("norm").alias("n_a"))
    b = about.select(F.col("vid").alias("dst"), F.col("mass").alias("m_b"), F.col("s").alias("s_b"), F.col("norm").alias("n_b"))
    apart = pairs.join(dots, ["src", "dst"], "left").join(a, "src").join(b, "dst")
    far = F.greatest(F.col("n_a") + F.col("n_b") - 2 * F.coalesce("dot", F.lit(0.0)), F.lit(0.0))
    scored = apart.withColumn("score", -(F.col("s_a") * F.col("s_b") / (F.col("s_a") + F.col("s_b")) * far))
    both = F.explode(
        F.array(
            F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), "m_a", "m_b"),
            F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("m_b").alias("m_a"), F.col("m_a").alias("m_b")),
        )
    )
    pointers = cut(_pointers(scored.select("score", both.alias("e")).select("score", "e.*")))
    centres = _centres(pointers)
    tails = cut(
        pointers.join(centres, F.col("b") == F.col("centre")).select(
            "a", "centre", "score", (F.col("a") == F.col("partner")).alias("sure")
        )
    )
    # an exact quantile, rounded, so that a repeat merges the same pairs
    quartile = exact_quantiles(tails.where("sure"), ["score"], [0.25]).first()
    merges = tails.where(F.round("score", 9) >= F.round(F.lit(quartile["quantile"] if quartile else 0.0), 9)).select(F.col("a").alias("vid"), F.col("centre").alias("community"))
    return cut(
        level.nodes.select("vid").join(merges, "vid", "left").select("vid", F.coalesce("community", "vid").alias("community"))
    )
