"""The weighted level graph communities are found on, and its contraction."""

from __future__ import annotations

from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.graph import Graph, simplify
from netloom.operators.links import Links, both_ways, prepare
from netloom.runtime import ROWS_PER_TASK, cut, setting

SMALL_ARCS = 4 * ROWS_PER_TASK


@dataclass(frozen=True)
class Level:
    """Vertices ``(vid, mass, size)`` and symmetric loop-free arcs ``(src, dst, w, m_dst)``.

    ``mass`` is the degree, weights inside contracted vertices included; ``inner`` is the
    total of those inner weights (both ends counted) and ``total`` the sum of degrees.
    """

    nodes: DataFrame
    links: Links
    inner: float
    total: float


def _small(level: Level) -> bool:
    return level.links.n_arcs <= SMALL_ARCS


def steady(level: Level) -> AbstractContextManager:
    """No planning while jobs run on a level that is small whole: no join of it is worth splitting, and each of many rounds would pay for the look."""
    return setting(level.nodes.sparkSession, "spark.sql.adaptive.enabled", "false") if _small(level) else nullcontext()


def at_size(level: Level, totals: DataFrame) -> DataFrame:
    """Totals of communities written out, so that joins with them are planned by their size; on small levels as they are."""
    return totals if _small(level) else cut(totals)


def base_level(graph: Graph, weight: str | None = None) -> Level:
    """Level 0: the simple undirected view; weights of repeated edges add up if asked for."""
    if weight:
        pairs = (
            graph.edges.where("src <> dst")
            .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .agg(F.sum(F.col(f"`{weight}`").cast("double")).alias("w"))
        )
    else:
        pairs = simplify(graph).withColumn("w", F.lit(1.0))
    arcs = cut(both_ways(pairs, "w"))
    degree = arcs.groupBy("src").agg(F.sum("w").alias("mass")).withColumnRenamed("src", "vid")
    nodes = graph.vertices.select("vid").join(degree, "vid", "left").select(
        "vid", F.coalesce("mass", F.lit(0.0)).alias("mass"), F.lit(1).cast("bigint").alias("size")
    )
    return _level(arcs, cut(nodes), 0.0)


def _level(arcs: DataFrame, nodes: DataFrame, inner: float) -> Level:
    receivers = nodes.select(F.col("vid").alias("dst"), F.col("mass").alias("m_dst"), F.col("size").alias("s_dst"))
    links = prepare(arcs.join(receivers, "dst").select("src", "dst", "w", "m_dst", "s_dst"), settled=True)
    total = nodes.agg(F.sum("mass")).first()[0] or 0.0
    return Level(nodes, links, inner, total)


def contract(level: Level, member: DataFrame) -> Level:
    """Merge each community of ``member(vid, community)`` into one vertex named after it."""
    told = (
        level.links.send(member)
        .groupBy(F.col("dst").alias("vid"), F.col("community").alias("src"))
        .agg(F.sum("w").alias("w"))
    )
    between = cut(
        told.join(member, "vid").groupBy("src", F.col("community").alias("dst")).agg(F.sum("w").alias("w"))
    )
    nodes = level.nodes.join(member, "vid").groupBy(F.col("community").alias("vid")).agg(
        F.sum("mass").alias("mass"), F.sum("size").alias("size")
    )
    inside = between.where("src = dst").agg(F.sum("w")).first()[0] or 0.0
    out = _level(between.where("src <> dst"), cut(nodes), level.inner + inside)
    level.links.release()
    return out


def follow(member: DataFrame, upper: DataFrame) -> DataFrame:
    """Membership of base vertices after their communities were merged by ``upper``."""
    up = upper.select(F.col("vid").alias("community"), F.col("community").alias("_up"))
    return cut(member.join(up, "community").select("vid", F.col("_up").alias("community")))


def own(nodes: DataFrame) -> DataFrame:
    """Every vertex its own community."""
    return nodes.select("vid", F.col("vid").alias("community"))


def coin(*parts: Column | str) -> Column:
    """A repeatable number in (0, 1) from the hash of the parts."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 53))
