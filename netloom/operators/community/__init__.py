"""Community detection on the undirected simple view of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame

from netloom.operators.community.agglomerate import fast_greedy, walktrap
from netloom.operators.community.divide import edge_removal, leading_eigenvector
from netloom.operators.community.moves import infomap, leiden, louvain, spin_glass
from netloom.operators.community.spread import label_propagation
from netloom.operators.graph import Graph

ALGORITHMS = {
    "EdgeBetweenness": edge_removal,
    "FastGreedy": fast_greedy,
    "InfoMap": infomap,
    "LabelPropagation": label_propagation,
    "LeadingEigenvector": leading_eigenvector,
    "Leiden": leiden,
    "MultiLevel": louvain,
    "SpinGlass": spin_glass,
    "WalkTrap": walktrap,
}


def detect(graph: Graph, algorithm: str, **options) -> DataFrame:
    """``(vid, community)`` with communities numbered 0 … k−1."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm is one of {sorted(ALGORITHMS)}")
    return ALGORITHMS[algorithm](graph, **options)
