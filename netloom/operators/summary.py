"""The ten-field summary record of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.cliques import clique_number
from netloom.operators.graph import Graph
from netloom.operators.metrics import clustering_coefficient, size_measures
from netloom.operators.traverse import hop_histogram, path_measures


def summarize(graph: Graph) -> DataFrame:
    """One row: direction, sizes, degrees, density, clustering, diameter, mean path, clique number."""
    clustering = clustering_coefficient(graph)
    paths = path_measures(hop_histogram(graph)).first()  # one row
    return size_measures(graph).select(
        "*",
        F.round(F.lit(clustering).cast("double"), 4).alias("clustering"),
        F.lit(paths["diameter"]).cast("bigint").alias("diameter"),
        F.lit(paths["avg_path"]).cast("double").alias("avg_path"),
        F.lit(clique_number(graph)).cast("bigint").alias("clique_number"),
    )


def summary_json(graph: Graph) -> DataFrame:
    """The record as one JSON text per row; undefined values are null."""
    record = summarize(graph)
    return record.select(F.to_json(F.struct(*record.columns), {"ignoreNullFields": "false"}).alias("record"))
