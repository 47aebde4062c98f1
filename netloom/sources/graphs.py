"""Graphs from edge, vertex and relation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.operators.graph import Graph, build_graph
from netloom.sources.tables import ROW_ID, add_row_id, read_delimited


def import_graph(
    spark: SparkSession,
    edge_path: str,
    vertex_path: str | None = None,
    relation_path: str | None = None,
    directed: bool = False,
    encoding: str = "utf-8",
) -> tuple[Graph, DataFrame | None, list[str]]:
    """Read up to three tables; returns the graph, the relation table and the vertex columns."""
    edges = read_delimited(spark, edge_path, encoding)
    vertices, columns = None, []
    if vertex_path:
        # file order decides vertex numbers
        raw = read_delimited(spark, vertex_path, encoding)
        columns = raw.columns
        numbered = add_row_id(raw)
        vertices = numbered.select(*(f"`{c}`" for c in columns), ROW_ID)
    graph = build_graph(edges, vertices, directed, order_by=ROW_ID if vertices is not None else None, scan=True)
    if vertices is not None:
        graph = Graph(graph.vertices.drop(ROW_ID), graph.edges, directed)
    relation = read_delimited(spark, relation_path, encoding) if relation_path else None
    return graph, relation, columns
