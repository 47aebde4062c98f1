"""Chart datasets and GraphML, written in parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.encode import palette_colour
from netloom.operators.graph import Graph, Overlay

# Default look of nodes and lines.
NODE_SIZE = 20
LINE_WIDTH = 1
LINK_LINE = ("red", 3, "dashed")


@dataclass(frozen=True)
class ChartData:
    nodes: DataFrame
    edges: DataFrame
    categories: DataFrame

    def write(self, path: str) -> None:
        for name in ("nodes", "edges", "categories"):
            getattr(self, name).write.mode("overwrite").json(f"{path}/{name}")


def _node(vid: Column, name: Column, value: Column, symbol: Column, size: Column, colour: Column, category: Column) -> list[Column]:
    return [
        vid.cast("string").alias("id"),
        name.cast("string").alias("name"),
        value.alias("value"),
        symbol.alias("symbol"),
        size.cast("int").alias("symbolSize"),
        F.struct(colour.alias("color")).alias("itemStyle"),
        category.cast("int").alias("category"),
    ]


def _line(colour: Column, width: Column, kind: Column) -> Column:
    return F.struct(colour.alias("color"), width.cast("int").alias("width"), kind.alias("type")).alias("lineStyle")


def community_chart(
    graph: Graph,
    membership: DataFrame,
    label: Column | None = None,
    tooltip: Column | None = None,
    size: Column | None = None,
    symbol: str = "circle",
) -> ChartData:
    """Nodes coloured by community, edges coloured like their source, one category per community."""
    category = F.col("community")
    capped = F.least(category, F.lit(179))
    nodes = graph.vertices.join(membership, "vid")
    colour = palette_colour(capped)
    text = F.col("name") if label is None else label
    out = nodes.select(
        *_node(
            F.col("vid"),
            text,
            tooltip if tooltip is not None else F.concat(F.lit("ID:"), F.col("vid").cast("string")),
            F.lit(symbol),
            size if size is not None else F.lit(NODE_SIZE),
            colour,
            category,
        )
    )
    painted = membership.select(F.col("vid").alias("src"), colour.alias("color"))
    edges = graph.edges.join(painted, "src").select(
        F.col("src").cast("string").alias("source"),
        F.col("dst").cast("string").alias("target"),
        F.lit(graph.directed).alias("arrow"),
        _line(F.col("color"), F.lit(LINE_WIDTH), F.lit("solid")),
    )
    groups = membership.select("community").distinct().select(
        F.concat(F.lit("community "), (category + 1).cast("string")).alias("name"),
        F.struct(colour.alias("color")).alias("itemStyle"),
    )
    return ChartData(out, edges, groups)


def overlay_chart(stack: Overlay) -> ChartData:
    """Nodes by layer, edges solid, links between layers red and dashed."""
    layer = F.col("layer")
    nodes = stack.vertices.select(
        *_node(
            F.col("gid"),
            F.col("name"),
            F.concat(F.lit("ID:"), F.col("gid").cast("string")),
            F.lit("circle"),
            F.lit(NODE_SIZE),
            palette_colour(layer),
            layer,
        )
    )
    ends = [F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target")]
    edges = stack.edges.select(
        *ends, F.col("directed").alias("arrow"), _line(palette_colour(layer), F.lit(LINE_WIDTH), F.lit("solid"))
    ).unionByName(
        stack.links.select(*ends, F.lit(False).alias("arrow"), _line(*map(F.lit, LINK_LINE)))
    )
    groups = stack.vertices.select("layer").distinct().select(
        F.concat(F.lit("graph "), (layer + 1).cast("string")).alias("name")
    )
    return ChartData(nodes, edges, groups)


def _escaped(value: Column) -> Column:
    text = value.cast("string")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _graphml_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "long"
    return "double" if isinstance(kind, T.NumericType) else "string"


def _data(df: DataFrame, columns: list[str], prefix: str) -> Column:
    parts = [
        F.when(
            F.col(f"`{c}`").isNotNull(),
            F.concat(F.lit(f'<data key="{prefix}_{c}">'), _escaped(F.col(f"`{c}`")), F.lit("</data>")),
        )
        for c in columns
    ]
    return F.concat_ws("", *parts)


def graphml(graph: Graph) -> DataFrame:
    """``(part, line)``: header, one element per vertex, one per edge, footer — as rows.

    Nothing is gathered; ``part`` orders the four sections.
    """
    spark = graph.vertices.sparkSession
    v_cols = [c for c in graph.vertices.columns if c != "vid"]
    e_cols = [c for c in graph.edges.columns if c not in ("eid", "src", "dst")]
    keys = [
        f'<key id="{p}_{c}" for="{kind}" attr.name="{c}" attr.type="{_graphml_type(df.schema[c].dataType)}"/>'
        for p, kind, df, cols in (("v", "node", graph.vertices, v_cols), ("e", "edge", graph.edges, e_cols))
        for c in cols
    ]
    head = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
        *keys,
        f'<graph id="G" edgedefault="{"directed" if graph.directed else "undirected"}">',
    ]
    top = spark.createDataFrame([(0, "\n".join(head))], "part int, line string")
    end = spark.createDataFrame([(3, "</graph>\n</graphml>")], "part int, line string")
    nodes = graph.vertices.select(
        F.lit(1).alias("part"),
        F.concat(F.lit('<node id="n'), F.col("vid").cast("string"), F.lit('">'), _data(graph.vertices, v_cols, "v"), F.lit("</node>")).alias("line"),
    )
    edges = graph.edges.select(
        F.lit(2).alias("part"),
        F.concat(
            F.lit('<edge source="n'), F.col("src").cast("string"), F.lit('" target="n'), F.col("dst").cast("string"), F.lit('">'),
            _data(graph.edges, e_cols, "e"), F.lit("</edge>"),
        ).alias("line"),
    )
    return top.unionByName(nodes).unionByName(edges).unionByName(end)


def write_graphml(graph: Graph, path: str) -> None:
    """Part files that, concatenated in name order, form one GraphML document."""
    graphml(graph).select("line").write.mode("overwrite").text(path)
