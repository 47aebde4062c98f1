"""Graphs as a vertex and an edge DataFrame, and layered overlays of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.names import clean_names
from netloom.runtime import cut, dense_index


@dataclass(frozen=True)
class Graph:
    """``vertices(vid, name, …)`` and ``edges(eid, src, dst, …)``; loops and repeats kept."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False


def build_graph(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    directed: bool = False,
    order_by: str | None = None,
    missing: str = "error",
    scan: bool = False,
) -> Graph:
    """Number vertices densely and translate edge ends to the numbers.

    The first two edge columns are source and target, the first vertex column is the name;
    all other columns stay as attributes. Vertices follow ``order_by`` (default: the name).
    Without a vertex table the distinct edge ends are the vertices. An end missing from
    the vertex table is an error, or its edge is dropped, or the vertex is added. A null end names no
    vertex: it is an error too, or its edge is dropped. A repeated vertex id is always an error.
    Edges are read twice, so they are written out first unless they are a plain ``scan``.
    """
    if not scan:
        edges = cut(edges)
    source, target, *attrs = edges.columns
    lacking = F.col(f"`{source}`").isNull() | F.col(f"`{target}`").isNull()
    if missing == "error" and edges.where(lacking).head(1):
        raise ValueError("an edge has a null end")
    edges = edges.where(~lacking)
    ends = edges.select(F.explode(F.array(f"`{source}`", f"`{target}`")).alias("name")).distinct()
    if vertices is None:
        table = ends
    else:
        key = vertices.columns[0]
        table = vertices.withColumnRenamed(key, "name") if key != "name" else vertices
        twice = table.groupBy("name").count().where("count > 1").head(1)
        if twice:
            raise ValueError(f"vertex id {twice[0]['name']!r} is repeated")
        if missing == "add":
            table = table.unionByName(ends.join(table, "name", "left_anti"), allowMissingColumns=True)
    numbered = cut(dense_index(table, "vid", order_by if order_by in table.columns else "name"))
    if missing == "error" and vertices is not None:
        stray = ends.join(numbered, "name", "left_anti").limit(1).collect()
        if stray:
            raise ValueError(f"edge end {stray[0]['name']!r} is not in the vertex table")
    ids = numbered.select("vid", "name")
    placed = (
        edges.join(ids.toDF("src", "_s"), F.col(f"`{source}`") == F.col("_s"))
        .join(ids.toDF("dst", "_t"), F.col(f"`{target}`") == F.col("_t"))
        .select(
            F.monotonically_increasing_id().alias("eid"),
            "src",
            "dst",
            *(F.col(f"`{a}`") for a in attrs if a not in ("eid", "src", "dst")),
        )
    )
    return Graph(numbered, cut(placed), directed)


def simplify(graph: Graph) -> DataFrame:
    """Undirected simple view: ``(src, dst)`` with src < dst, loops and repeats gone."""
    return (
        graph.edges.where("src <> dst")
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def vertex_table(graph: Graph, *metrics: DataFrame) -> DataFrame:
    """Vertex attributes with computed columns joined on, under cleaned names."""
    df = graph.vertices
    for metric in metrics:
        df = df.join(metric, "vid", "left")
    rest = [F.col(f"`{c}`") for c in df.columns if c != "vid"]
    return clean_names(df.select(F.col("vid").alias("vertex ID"), *rest))


def edge_table(graph: Graph) -> DataFrame:
    """Vertex numbers of both ends, then edge attributes, under cleaned names."""
    rest = [F.col(f"`{c}`") for c in graph.edges.columns if c not in ("eid", "src", "dst")]
    return clean_names(
        graph.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), *rest)
    )


@dataclass(frozen=True)
class Overlay:
    """Layers stacked into one id space.

    ``vertices(gid, layer, vid, name, …)``, ``edges(src, dst, layer, directed, …)`` and
    ``links(src, dst, layer, weight)`` between layers.
    """

    vertices: DataFrame
    edges: DataFrame
    links: DataFrame
    offsets: tuple[int, ...]


def overlay(layers: Sequence[Graph], relations: Sequence[DataFrame | None]) -> Overlay:
    """Stack layers, shifting ids by the sizes of the layers below, and add relation links.

    ``relations[i]`` ties layer i to earlier ones: column 1 names a vertex of any earlier
    layer (the first layer that has it wins, unmatched rows are skipped), column 2 a vertex
    of layer i (unmatched is an error).
    """
    spark = layers[0].vertices.sparkSession
    offsets, total = [], 0
    for layer in layers:
        offsets.append(total)
        total += layer.vertices.count()
    nodes = [
        g.vertices.select((F.col("vid") + off).alias("gid"), F.lit(i).alias("layer"), "*")
        for i, (g, off) in enumerate(zip(layers, offsets))
    ]
    edges = [
        g.edges.withColumn("src", F.col("src") + off)
        .withColumn("dst", F.col("dst") + off)
        .withColumn("layer", F.lit(i))
        .withColumn("directed", F.lit(g.directed))
        for i, (g, off) in enumerate(zip(layers, offsets))
    ]
    links = [
        _relation_links(i, relation, nodes)
        for i, relation in enumerate(relations)
        if i and relation is not None
    ]

    def stack(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame, allowMissingColumns=True)
        return out

    empty = spark.createDataFrame([], "src long, dst long, layer int, weight double")
    return Overlay(stack(nodes), stack(edges), stack(links) if links else empty, tuple(offsets))


def _relation_links(index: int, relation: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    first, second, *rest = relation.columns
    weighted = len(relation.columns) == 3 and rest[0] in ("weight", "dist")
    wanted = relation.select(
        F.col(f"`{first}`").cast("string").alias("_a"),
        F.col(f"`{second}`").cast("string").alias("_b"),
        (F.col(f"`{rest[0]}`") if weighted else F.lit(3)).cast("double").alias("weight"),
    )
    earlier = nodes[0].select(F.col("name").cast("string").alias("_a"), "gid", "layer")
    for node in nodes[1:index]:
        earlier = earlier.union(node.select(F.col("name").cast("string"), "gid", "layer"))
    sources = earlier.groupBy("_a").agg(F.min_by("gid", "layer").alias("src"))
    targets = nodes[index].select(F.col("name").cast("string").alias("_b"), F.col("gid").alias("dst"))
    matched = wanted.join(sources, "_a").join(targets, "_b", "left")
    stray = matched.where("dst is null").limit(1).collect()
    if stray:
        raise ValueError(f"relation names {stray[0]['_b']!r}, which layer {index} does not have")
    return matched.select("src", "dst", F.lit(index).alias("layer"), "weight")
