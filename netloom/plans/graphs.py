"""Queries over graphs: structure, measures, centralities, paths, encodings, exports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import encode as en
from netloom.operators import centrality, cliques, components, graph as gb, metrics, summary, traverse
from netloom.operators import clean as cl
from netloom.operators.pairs import similarity_edges
from netloom.plans import fixtures as fx
from netloom.plans.registry import query, table
from netloom.runtime import scratch_path
from netloom.sources import exports
from netloom.sources.graphs import import_graph
from netloom.sources.tables import write_csv


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


# ---- construction -------------------------------------------------------------------

PART_GRAPH_SQL = """z AS (SELECT p_partkey AS id, (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part) AS x,
   (p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part) AS y FROM part),
 node AS (SELECT p_partkey AS vid FROM part),
 edge AS (SELECT a.id AS src, b.id AS dst FROM z a JOIN z b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < (SELECT sqrt(500::DOUBLE / count(*)) FROM part))"""
SIZE_SQL = """deg AS (SELECT vid, count(e) AS degree FROM node LEFT JOIN (SELECT src AS e FROM edge UNION ALL SELECT dst FROM edge) ON vid = e GROUP BY vid),
 size AS (SELECT count(*) AS vertices, CAST(sum(degree) // 2 AS BIGINT) AS edges, round(avg(degree), 4) AS avg_degree, max(degree) AS max_degree FROM deg)"""
SIZE_COLS = "vertices, edges, avg_degree, max_degree"


@query(
    "flagship_similarity_network",
    f"""WITH {PART_GRAPH_SQL}, {SIZE_SQL}
     SELECT false AS directed, {SIZE_COLS}, round(2.0 * edges / (vertices * (vertices - 1.0)), 4) AS density FROM size""",
)
def flagship(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    scaled = cl.scale_z(parts, ["p_size", "p_retailprice"])
    # the radius shrinks with the density, so a part keeps about as many neighbours at any scale
    radius = math.sqrt(500 / max(1, parts.count()))
    edges = similarity_edges(scaled, "p_partkey", ["p_size", "p_retailprice"], "euclidean", radius)
    return metrics.size_measures(gb.build_graph(edges, parts))


@query("graph_build_vertices", f"WITH {fx.CONTACT_SQL} SELECT vid, name FROM node")
def _(spark, folder):
    return fx.contact(spark, folder).vertices


@query("graph_build_edges", f"WITH {fx.CONTACT_SQL} SELECT src, dst FROM edge")
def _(spark, folder):
    return fx.contact(spark, folder).edges.select("src", "dst")


@query(
    "graph_import_files",
    'SELECT s_suppkey AS "source", n.n_nationkey + (SELECT count(*) FROM supplier) AS "target", s_acctbal AS weight FROM supplier JOIN nation n ON s_nationkey = n_nationkey',
)
def _(spark, folder):
    """Supplier → nation, vertices numbered in file order: suppliers first, then nations."""
    paths = {n: scratch_path(spark, f"{n}.csv") for n in ("edges", "vertices")}
    supplier, nation = table(spark, folder, "supplier"), table(spark, folder, "nation")
    write_csv(supplier.select(F.col("s_name").alias("source"), F.concat(F.lit("NATION_"), "s_nationkey").alias("target"), F.col("s_acctbal").alias("weight")), paths["edges"])
    names = supplier.select(F.lit(0).alias("k"), F.col("s_suppkey").alias("i"), F.col("s_name").alias("name")).union(
        nation.select(F.lit(1), F.col("n_nationkey"), F.col("n_name"))
    )
    write_csv(names.orderBy("k", "i").select("name"), paths["vertices"])
    graph, _, _ = import_graph(spark, paths["edges"], paths["vertices"], directed=True)
    return gb.edge_table(graph)


@query(
    "graph_simplify",
    f"WITH {fx.TRADE_SQL} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edge WHERE src <> dst",
)
def _(spark, folder):
    return gb.simplify(fx.trade(spark, folder))


@query(
    "graph_vertex_table",
    f"""WITH {fx.BALANCE_SQL}, {SIZE_SQL} SELECT vid AS "vertex-ID", name, s_name AS "s-name", s_nationkey AS "s-nationkey",
        s_acctbal AS "s-acctbal", degree FROM node JOIN deg USING (vid)""",
)
def _(spark, folder):
    graph = fx.balance(spark, folder)
    return gb.vertex_table(graph, metrics.degrees(graph).select("vid", "degree"))


@query("graph_edge_table", f'WITH {fx.BALANCE_SQL} SELECT src AS source, dst AS target, round(dist, 4) AS dist FROM edge')
def _(spark, folder):
    return _round(gb.edge_table(fx.balance(spark, folder)), 4, "dist")


def _stack(spark, folder) -> gb.Overlay:
    """Nations (by trade), then suppliers (by balance), then contacts, tied by relation tables."""
    nations, suppliers, users = (f(spark, folder) for f in (fx.trade, fx.balance, fx.contact))
    supplier = table(spark, folder, "supplier")
    home = supplier.select("s_nationkey", "s_suppkey")
    served = table(spark, folder, "orders").select("o_custkey", "o_orderkey").select(
        (F.col("o_custkey") % 40).alias("a"), F.col("o_custkey").alias("b"), (F.col("o_orderkey") % 9).cast("double").alias("weight")
    )
    known = users.vertices.select(F.col("name").alias("b"))
    return gb.overlay([nations, suppliers, users], [None, home, served.join(known, "b", "left_semi").select("a", "b", "weight")])


OVERLAY_SQL = f"""tn AS (SELECT n_nationkey AS vid, n_nationkey::VARCHAR AS name FROM nation),
  sn AS (SELECT s_suppkey AS vid, s_suppkey::VARCHAR AS name FROM supplier),
  {fx.CONTACT_SQL}, n0 AS (SELECT count(*) AS n FROM tn), n1 AS (SELECT count(*) AS n FROM sn)"""


@query(
    "overlay_vertices",
    f"""WITH {OVERLAY_SQL} SELECT vid AS gid, 0 AS layer, name FROM tn UNION ALL
        SELECT vid + n0.n, 1, name FROM sn, n0 UNION ALL
        SELECT vid + n0.n + n1.n, 2, name::VARCHAR FROM node, n0, n1""",
)
def _(spark, folder):
    return _stack(spark, folder).vertices.select("gid", "layer", F.col("name").cast("string").alias("name"))


@query(
    "overlay_links",
    f"""WITH {OVERLAY_SQL},
        early AS (SELECT name, min(g) AS gid FROM (SELECT name, vid AS g FROM tn UNION ALL
            SELECT name, vid + n0.n FROM sn, n0 WHERE name NOT IN (SELECT name FROM tn)) GROUP BY name)
        SELECT t.vid AS src, s_suppkey + n0.n AS dst, 1 AS layer, 3.0::DOUBLE AS weight FROM supplier JOIN tn t ON t.vid = s_nationkey, n0
        UNION ALL
        SELECT early.gid, node.vid + n0.n + n1.n, 2, (o_orderkey % 9)::DOUBLE FROM orders
          JOIN early ON early.name = (o_custkey % 40)::VARCHAR JOIN node ON node.name = o_custkey, n0, n1""",
)
def _(spark, folder):
    return _stack(spark, folder).links


@query(
    "overlay_layer_sizes",
    f"""WITH {OVERLAY_SQL} SELECT 0 AS layer, count(*) AS n FROM tn UNION ALL SELECT 1, count(*) FROM sn UNION ALL SELECT 2, count(*) FROM node""",
)
def _(spark, folder):
    return _stack(spark, folder).vertices.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


# ---- measures -----------------------------------------------------------------------


@query(
    "measure_sizes_directed",
    f"""WITH {fx.TRADE_SQL}, {SIZE_SQL} SELECT true AS directed, {SIZE_COLS}, round(edges / (vertices * (vertices - 1.0)), 4) AS density FROM size""",
)
def _(spark, folder):
    return metrics.size_measures(fx.trade(spark, folder))


@query(
    "measure_degrees",
    f"""WITH {fx.TRADE_SQL}, o AS (SELECT src AS vid, count(*) AS n FROM edge GROUP BY src), i AS (SELECT dst AS vid, count(*) AS n FROM edge GROUP BY dst)
        SELECT vid, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree
        FROM node LEFT JOIN o USING (vid) LEFT JOIN i USING (vid)""",
)
def _(spark, folder):
    return metrics.degrees(fx.trade(spark, folder))


@query(
    "measure_degree_distribution",
    f"WITH {fx.SUPPLY_SQL}, {SIZE_SQL} SELECT degree, count(*) AS n FROM deg GROUP BY degree",
)
def _(spark, folder):
    return metrics.degree_distribution(fx.supply(spark, folder))


@query(
    "measure_density",
    f"WITH {fx.SUPPLY_SQL}, {SIZE_SQL} SELECT vertices, edges, round(2.0 * edges / (vertices * (vertices - 1.0)), 4) AS density FROM size",
)
def _(spark, folder):
    return metrics.size_measures(fx.supply(spark, folder)).select("vertices", "edges", "density")


TRIANGLES_SQL = """pair AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edge WHERE src <> dst),
  tri AS (SELECT count(*) AS triangles FROM pair x JOIN pair y ON x.b = y.a JOIN pair z ON z.a = x.a AND z.b = y.b),
  trip AS (SELECT CAST(sum(d * (d - 1) // 2) AS BIGINT) AS triples FROM (SELECT v, count(*) AS d FROM (SELECT a AS v FROM pair UNION ALL SELECT b FROM pair) GROUP BY v))"""


@query("measure_triangles", f"WITH {fx.CONTACT_SQL}, {TRIANGLES_SQL} SELECT triangles FROM tri")
def _(spark, folder):
    return metrics.triangle_count(fx.contact(spark, folder))


@query(
    "measure_clustering",
    f"""WITH {fx.BALANCE_SQL}, {TRIANGLES_SQL} SELECT triples, triangles, round(3.0 * triangles / triples, 4) AS clustering FROM tri, trip""",
)
def _(spark, folder):
    graph = fx.balance(spark, folder)
    triangles = metrics.triangle_count(graph).first()["triangles"]
    out = metrics.connected_triples(graph).withColumn("triangles", F.lit(triangles))
    return out.withColumn("clustering", F.round(F.try_divide(3.0 * F.col("triangles"), F.col("triples")), 4))


@query(
    "measure_paths",
    f"""WITH RECURSIVE {fx.CONTACT_SQL}, {fx.BOTH}, {fx.hops()} SELECT max(d) AS diameter, round(avg(d) FILTER (d > 0), 4) AS avg_path FROM hop""",
)
def _(spark, folder):
    return traverse.path_measures(traverse.hop_histogram(fx.contact(spark, folder)))


@query(
    "measure_paths_directed",
    f"""WITH RECURSIVE {fx.FOLLOW_SQL}, {fx.ONE_WAY}, {fx.hops()} SELECT max(d) AS diameter, round(avg(d) FILTER (d > 0), 4) AS avg_path FROM hop""",
)
def _(spark, folder):
    return traverse.path_measures(traverse.hop_histogram(fx.follow(spark, folder)))


@query(
    "measure_hop_histogram",
    f"""WITH RECURSIVE {fx.BALANCE_SQL}, {fx.BOTH}, {fx.hops()} SELECT d, count(*) AS n FROM hop WHERE d > 0 GROUP BY d""",
)
def _(spark, folder):
    return traverse.hop_histogram(fx.balance(spark, folder))


@query(
    "path_distances_from_one",
    f"""WITH RECURSIVE {fx.FOLLOW_SQL}, {fx.ONE_WAY}, {fx.hops()} SELECT v AS vid, d FROM hop WHERE s = 0""",
)
def _(spark, folder):
    return traverse.distances_from(fx.follow(spark, folder), 0)


WINDOW_CLIQUE = "SELECT max(n) FROM (SELECT count(*) AS n FROM supplier a JOIN supplier b ON b.s_acctbal >= a.s_acctbal AND abs(a.s_acctbal - b.s_acctbal) < (SELECT 20000::DOUBLE / count(*) FROM supplier) GROUP BY a.s_suppkey)"


@query("measure_clique_number", f"SELECT ({WINDOW_CLIQUE})::BIGINT AS clique_number")
def _(spark, folder):
    found = cliques.clique_number(fx.balance(spark, folder))
    return spark.createDataFrame([(found,)], "clique_number long")


@query("measure_core_numbers")
def _(spark, folder):
    return cliques.core_numbers(fx.contact(spark, folder))


RECORD_SQL = f"""WITH RECURSIVE {fx.BALANCE_SQL}, {SIZE_SQL}, {TRIANGLES_SQL}, {fx.BOTH}, {fx.hops()},
        p AS (SELECT max(d) AS diameter, round(avg(d) FILTER (d > 0), 4) AS avg_path FROM hop)
        SELECT false AS directed, {SIZE_COLS}, round(2.0 * edges / (vertices * (vertices - 1.0)), 4) AS density,
        round(3.0 * triangles / triples, 4) AS clustering, diameter, avg_path, ({WINDOW_CLIQUE})::BIGINT AS clique_number
        FROM size, tri, trip, p"""


@query("summary_record", RECORD_SQL)
def _(spark, folder):
    return summary.summarize(fx.balance(spark, folder))


# ---- centralities -------------------------------------------------------------------


@query(
    "centrality_closeness",
    f"""WITH RECURSIVE {fx.BALANCE_SQL}, {fx.BOTH}, {fx.hops()},
        c AS (SELECT s AS vid, count(*) - 1 AS r, sum(d) AS far FROM hop GROUP BY s)
        SELECT vid, CASE WHEN far = 0 THEN -1.0 ELSE round(r / far, 5) END::DOUBLE AS closeness FROM c""",
)
def _(spark, folder):
    return traverse.closeness(fx.balance(spark, folder))


@query(
    "centrality_closeness_directed",
    f"""WITH RECURSIVE {fx.FOLLOW_SQL}, {fx.BOTH}, {fx.hops()},
        c AS (SELECT s AS vid, count(*) - 1 AS r, sum(d) AS far FROM hop GROUP BY s)
        SELECT vid, CASE WHEN far = 0 THEN -1.0 ELSE round(r / far, 5) END::DOUBLE AS closeness FROM c""",
)
def _(spark, folder):
    return traverse.closeness(fx.follow(spark, folder))


# shortest-path counts: extend paths by one arc while the hop count grows by one
COUNTS_SQL = """cnt(s, v, d, n) AS (SELECT vid, vid, 0, 1.0::DOUBLE FROM node UNION ALL
   SELECT cnt.s, arc.dst, cnt.d + 1, sum(cnt.n) FROM cnt JOIN arc ON cnt.v = arc.src JOIN hop ON hop.s = cnt.s AND hop.v = arc.dst AND hop.d = cnt.d + 1
   GROUP BY cnt.s, arc.dst, cnt.d)"""
BETWEEN_SQL = """bc AS (SELECT a.v AS vid, sum(a.n * b.n / c.n) AS b FROM cnt a JOIN cnt b ON a.v = b.s
   JOIN cnt c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY a.v)"""


def _between_sql(graph: str, arcs: str, share: str) -> str:
    return f"""WITH RECURSIVE {graph}, {arcs}, {fx.hops()}, {COUNTS_SQL}, {BETWEEN_SQL}
        SELECT vid, round(coalesce(b * {share}, 0), 5)::DOUBLE AS betweenness FROM node LEFT JOIN bc USING (vid)"""


@query("centrality_betweenness", _between_sql(fx.CONTACT_SQL, fx.BOTH, "0.5"))
def _(spark, folder):
    return centrality.betweenness(fx.contact(spark, folder))


@query("centrality_betweenness_directed", _between_sql(fx.FOLLOW_SQL, fx.ONE_WAY, "1.0"))
def _(spark, folder):
    return centrality.betweenness(fx.follow(spark, folder))


@query(
    "centrality_edge_betweenness",
    f"""WITH RECURSIVE {fx.BALANCE_SQL}, {fx.BOTH}, {fx.hops()}, {COUNTS_SQL}
        SELECT least(x.src, x.dst) AS src, greatest(x.src, x.dst) AS dst, round(sum(a.n * b.n / c.n) / 2, 4) AS betweenness
        FROM arc x JOIN cnt a ON a.v = x.src JOIN cnt b ON b.s = x.dst JOIN cnt c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d + 1 GROUP BY 1, 2""",
)
def _(spark, folder):
    return _round(centrality.edge_betweenness(fx.balance(spark, folder)), 4, "betweenness")


@query(
    "centrality_betweenness_pivots",
    f"""WITH RECURSIVE {fx.CONTACT_SQL}, {fx.BOTH}, {fx.hops()}, {COUNTS_SQL},
        chosen AS (SELECT vid AS p FROM node ORDER BY md5(vid || ':7'), vid LIMIT 64),
        bc AS (SELECT a.v AS vid, sum(a.n * b.n / c.n) AS b FROM cnt a JOIN chosen ON a.s = p JOIN cnt b ON a.v = b.s
          JOIN cnt c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY a.v)
        SELECT vid, round(coalesce(b * 0.5 * greatest(1, (SELECT count(*) FROM node) / 64.0), 0), 5)::DOUBLE AS betweenness
        FROM node LEFT JOIN bc USING (vid)""",
)
def _(spark, folder):
    return centrality.betweenness(fx.contact(spark, folder), pivots=64, seed=7)


def _rank_sql(graph: str, arcs: str) -> str:
    return f"""WITH RECURSIVE {graph}, {arcs}, outw AS (SELECT src, count(*) AS total FROM way GROUP BY src),
      sz AS (SELECT count(*)::DOUBLE AS n FROM node),
      step AS (SELECT way.src, way.dst, count(*) / any_value(total) AS share FROM way JOIN outw ON way.src = outw.src GROUP BY way.src, way.dst),
      pr(i, vid, r) AS (SELECT 0, vid, 1 / n FROM node, sz UNION ALL
        SELECT i + 1, vid, sum(x) FROM (SELECT i, step.dst AS vid, 0.85 * r * share AS x FROM pr JOIN step ON pr.vid = step.src
          UNION ALL SELECT i, vid, 0.15 / n FROM pr, sz) WHERE i < 160 GROUP BY i, vid),
      last AS (SELECT vid, r FROM pr WHERE i = 160)
      SELECT vid, round(r / (SELECT sum(r) FROM last), 5) AS pagerank FROM last"""


TWO_WAYS = "way AS (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge)"
AS_IS = "way AS (SELECT src, dst FROM edge)"


@query("centrality_pagerank", _rank_sql(fx.CONTACT_SQL, TWO_WAYS))
def _(spark, folder):
    return _round(centrality.pagerank(fx.contact(spark, folder)), 5, "pagerank")


@query("centrality_pagerank_directed", _rank_sql(fx.FOLLOW_SQL, AS_IS))
def _(spark, folder):
    return _round(centrality.pagerank(fx.follow(spark, folder)), 5, "pagerank")


@query("centrality_pagerank_multigraph", _rank_sql(fx.TRADE_SQL, AS_IS))
def _(spark, folder):
    return _round(centrality.pagerank(fx.trade(spark, folder)), 5, "pagerank")


@query(
    "components_connected",
    f"""WITH RECURSIVE {fx.BALANCE_SQL}, {fx.BOTH}, reach(s, v) AS (SELECT vid, vid FROM node UNION SELECT reach.s, arc.dst FROM reach JOIN arc ON reach.v = arc.src)
        SELECT s AS vid, min(v) AS component FROM reach GROUP BY s""",
)
def _(spark, folder):
    return components.connected_components(fx.balance(spark, folder))


HOP_SUMS = "sizes AS (SELECT d AS hops, sum(count(*)) OVER (ORDER BY d) AS pairs FROM hop GROUP BY d)"


@query(
    "measure_neighbourhood_function",
    f"""WITH RECURSIVE {fx.CONTACT_SQL}, {fx.BOTH}, {fx.hops()}, {HOP_SUMS} SELECT hops::INTEGER AS hops, pairs::BIGINT AS pairs FROM sizes""",
)
def _(spark, folder):
    """Sketches of a few hundred vertices are exact; tests bound the error of larger ones."""
    return traverse.neighbourhood_function(fx.contact(spark, folder))


@query(
    "measure_effective_diameter",
    f"""WITH RECURSIVE {fx.CONTACT_SQL}, {fx.BOTH}, {fx.hops()}, {HOP_SUMS}, steps AS (SELECT hops, pairs, lag(pairs, 1, 0) OVER (ORDER BY hops) AS less,
        0.9::DOUBLE * max(pairs) OVER () AS goal FROM sizes)
        SELECT round(CASE WHEN hops = 0 THEN 0 ELSE hops - 1 + (goal - less) / (pairs - less) END, 4) AS effective_diameter FROM steps
        WHERE pairs >= goal AND (less < goal OR hops = 0)""",
)
def _(spark, folder):
    found = traverse.effective_diameter(traverse.neighbourhood_function(fx.contact(spark, folder)))
    return _round(spark.createDataFrame([(found,)], "effective_diameter double"), 4, "effective_diameter")


@query(
    "centrality_closeness_sketch",
    f"""WITH RECURSIVE {fx.CONTACT_SQL}, {fx.BOTH}, {fx.hops()}, c AS (SELECT s AS vid, count(*) - 1 AS reached, sum(d)::BIGINT AS far FROM hop GROUP BY s)
        SELECT vid, reached, far, CASE WHEN far = 0 THEN -1.0 ELSE round(reached / far, 5) END::DOUBLE AS closeness FROM c""",
)
def _(spark, folder):
    return traverse.sketch_closeness(fx.contact(spark, folder))


def _register_diameter(name: str, graph, sql: str) -> None:
    @query(f"measure_diameter_{name}", f"WITH RECURSIVE {sql}, {fx.BOTH}, {fx.hops()} SELECT max(d)::BIGINT AS diameter FROM hop")
    def _(spark, folder):
        return spark.createDataFrame([(traverse.exact_diameter(graph(spark, folder))[0],)], "diameter long")


_register_diameter("contact", fx.contact, fx.CONTACT_SQL)
_register_diameter("balance", fx.balance, fx.BALANCE_SQL)


# ---- paths --------------------------------------------------------------------------


@query(
    "path_shortest",
    f"""WITH RECURSIVE {fx.CONTACT_SQL}, {fx.BOTH}, ends AS (SELECT 0 AS a, max(vid) AS b FROM node),
        f(v, d) AS (SELECT a, 0 FROM ends UNION SELECT arc.dst, f.d + 1 FROM f JOIN arc ON f.v = arc.src WHERE f.d < 40),
        t(v, d) AS (SELECT b, 0 FROM ends UNION SELECT arc.dst, t.d + 1 FROM t JOIN arc ON t.v = arc.src WHERE t.d < 40),
        fd AS (SELECT v, min(d) AS d FROM f GROUP BY v), td AS (SELECT v, min(d) AS d FROM t GROUP BY v),
        p(step, vid) AS (SELECT 0, a FROM ends UNION ALL
          SELECT step + 1, min(arc.dst) FROM p JOIN arc ON p.vid = arc.src JOIN fd ON fd.v = arc.dst AND fd.d = p.step + 1 JOIN td ON td.v = arc.dst
          WHERE fd.d + td.d = (SELECT d FROM fd, ends WHERE v = b) GROUP BY step)
        SELECT step, vid, name::VARCHAR AS label FROM p JOIN node USING (vid)""",
)
def _(spark, folder):
    graph = fx.contact(spark, folder)
    last = graph.vertices.agg(F.max("vid")).first()[0]
    return traverse.shortest_path(graph, 0, last)


# ---- chart encodings ----------------------------------------------------------------


def _scale_sql(c: str, t: str, low: float, high: float) -> str:
    return f"({low} + {high - low}::DOUBLE / (SELECT max({c}) - min({c}) FROM {t}) * ({c} - (SELECT min({c}) FROM {t})))"


@query("encode_rescale", f"SELECT s_suppkey, round({_scale_sql('s_acctbal', 'supplier', 1, 10)}, 4) AS scaled FROM supplier")
def _(spark, folder):
    df = table(spark, folder, "supplier")
    return df.select("s_suppkey", F.round(en.rescaled(df, "s_acctbal", 1, 10), 4).alias("scaled"))


@query(
    "encode_node_size",
    f"""WITH {fx.BALANCE_SQL}, {SIZE_SQL}, d AS (SELECT vid, degree, s_acctbal FROM node JOIN deg USING (vid))
        SELECT vid, CAST(floor(20 + 5 * {_scale_sql('degree', 'd', 1, 10)}) AS INTEGER) AS by_degree,
        CAST(floor(30 + 40 * {_scale_sql('s_acctbal', 'd', 1, 10)}) AS INTEGER) AS by_balance FROM d""",
)
def _(spark, folder):
    graph = fx.balance(spark, folder)
    df = graph.vertices.join(metrics.degrees(graph).select("vid", "degree"), "vid")
    return df.select("vid", en.node_size(df, "degree").alias("by_degree"), en.node_size(df, "s_acctbal").alias("by_balance"))


@query(
    "encode_value_colour",
    f"SELECT c_custkey, CAST(ceil({_scale_sql('c_acctbal', 'customer', 1, 10)}) AS INTEGER) AS colour FROM customer",
)
def _(spark, folder):
    df = table(spark, folder, "customer")
    return df.select("c_custkey", en.value_class(df, "c_acctbal").alias("colour"))


@query(
    "encode_category_colour",
    "SELECT p_partkey, p_brand, CAST(least(dense_rank() OVER (ORDER BY p_brand) - 1, 19) AS INTEGER) AS colour FROM part",
)
def _(spark, folder):
    return en.category_class(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_brand", "colour", 20)


@query(
    "encode_edge_width",
    f"""WITH {fx.BALANCE_SQL}, w AS (SELECT src, dst, dist, 200 - dist AS weight FROM edge)
        SELECT src, dst, CAST(floor(10 + 20 / {_scale_sql('dist', 'w', 0.2, 1.0)}) AS INTEGER) AS by_dist FROM w""",
)
def _(spark, folder):
    df = fx.balance(spark, folder).edges
    return df.select("src", "dst", en.edge_width(df, "dist").alias("by_dist"))


@query(
    "encode_edge_width_weight",
    f"""WITH {fx.TRADE_SQL} SELECT src, dst, weight, CAST(floor(10 + 20 * {_scale_sql('weight', 'edge', 0.2, 1.0)}) AS INTEGER) AS by_weight FROM edge""",
)
def _(spark, folder):
    df = fx.trade(spark, folder).edges
    return df.select("src", "dst", "weight", en.edge_width(df, "weight").alias("by_weight"))


@query(
    "encode_label_tooltip",
    f"""WITH {fx.BALANCE_SQL} SELECT vid, name::VARCHAR AS label, s_name AS chosen,
        'ID:' || vid || chr(10) || 'name:' || name || chr(10) || 's_name:' || s_name || chr(10) || 's_nationkey:' || s_nationkey AS tooltip FROM node""",
)
def _(spark, folder):
    df = fx.balance(spark, folder).vertices
    return df.select(
        "vid",
        en.label(df).alias("label"),
        en.label(df, "s_name").alias("chosen"),
        en.tooltip(["name", "s_name", "s_nationkey"]).alias("tooltip"),
    )


@query("encode_shape_image", f"WITH {fx.BALANCE_SQL} SELECT vid, 'image' AS symbol, s_name AS image, 'rect' AS plain FROM node")
def _(spark, folder):
    df = fx.balance(spark, folder).vertices
    symbol, image = en.shape("image", "s_name")
    return df.select("vid", symbol.alias("symbol"), image.alias("image"), en.shape("rect")[0].alias("plain"))


# ---- exports ------------------------------------------------------------------------


def _by_component(spark, folder):
    graph = fx.balance(spark, folder)
    membership = components.connected_components(graph).withColumnRenamed("component", "community")
    return graph, components.relabel(membership)


COMPONENT_SQL = f"""{fx.BALANCE_SQL}, {fx.BOTH}, reach(s, v) AS (SELECT vid, vid FROM node UNION SELECT reach.s, arc.dst FROM reach JOIN arc ON reach.v = arc.src),
  comp AS (SELECT s AS vid, min(v) AS component FROM reach GROUP BY s), member AS (SELECT vid, dense_rank() OVER (ORDER BY component) - 1 AS community FROM comp)"""


@query(
    "export_chart_nodes",
    f"""WITH RECURSIVE {COMPONENT_SQL} SELECT vid::VARCHAR AS id, name::VARCHAR AS name, 'ID:' || vid AS value, 'circle' AS symbol,
        20 AS "symbolSize", CAST(community AS INTEGER) AS category FROM node JOIN member USING (vid)""",
)
def _(spark, folder):
    path = scratch_path(spark, "chart")
    exports.community_chart(*_by_component(spark, folder)).write(path)
    return spark.read.json(f"{path}/nodes").select(
        "id", "name", "value", "symbol", F.col("symbolSize").cast("int").alias("symbolSize"), F.col("category").cast("int").alias("category")
    )


@query(
    "export_chart_edges",
    f"""WITH {fx.BALANCE_SQL} SELECT src::VARCHAR AS source, dst::VARCHAR AS target, false AS arrow, 1 AS width, 'solid' AS kind FROM edge""",
)
def _(spark, folder):
    edges = exports.community_chart(*_by_component(spark, folder)).edges
    return edges.select("source", "target", "arrow", F.col("lineStyle.width").alias("width"), F.col("lineStyle.type").alias("kind"))


@query(
    "export_chart_overlay",
    f"""WITH {OVERLAY_SQL} SELECT CASE WHEN layer < 0 THEN 'dashed' ELSE 'solid' END AS kind, arrow, count(*) AS n FROM (
        SELECT 0 AS layer, true AS arrow FROM lineitem UNION ALL
        SELECT 1, false FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < (SELECT 20000::DOUBLE / count(*) FROM supplier) UNION ALL
        SELECT 2, false FROM edge UNION ALL SELECT -1, false FROM supplier UNION ALL
        SELECT -1, false FROM orders JOIN node ON name = o_custkey) GROUP BY 1, 2""",
)
def _(spark, folder):
    edges = exports.overlay_chart(_stack(spark, folder)).edges
    return edges.groupBy(F.col("lineStyle.type").alias("kind"), "arrow").agg(F.count(F.lit(1)).alias("n"))


@query(
    "export_graphml",
    f"""WITH {fx.BALANCE_SQL} SELECT 'node' AS element, count(*) AS n FROM node UNION ALL SELECT 'edge', count(*) FROM edge""",
)
def _(spark, folder):
    path = scratch_path(spark, "graph.graphml")
    exports.write_graphml(fx.balance(spark, folder), path)
    lines = spark.read.text(path).select(F.regexp_extract("value", "^<(node|edge) ", 1).alias("element"), "value")
    key = F.when(F.col("element") == "node", F.expr("xpath_string(value, '/node/@id')")).otherwise(
        F.expr("xpath_string(value, '/edge/@source')")
    )
    return lines.where("element <> ''").groupBy("element").agg(F.count_if(key.rlike("^n[0-9]+$")).alias("n"))


@query("export_summary_json", RECORD_SQL)
def _(spark, folder):
    record = summary.summary_json(fx.balance(spark, folder))
    fields = (
        "directed boolean, vertices long, edges long, avg_degree double, max_degree long, density double, clustering double, diameter long, "
        "avg_path double, clique_number long"
    )
    return record.select(F.from_json("record", fields).alias("r")).select("r.*")
