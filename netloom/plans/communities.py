"""Queries that find and judge communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators.community import detect, quality
from netloom.operators.graph import build_graph
from netloom.plans import fixtures as fx
from netloom.plans.registry import query, table


def _register(name: str, algorithm: str, graph, **options) -> None:
    @query(f"community_{name}")
    def _(spark, folder):
        return detect(graph(spark, folder), algorithm, **options)


_register("label_propagation", "LabelPropagation", fx.contact)
_register("louvain", "MultiLevel", fx.contact)
_register("leiden", "Leiden", fx.contact)
_register("leiden_cpm", "Leiden", fx.balance, objective_name="CPM", resolution=0.3)
_register("fast_greedy", "FastGreedy", fx.contact)
_register("walktrap", "WalkTrap", fx.balance)
_register("walktrap_sketch", "WalkTrap", fx.balance, sketch=32)
_register("infomap", "InfoMap", fx.balance)
_register("leading_eigenvector", "LeadingEigenvector", fx.contact)
_register("edge_betweenness", "EdgeBetweenness", fx.balance)
_register("spin_glass", "SpinGlass", fx.contact)


def _planted_nations(spark, folder, group):
    """Nations joined with all others of their group, and the leaders of the groups in a ring."""
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey").withColumn("g", group)
    a, b = (nations.select(F.col("n_nationkey").alias(c), "g") for c in ("source", "target"))
    inside = a.join(b, "g").where("source < target").select("source", "target")
    heads = nations.groupBy("g").agg(F.min("n_nationkey").alias("head"))
    following = heads.select((F.col("g") - 1).alias("g"), F.col("head").alias("next"))
    ring = heads.join(following, "g").select(F.col("head").alias("source"), F.col("next").alias("target"))
    return build_graph(inside.unionByName(ring), nations.drop("g"))


def _regions(spark, folder):
    return _planted_nations(spark, folder, F.col("n_regionkey"))


#: Groups of 3, 5, 7 and 10 nations: no two eigenvalues are equal.
_STEPS = "CASE WHEN n_nationkey < 3 THEN 0 WHEN n_nationkey < 8 THEN 1 WHEN n_nationkey < 15 THEN 2 ELSE 3 END"


def _unequal(spark, folder):
    return _planted_nations(spark, folder, F.expr(_STEPS))


def _blocks(spark, folder):
    """Customers joined with all others of their ten consecutive keys: many components, edges linear in rows."""
    ids = table(spark, folder, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 10).alias("g"))
    a, b = (ids.select(F.col("c_custkey").alias(c), "g") for c in ("source", "target"))
    return build_graph(a.join(b, "g").where("source < target").select("source", "target"), ids.select("c_custkey"))


def _planted_sql(rows: str, key: str, group: str) -> str:
    return f"""SELECT {key} AS name, dense_rank() OVER (ORDER BY least_key) - 1 AS community FROM
        (SELECT {key}, min({key}) OVER (PARTITION BY {group}) AS least_key FROM {rows})"""


def _register_planted(name: str, algorithm: str, graph, sql: str | None, **options) -> None:
    @query(f"community_{name}", sql)
    def _(spark, folder):
        found = graph(spark, folder)
        member = detect(found, algorithm, **options)
        return member.join(found.vertices.select("vid", "name"), "vid").select("name", "community")


_NATIONS = _planted_sql("nation", "n_nationkey", "n_regionkey")
for _name, _algorithm, _options in (
    ("label_propagation", "LabelPropagation", {}),
    ("louvain", "MultiLevel", {}),
    ("leiden", "Leiden", {}),
    ("fast_greedy", "FastGreedy", {}),
    ("walktrap", "WalkTrap", {}),
    ("infomap", "InfoMap", {}),
    ("edge_betweenness", "EdgeBetweenness", {}),
    ("spin_glass", "SpinGlass", {}),
):
    _register_planted(f"planted_{_name}", _algorithm, _regions, _NATIONS, **_options)
# The planted SQL answer does not hold here: the groups of 3 and 5 come out as one, as splitting them gains next to nothing.
_register_planted("planted_leading_eigenvector", "LeadingEigenvector", _unequal, None)
_BLOCKS = _planted_sql("customer", "c_custkey", "c_custkey // 10")
for _name, _algorithm in (("louvain", "MultiLevel"), ("leiden", "Leiden"), ("fast_greedy", "FastGreedy"), ("infomap", "InfoMap"), ("label_propagation", "LabelPropagation")):
    _register_planted(f"blocks_{_name}", _algorithm, _blocks, _BLOCKS)


@query(
    "community_leiden_cpm_default",
    f"WITH {fx.BALANCE_SQL} SELECT vid, vid AS community FROM node",
)
def _(spark, folder):
    """At resolution 1 no merge pays on a simple graph, apart from ties: every vertex stays alone."""
    return detect(fx.balance(spark, folder), "Leiden", objective_name="CPM", resolution=1.0)


BY_NATION = "member AS (SELECT vid, s_nationkey AS community FROM node)"


def _by_nation(spark, folder):
    graph = fx.balance(spark, folder)
    return graph, graph.vertices.select("vid", F.col("s_nationkey").alias("community"))


@query(
    "community_modularity",
    f"""WITH {fx.BALANCE_SQL}, {BY_NATION}, ends AS (SELECT x.community AS a, y.community AS b FROM edge JOIN member x ON x.vid = src JOIN member y ON y.vid = dst),
        both_ends AS (SELECT a, b FROM ends UNION ALL SELECT b, a FROM ends), m AS (SELECT count(*) AS m2 FROM both_ends),
        per AS (SELECT a, count(*) FILTER (a = b) AS inside, count(*) AS total FROM both_ends GROUP BY a)
        SELECT round(sum(inside / m2 - (total / m2) ** 2), 6) AS modularity FROM per, m""",
)
def _(spark, folder):
    return quality.modularity(*_by_nation(spark, folder)).select(F.round("modularity", 6).alias("modularity"))


@query(
    "community_summary",
    f"""WITH {fx.BALANCE_SQL}, {BY_NATION} SELECT community, count(*) AS size, round(count(*) / (SELECT count(*) FROM member), 6) AS share
        FROM member GROUP BY community""",
)
def _(spark, folder):
    out = quality.community_summary(_by_nation(spark, folder)[1])
    return out.withColumn("share", F.round("share", 6))


@query("community_count", f"WITH {fx.BALANCE_SQL}, {BY_NATION} SELECT count(DISTINCT community) AS communities FROM member")
def _(spark, folder):
    return quality.community_count(_by_nation(spark, folder)[1])
