"""Graphs derived from the given tables, built once per session and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.times import wall_micros
from netloom.operators.clean import label_encode
from netloom.operators.graph import Graph, build_graph
from netloom.operators.pairs import similarity_edges
from netloom.plans.registry import table
from netloom.runtime import shuffle_width

_BUILT: dict[tuple, Graph] = {}

# Bounds narrow with the rows, so that edges grow as the rows and not as their square: a minute at 10,000 events,
# a difference of 200 at 100 suppliers.
GAP_MICROS = 600_000_000_000
BALANCE_GAP = 20_000.0


def _once(kind: str, make):
    def get(spark: SparkSession, folder: str) -> Graph:
        key = (spark.sparkContext.applicationId, folder, kind)
        if key not in _BUILT:
            _BUILT[key] = make(spark, folder)
        return _BUILT[key]

    return get


def _close_events(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of events of one type less than the gap apart, with user and time of both.

    Time and a widely spaced type code form a point of whole numbers; the largest coordinate difference is
    below the gap exactly when the types agree and the times are close.
    """
    events = table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", wall_micros(F.col("ts")).alias("us")
    )
    gap = GAP_MICROS // max(1, events.count())
    # user and time travel in the id, so that the pairs need not be joined with the events again
    points = label_encode(events, ["event_type"]).select(
        F.struct("event_id", "user_id", "us").alias("event"),
        (F.col("us") - F.lit(1704067200000000)).cast("double").alias("t"),
        (F.col("event_type") * (2 * gap + 1)).cast("double").alias("k"),
    )
    near = similarity_edges(points, "event", ["t", "k"], "chebyshev", float(gap))
    ends = [F.col(f"{end}.{c}").alias(f"{n}_{tag}") for end, tag in (("source", "a"), ("target", "b")) for c, n in (("user_id", "user"), ("us", "us"))]
    return near.select(*ends)


def _by_events(spark: SparkSession, folder: str):
    """Shuffles sized to the events and the cells that each of them looks at."""
    return shuffle_width(spark, 5 * table(spark, folder, "events").count())


def _contact(spark: SparkSession, folder: str) -> Graph:
    pairs = (
        _close_events(spark, folder)
        .where("user_a <> user_b")
        .select(F.least("user_a", "user_b").alias("source"), F.greatest("user_a", "user_b").alias("target"))
        .distinct()
    )
    with _by_events(spark, folder):
        return build_graph(pairs)


def _follow(spark: SparkSession, folder: str) -> Graph:
    first_a = F.col("us_a") < F.col("us_b")
    pairs = (
        _close_events(spark, folder)
        .where("user_a <> user_b and us_a <> us_b")
        .select(
            F.when(first_a, F.col("user_a")).otherwise(F.col("user_b")).alias("source"),
            F.when(first_a, F.col("user_b")).otherwise(F.col("user_a")).alias("target"),
        )
        .distinct()
    )
    with _by_events(spark, folder):
        return build_graph(pairs, directed=True)


def _balance(spark: SparkSession, folder: str) -> Graph:
    suppliers = table(spark, folder, "supplier")
    edges = similarity_edges(suppliers, "s_suppkey", ["s_acctbal"], "cityblock", BALANCE_GAP / max(1, suppliers.count()))
    return build_graph(edges, suppliers.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))


def _trade(spark: SparkSession, folder: str) -> Graph:
    """Supplier nation → customer nation, one edge per order line: repeats and loops kept."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").alias("weight"))
    edges = (
        lines.join(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        .select(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target"), "weight")
    )
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("label"), "n_regionkey")
    return build_graph(edges, nations, directed=True)


def _supply(spark: SparkSession, folder: str) -> Graph:
    """Parts and suppliers as one undirected graph, an edge per order line."""
    edges = table(spark, folder, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("source"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("target"),
        F.col("l_quantity").alias("weight"),
    )
    return build_graph(edges, scan=True)


contact = _once("contact", _contact)
follow = _once("follow", _follow)
balance = _once("balance", _balance)
trade = _once("trade", _trade)
supply = _once("supply", _supply)


# The same graphs in SQL, each as CTEs ``node(vid, name)`` and ``edge(src, dst, …)``.
_CLOSE = """a JOIN events b ON a.user_id <> b.user_id AND a.event_type = b.event_type
   AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < (SELECT 600000000000 // count(*) FROM events)"""
_FROM_ENDS = """node AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS vid FROM
   (SELECT s AS name FROM raw UNION SELECT t FROM raw)),
 edge AS (SELECT x.vid AS src, y.vid AS dst FROM raw JOIN node x ON raw.s = x.name JOIN node y ON raw.t = y.name)"""
CONTACT_SQL = f"raw AS (SELECT DISTINCT a.user_id AS s, b.user_id AS t FROM events {_CLOSE} WHERE a.user_id < b.user_id), {_FROM_ENDS}"
FOLLOW_SQL = f"raw AS (SELECT DISTINCT a.user_id AS s, b.user_id AS t FROM events {_CLOSE} WHERE a.ts < b.ts), {_FROM_ENDS}"
BALANCE_SQL = """node AS (SELECT s_suppkey AS vid, s_suppkey AS name, s_name, s_nationkey, s_acctbal FROM supplier),
 edge AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, abs(a.s_acctbal - b.s_acctbal) AS dist FROM supplier a
  JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < (SELECT 20000::DOUBLE / count(*) FROM supplier))"""
TRADE_SQL = """node AS (SELECT n_nationkey AS vid, n_nationkey AS name, n_name AS label, n_regionkey FROM nation),
 edge AS (SELECT s_nationkey AS src, c_nationkey AS dst, l_quantity AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
SUPPLY_SQL = f"""raw AS (SELECT 'P' || l_partkey AS s, 'S' || l_suppkey AS t FROM lineitem), {_FROM_ENDS}"""
BOTH = "arc AS (SELECT src, dst FROM edge WHERE src <> dst UNION SELECT dst, src FROM edge WHERE src <> dst)"
ONE_WAY = "arc AS (SELECT DISTINCT src, dst FROM edge WHERE src <> dst)"


def hops(limit: int = 40) -> str:
    """CTE ``hop(s, v, d)`` over ``arc``; paths longer than ``limit`` are not followed."""
    return f"""walk(s, v, d) AS (SELECT vid, vid, 0 FROM node UNION
      SELECT walk.s, arc.dst, walk.d + 1 FROM walk JOIN arc ON walk.v = arc.src WHERE walk.d < {limit}),
    hop AS (SELECT s, v, min(d) AS d FROM walk GROUP BY s, v)"""
