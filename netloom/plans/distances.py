"""Queries that turn rows into similarity edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import clean as cl
from netloom.operators.nearest import nearest_neighbours, nearest_vectors
from netloom.operators.pairs import similarity_edges, similarity_where
from netloom.operators.sets import set_edges
from netloom.operators.vectors import vector_join
from netloom.plans.registry import query, table

Z = """(SELECT {k} AS id, ({a} - (SELECT avg({a}) FROM {t})) / (SELECT stddev_pop({a}) FROM {t}) AS x,
        ({b} - (SELECT avg({b}) FROM {t})) / (SELECT stddev_pop({b}) FROM {t}) AS y FROM {t})"""
PART_Z = Z.format(k="p_partkey", a="p_size", b="p_retailprice", t="part")


def _part_z(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return cl.scale_z(df, ["p_size", "p_retailprice"])


def _pairs_sql(rows: str, dist: str, bound: float) -> str:
    return f"""SELECT a.id AS source, b.id AS target, round({dist}, 5) AS dist FROM {rows} a JOIN {rows} b ON a.id < b.id
               WHERE {dist} < {bound}"""


def _edges(df: DataFrame, key: str, cols: list[str], metric: str, bound: float, **kw) -> DataFrame:
    out = similarity_edges(df, key, cols, metric, bound, **kw)
    return out.withColumn("dist", F.round("dist", 5))


def _register(metric: str, dist: str, bound: float, **kw) -> None:
    @query(f"dist_{metric}", _pairs_sql(PART_Z, dist, bound))
    def _(spark, folder):
        return _edges(_part_z(spark, folder), "p_partkey", ["p_size", "p_retailprice"], metric, bound, **kw)


_register("euclidean", "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)", 0.1)
_register("sqeuclidean", "((a.x - b.x) ** 2 + (a.y - b.y) ** 2)", 0.01)
_register("cityblock", "(abs(a.x - b.x) + abs(a.y - b.y))", 0.1)
_register("chebyshev", "greatest(abs(a.x - b.x), abs(a.y - b.y))", 0.08)
_register("minkowski", "((abs(a.x - b.x) ** 3 + abs(a.y - b.y) ** 3) ** (1.0 / 3))", 0.1, p=3.0)

STACKED = """(SELECT *, (SELECT var_pop({a}) * 2 * count(*) / (2 * count(*) - 1) FROM {t}) AS va,
  (SELECT var_pop({b}) * 2 * count(*) / (2 * count(*) - 1) FROM {t}) AS vb,
  (SELECT covar_pop({a}, {b}) * 2 * count(*) / (2 * count(*) - 1) FROM {t}) AS vab
  FROM (SELECT {k} AS id, CAST({a} AS DOUBLE) AS x, {b} AS y FROM {t}))"""
PART_STACKED = STACKED.format(k="p_partkey", a="p_size", b="p_retailprice", t="part")


@query(
    "dist_seuclidean",
    _pairs_sql(PART_STACKED, "sqrt((a.x - b.x) ** 2 / a.va + (a.y - b.y) ** 2 / a.vb)", 0.1),
)
def _(spark, folder):
    return _edges(table(spark, folder, "part"), "p_partkey", ["p_size", "p_retailprice"], "seuclidean", 0.1)


@query(
    "dist_mahalanobis",
    _pairs_sql(
        PART_STACKED,
        "sqrt(greatest(0, ((a.x - b.x) ** 2 * a.vb - 2 * (a.x - b.x) * (a.y - b.y) * a.vab + (a.y - b.y) ** 2 * a.va)"
        " / (a.va * a.vb - a.vab ** 2)))",
        0.1,
    ),
)
def _(spark, folder):
    return _edges(table(spark, folder, "part"), "p_partkey", ["p_size", "p_retailprice"], "mahalanobis", 0.1)


# customers as points (balance, nation, key share): positive and negative coordinates
CUST3 = "(SELECT c_custkey AS id, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y, (c_custkey % 11) / 2.0::DOUBLE AS z FROM customer)"


def _cust3(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 1000).alias("x"),
        F.col("c_nationkey").cast("double").alias("y"),
        ((F.col("c_custkey") % 11) / 2.0).alias("z"),
    )


def _register3(metric: str, dist: str, bound: float) -> None:
    @query(f"dist_{metric}", _pairs_sql(CUST3, dist, bound))
    def _(spark, folder):
        return _edges(_cust3(spark, folder), "c_custkey", ["x", "y", "z"], metric, bound)


_NORM = "sqrt({r}.x ** 2 + {r}.y ** 2 + {r}.z ** 2)"
_register3(
    "cosine",
    f"(1 - (a.x * b.x + a.y * b.y + a.z * b.z) / nullif({_NORM.format(r='a')} * {_NORM.format(r='b')}, 0))",
    0.0002,
)
_C = {r: {c: f"({r}.{c} - ({r}.x + {r}.y + {r}.z) / 3)" for c in "xyz"} for r in "ab"}
_CN = {r: "sqrt(" + " + ".join(f"{_C[r][c]} ** 2" for c in "xyz") + ")" for r in "ab"}
_register3(
    "correlation",
    "(1 - (" + " + ".join(f"{_C['a'][c]} * {_C['b'][c]}" for c in "xyz") + f") / nullif({_CN['a']} * {_CN['b']}, 0))",
    0.00001,
)
_register3(
    "braycurtis",
    "((abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z)) / nullif(abs(a.x + b.x) + abs(a.y + b.y) + abs(a.z + b.z), 0))",
    0.03,
)
_register3(
    "canberra",
    "(" + " + ".join(f"coalesce(abs(a.{c} - b.{c}) / nullif(abs(a.{c}) + abs(b.{c}), 0), 0)" for c in "xyz") + ")",
    0.1,
)

SHARES = "(SELECT id, x / (x + y + z) AS x, y / (x + y + z) AS y, z / (x + y + z) AS z FROM (SELECT c_custkey AS id, c_acctbal / 1000 + 1 AS x, CAST(c_nationkey AS DOUBLE) AS y, (c_custkey % 11) / 2.0::DOUBLE AS z FROM customer))"


def _half(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN {a} * ln({a} / (({a} + {b}) / 2)) ELSE 0 END"


@query(
    "dist_jensenshannon",
    _pairs_sql(
        SHARES,
        "sqrt(greatest(0, "
        + " + ".join(f"{_half(f'a.{c}', f'b.{c}')} + {_half(f'b.{c}', f'a.{c}')}" for c in "xyz")
        + ") / 2)",
        0.01,
    ),
)
def _(spark, folder):
    df = _cust3(spark, folder).withColumn("x", F.col("x") + 1)
    return _edges(df, "c_custkey", ["x", "y", "z"], "jensenshannon", 0.01)


# suppliers described by six codes, zeros included
SIX = "(SELECT s_suppkey AS id, " + ", ".join(
    f"CAST({e} AS DOUBLE) AS v{i}"
    for i, e in enumerate(
        (
            "s_nationkey % 5",
            "s_suppkey % 3",
            "s_suppkey % 7",
            "floor(s_acctbal / 2500)",
            "s_nationkey % 2",
            "s_suppkey % 4",
        )
    )
) + " FROM supplier)"


def _six(spark: SparkSession, folder: str) -> DataFrame:
    nation, key = F.col("s_nationkey"), F.col("s_suppkey")
    codes = (nation % 5, key % 3, key % 7, F.floor(F.col("s_acctbal") / 2500), nation % 2, key % 4)
    return table(spark, folder, "supplier").select(
        "s_suppkey", *(c.cast("double").alias(f"v{i}") for i, c in enumerate(codes))
    )


_I = range(6)
_DIFF = " + ".join(f"CASE WHEN a.v{i} <> b.v{i} THEN 1.0 ELSE 0.0 END" for i in _I)
_ANY = " + ".join(f"CASE WHEN a.v{i} <> 0 OR b.v{i} <> 0 THEN 1 ELSE 0 END" for i in _I)
_TT = "(" + " + ".join(f"CASE WHEN a.v{i} <> 0 AND b.v{i} <> 0 THEN 1 ELSE 0 END" for i in _I) + ")"
_TF = "(" + " + ".join(f"CASE WHEN a.v{i} <> 0 AND b.v{i} = 0 THEN 1 ELSE 0 END" for i in _I) + ")"
_FT = "(" + " + ".join(f"CASE WHEN a.v{i} = 0 AND b.v{i} <> 0 THEN 1 ELSE 0 END" for i in _I) + ")"
_U = f"({_TF} + {_FT})"
_FF = f"(6 - {_TT} - {_U})"


def _register6(metric: str, dist: str, bound: float) -> None:
    @query(f"dist_{metric}", _pairs_sql(SIX, f"CAST({dist} AS DOUBLE)", bound))
    def _(spark, folder):
        return _edges(_six(spark, folder), "s_suppkey", [f"v{i}" for i in _I], metric, bound)


_register6("hamming", f"(({_DIFF}) / 6)", 0.4)
_register6("jaccard", f"coalesce(({_DIFF}) / nullif({_ANY}, 0), 0)", 0.5)
_register6("jaccard_boolean", f"coalesce({_U} / nullif(1.0 * {_TT} + {_U}, 0), 0)", 0.4)
_register6("dice", f"({_U} / nullif(2.0 * {_TT} + {_U}, 0))", 0.2)
_register6("rogerstanimoto", f"(2.0 * {_U} / (6 + {_U}))", 0.4)
_register6("sokalsneath", f"(2.0 * {_U} / nullif({_TT} + 2 * {_U}, 0))", 0.4)
_register6("russellrao", f"((6.0 - {_TT}) / 6)", 0.3)
_register6(
    "yule",
    f"(CASE WHEN {_TF} * {_FT} = 0 THEN 0.0 ELSE 2.0 * {_TF} * {_FT} / ({_TT} * {_FF} + {_TF} * {_FT}) END)",
    0.2,
)


@query(
    "dist_threshold_inclusive",
    """SELECT a.s_suppkey AS source, b.s_suppkey AS target, round(abs(a.s_acctbal - b.s_acctbal), 5) AS dist
       FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 200""",
)
def _(spark, folder):
    return _edges(table(spark, folder, "supplier"), "s_suppkey", ["s_acctbal"], "cityblock", 200.0, inclusive=True)


# whole numbers, so that equal distances are equal in any engine
WHOLE = "(SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, round(p_retailprice * 10) AS y FROM part)"


@query(
    "dist_nearest_neighbours",
    f"""SELECT source, target, round(dist, 5) AS dist, rank FROM (SELECT source, target, dist,
        CAST(row_number() OVER (PARTITION BY source ORDER BY dist, target) AS INTEGER) AS rank
        FROM (SELECT a.id AS source, b.id AS target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
              FROM {WHOLE} a JOIN {WHOLE} b ON a.id <> b.id)) WHERE rank <= 3""",
)
def _(spark, folder):
    whole = table(spark, folder, "part").select("p_partkey", "p_size", F.round(F.col("p_retailprice") * 10).alias("price"))
    out = nearest_neighbours(whole, "p_partkey", ["p_size", "price"], 3)
    return out.withColumn("dist", F.round("dist", 5))


def _register_where(name: str, predicate: str, sql: str) -> None:
    @query(
        f"dist_where_{name}",
        f"""SELECT source, target, round(dist, 5) AS dist FROM (SELECT a.id AS source, b.id AS target,
            sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM {WHOLE} a JOIN {WHOLE} b ON a.id < b.id) WHERE {sql}""",
    )
    def _(spark, folder):
        whole = table(spark, folder, "part").select("p_partkey", "p_size", F.round(F.col("p_retailprice") * 10).alias("price"))
        return similarity_where(whole, "p_partkey", ["p_size", "price"], "euclidean", predicate).withColumn("dist", F.round("dist", 5))


_register_where("below", "dist<3", "dist < 3")
_register_where("between", "[dist] >= 2 and [dist] <= 4", "dist >= 2 AND dist <= 4")
_register_where("quoted", "5 > dist and dist > 1 and ‘a’ = 'a'", "dist < 5 AND dist > 1")


@query(
    "dist_exact_copies",
    """SELECT a.p_partkey AS source, b.p_partkey AS target, CAST(0 AS DOUBLE) AS dist FROM part a JOIN part b
       ON a.p_partkey < b.p_partkey AND a.p_size = b.p_size AND a.p_retailprice = b.p_retailprice""",
)
def _(spark, folder):
    """A bound of zero, taken inclusively, finds equal rows."""
    return similarity_edges(table(spark, folder, "part"), "p_partkey", ["p_size", "p_retailprice"], "euclidean", 0.0, inclusive=True)


# ---- sets ---------------------------------------------------------------------------

ORDER_SETS = "s AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey))) AS items FROM lineitem GROUP BY 1)"


def _order_sets(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("items"))


def _register_sets(name: str, measure: str, bound: float, similarity: str) -> None:
    sql = f"""WITH {ORDER_SETS}, e AS (SELECT id, items, len(items) AS n, unnest(items) AS item FROM s),
      met AS (SELECT a.id AS source, b.id AS target, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.item = b.item AND a.id < b.id GROUP BY ALL)
      SELECT source, target, round(1 - {similarity}, 6) AS dist FROM met WHERE 1 - {similarity} < {bound}"""

    @query(f"sets_{name}", sql)
    def _(spark, folder):
        found = set_edges(_order_sets(spark, folder), "l_orderkey", "items", bound, measure)
        return found.rows().withColumn("dist", F.round("dist", 6))


_register_sets("jaccard", "jaccard", 0.55, "c / (na + nb - c)::DOUBLE")
_register_sets("dice", "dice", 0.35, "2 * c / (na + nb)::DOUBLE")
_register_sets("cosine", "cosine", 0.35, "c / sqrt((na * nb)::DOUBLE)")


@query(
    "sets_classes",
    f"""WITH {ORDER_SETS} SELECT id, min(id) OVER (PARTITION BY items) AS class, len(items) AS size FROM s""",
)
def _(spark, folder):
    """Which orders hold the same parts: the membership behind the edges between classes."""
    return set_edges(_order_sets(spark, folder), "l_orderkey", "items", 0.5).members


@query(
    "sets_class_edges",
    f"""WITH {ORDER_SETS}, k AS (SELECT min(id) AS id, items, len(items) AS n FROM s GROUP BY items), e AS (SELECT id, n, unnest(items) AS item FROM k),
      met AS (SELECT a.id AS source, b.id AS target, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.item = b.item AND a.id < b.id GROUP BY ALL)
      SELECT source, target, round(1 - c / (na + nb - c)::DOUBLE, 6) AS dist FROM met WHERE 2 * c >= na + nb - c""",
)
def _(spark, folder):
    """Links between classes of equal part sets, the bound itself included."""
    found = set_edges(_order_sets(spark, folder), "l_orderkey", "items", 0.5, inclusive=True)
    return found.edges.withColumn("dist", F.round("dist", 6))


# ---- vectors --------------------------------------------------------------------------

VECTORS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"
_EUCLIDEAN = "list_distance(a.x, b.x)"
_COSINE = "(1 - list_cosine_similarity(a.x, b.x))"


def _register_nearest(name: str, metric: str, dist: str) -> None:
    sql = f"""WITH {VECTORS} SELECT source, target, round(dist, 6) AS dist, rank FROM (SELECT source, target, dist,
      CAST(row_number() OVER (PARTITION BY source ORDER BY dist, target) AS INTEGER) AS rank
      FROM (SELECT a.id AS source, b.id AS target, {dist} AS dist FROM v a JOIN v b ON a.id <> b.id)) WHERE rank <= 5"""

    @query(f"vectors_nearest_{name}", sql)
    def _(spark, folder):
        return nearest_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", 5, metric).withColumn("dist", F.round("dist", 6))


_register_nearest("euclidean", "euclidean", _EUCLIDEAN)
_register_nearest("cosine", "cosine", _COSINE)


def _register_vectors(name: str, metric: str, dist: str, bound: float) -> None:
    pairs = f"p AS (SELECT a.id AS source, b.id AS target, {dist} AS dist FROM v a JOIN v b ON a.id < b.id WHERE {dist} < {bound})"

    @query(f"vectors_{name}", f"WITH {VECTORS}, {pairs} SELECT source, target, round(dist, 6) AS dist FROM p")
    def _(spark, folder):
        joined = vector_join(table(spark, folder, "embeddings"), "vec_id", "embedding", bound, metric)
        return joined.edges().withColumn("dist", F.round("dist", 6))

    ends = "SELECT source AS id FROM p UNION ALL SELECT target FROM p"

    @query(f"vectors_links_{name}", f"WITH {VECTORS}, {pairs}, e AS ({ends}) SELECT v.id, count(e.id) AS n_links FROM v LEFT JOIN e ON v.id = e.id GROUP BY v.id")
    def _(spark, folder):
        return vector_join(table(spark, folder, "embeddings"), "vec_id", "embedding", bound, metric).link_counts()


_register_vectors("euclidean", "euclidean", _EUCLIDEAN, 1.05)
_register_vectors("cosine", "cosine", _COSINE, 0.55)
