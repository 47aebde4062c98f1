"""Queries over tables: reading, filtering, cleaning, profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.names import ROW_ID
from netloom.operators import clean as cl
from netloom.operators import profile as pr
from netloom.operators import rows as sq
from netloom.plans.registry import query, table
from netloom.runtime import scratch_path, setting
from netloom.sources import tables as io


def _as_csv(spark: SparkSession, folder: str, name: str, encoding: str = "utf-8") -> str:
    path = scratch_path(spark, f"{name}.csv")
    df = table(spark, folder, name)
    with setting(spark, io.JAVA_CHARSETS, "true"):
        df.write.option("header", True).option("encoding", encoding).option("escape", '"').csv(path)
    return path


def _numbered(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    return table(spark, folder, name).withColumn(ROW_ID, F.col(key).cast("bigint"))


@query(
    "io_read_delimited",
    "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
)
def _(spark, folder):
    return io.read_delimited(spark, _as_csv(spark, folder, "part"))


@query("io_read_gbk", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, folder):
    return io.read_delimited(spark, _as_csv(spark, folder, "customer", "GBK"), encoding="GBK")


@query(
    "io_row_id",
    'SELECT (row_number() OVER () - 1) AS row_id, l_orderkey, l_partkey, l_linenumber FROM lineitem',
)
def _(spark, folder):
    return io.add_row_id(table(spark, folder, "lineitem").select("*", "_metadata")).select(
        ROW_ID, "l_orderkey", "l_partkey", "l_linenumber"
    )


@query(
    "io_clean_names",
    'SELECT row_number() OVER () - 1 AS row_id, s_suppkey AS "s-suppkey", s_name AS "s-name", '
    'CAST(s_nationkey AS BIGINT) AS "s-nationkey", s_acctbal AS "s-acctbal" FROM supplier',
)
def _(spark, folder):
    return io.load_table(spark, _as_csv(spark, folder, "supplier"))


@query(
    "io_preview_typed",
    'SELECT o_orderkey AS "o_orderkey$int64", o_custkey AS "o_custkey$int64", o_orderstatus AS "o_orderstatus$object", '
    'o_totalprice AS "o_totalprice$float64" FROM orders ORDER BY o_orderkey LIMIT 1000',
)
def _(spark, folder):
    df = _numbered(spark, folder, "orders", "o_orderkey")
    return io.preview(
        df.select(ROW_ID, "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), 1000, tagged=True
    )


@query("io_export_csv", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def _(spark, folder):
    path = scratch_path(spark, "export.csv")
    io.write_csv(table(spark, folder, "supplier"), path)
    return io.read_delimited(spark, path)


@query(
    "sql_over_session_tables",
    """SELECT p.p_brand AS brand, count(*) AS n, round(sum(p.p_retailprice), 2) AS total_price
       FROM part p JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) l ON p.p_partkey = l.l_partkey
       WHERE p.p_size BETWEEN 5 AND 40 GROUP BY p.p_brand HAVING count(*) > 3""",
)
def _(spark, folder):
    return sq.query(
        spark,
        """SELECT p.[p_brand] AS brand, count(*) AS n, round(sum(p.[p_retailprice]), 2) AS total_price
           FROM data p JOIN (SELECT DISTINCT [l_partkey] FROM processed_data WHERE l_quantity > 45) l
             ON p.p_partkey = l.l_partkey
           WHERE p.p_size BETWEEN 5 AND 40 GROUP BY p.[p_brand] HAVING count(*) > 3;""",
        {"data": table(spark, folder, "part"), "processed_data": table(spark, folder, "lineitem")},
    )


@query("sql_project_key", "SELECT p_partkey AS row_id, p_size, p_retailprice FROM part")
def _(spark, folder):
    return sq.project(_numbered(spark, folder, "part", "p_partkey"), ["p_size", "p_retailprice"])


@query(
    "sql_where_quotes",
    "SELECT p_partkey, p_type, p_size FROM part WHERE p_type = 'ECONOMY' AND p_size > 10",
)
def _(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    return sq.where(df, "[p_type] = “ECONOMY” and [p_size] > 10")


@query(
    "sql_bracket_names",
    "SELECT s_nationkey AS nation, count(*) AS n FROM supplier WHERE s_name <> 'a [b] c' GROUP BY s_nationkey",
)
def _(spark, folder):
    df = table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "s-nationkey")
    return sq.query(
        spark,
        "select [s-nationkey] as nation, count(*) as n from data where s_name <> 'a [b] c' group by [s-nationkey]",
        {"data": df},
    )


@query(
    "sql_rows_behind_filter",
    "SELECT c_custkey AS row_id, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal < 0",
)
def _(spark, folder):
    data = _numbered(spark, folder, "customer", "c_custkey").select(ROW_ID, "c_name", "c_mktsegment", "c_acctbal")
    kept = sq.where(sq.project(data, ["c_acctbal"]), "[c_acctbal] < 0")
    return sq.rows_behind(data, kept)


def _gappy(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with balances and nations missing by rule."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.cast("bigint").alias(ROW_ID),
        F.when(key % 7 != 0, F.col("c_acctbal")).alias("bal"),
        F.when(key % 5 != 0, F.col("c_nationkey")).alias("nat"),
        F.when(key % 3 != 0, F.col("c_mktsegment")).alias("seg"),
    )


GAPPY = """(SELECT c_custkey AS row_id, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal,
   CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nat,
   CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS seg FROM customer)"""


@query(
    "clean_drop_duplicates",
    "SELECT min(c_custkey) AS row_id, c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment",
)
def _(spark, folder):
    df = _numbered(spark, folder, "customer", "c_custkey").select(ROW_ID, "c_nationkey", "c_mktsegment")
    return cl.drop_duplicates(df)


@query("clean_drop_missing", f"SELECT * FROM {GAPPY} WHERE bal IS NOT NULL AND nat IS NOT NULL AND seg IS NOT NULL")
def _(spark, folder):
    return cl.drop_missing(_gappy(spark, folder))


@query(
    "clean_drop_missing_thresh",
    f"""SELECT * FROM {GAPPY} WHERE (CASE WHEN bal IS NULL THEN 0 ELSE 1 END + CASE WHEN nat IS NULL THEN 0 ELSE 1 END
        + CASE WHEN seg IS NULL THEN 0 ELSE 1 END) >= 2""",
)
def _(spark, folder):
    return cl.drop_missing(_gappy(spark, folder), thresh=2)


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns))


@query(
    "clean_fill_mean",
    f"""SELECT row_id, round(coalesce(bal, (SELECT avg(bal) FROM {GAPPY})), 4) AS bal,
        round(coalesce(nat, (SELECT avg(nat) FROM {GAPPY})), 4) AS nat, seg FROM {GAPPY}""",
)
def _(spark, folder):
    return _rounded(cl.fill_mean(_gappy(spark, folder)), "bal", "nat")


@query(
    "clean_fill_median",
    f"""SELECT row_id, round(coalesce(bal, (SELECT median(bal) FROM {GAPPY})), 4) AS bal,
        round(coalesce(nat, (SELECT median(nat) FROM {GAPPY})), 4) AS nat, seg FROM {GAPPY}""",
)
def _(spark, folder):
    return _rounded(cl.fill_median(_gappy(spark, folder)), "bal", "nat")


@query(
    "clean_fill_forward",
    f"""SELECT row_id, last_value(bal IGNORE NULLS) OVER w AS bal, last_value(nat IGNORE NULLS) OVER w AS nat,
        last_value(seg IGNORE NULLS) OVER w AS seg FROM {GAPPY}
        WINDOW w AS (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(spark, folder):
    return cl.fill_forward(_gappy(spark, folder))


@query(
    "clean_drop_outliers",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem),
       s1 AS (SELECT avg(l_extendedprice) m, stddev_samp(l_extendedprice) s FROM a),
       b AS (SELECT a.* FROM a, s1 WHERE abs((l_extendedprice - m) / s) <= 1.5),
       s2 AS (SELECT avg(l_quantity) m, stddev_samp(l_quantity) s FROM b)
       SELECT b.* FROM b, s2 WHERE abs((l_quantity - m) / s) <= 1.5""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return cl.drop_outliers(df, ["l_extendedprice", "l_quantity"], sigmas=1.5)


@query(
    "clean_three_sigma",
    """WITH s AS (SELECT avg(o_totalprice) m, stddev_samp(o_totalprice) s FROM orders)
       SELECT o_orderkey, o_totalprice FROM orders, s WHERE abs((o_totalprice - m) / s) <= 3""",
)
def _(spark, folder):
    return cl.drop_outliers(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@query(
    "clean_scale_min_max",
    """SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part)) / ((SELECT max(p_size) - min(p_size) FROM part) + 0.0), 5) AS p_size,
       round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 5) AS p_retailprice
       FROM part""",
)
def _(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return _rounded(cl.scale_min_max(df, ["p_size", "p_retailprice"]), "p_size", "p_retailprice", digits=5)


@query(
    "clean_scale_z",
    """SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 5) AS p_size,
       round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 5) AS p_retailprice
       FROM part""",
)
def _(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return _rounded(cl.scale_z(df, ["p_size", "p_retailprice"]), "p_size", "p_retailprice", digits=5)


@query(
    "clean_one_hot",
    """SELECT l_orderkey, l_linenumber, """
    + ", ".join(f"CAST(l_returnflag = '{v}' AS INTEGER) AS l_returnflag_{v}" for v in "ANR")
    + ", "
    + ", ".join(f"CAST(l_linestatus = '{v}' AS INTEGER) AS l_linestatus_{v}" for v in "FO")
    + " FROM lineitem",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return cl.one_hot(df, ["l_returnflag", "l_linestatus"])


@query(
    "clean_label_encode",
    """SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand,
       dense_rank() OVER (ORDER BY p_type) - 1 AS p_type FROM part""",
)
def _(spark, folder):
    return cl.label_encode(table(spark, folder, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])


@query(
    "clean_elapsed_days",
    """SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '1999-06-30 12:00:00') - epoch_us(o_orderdate)) / 86400000000) AS BIGINT)
       AS o_orderdate FROM orders""",
)
def _(spark, folder):
    return cl.elapsed(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"], "1999-06-30 12:00:00")


@query(
    "clean_elapsed_seconds",
    """SELECT event_id, CAST(((s % 86400) + 86400) % 86400 AS BIGINT) AS ts FROM
       (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-15 06:30:00') - epoch_us(ts)) / 1000000) AS BIGINT) AS s FROM events)""",
)
def _(spark, folder):
    return cl.elapsed(table(spark, folder, "events").select("event_id", "ts"), ["ts"], "2024-01-15 06:30:00", unit="seconds")


@query(
    "clean_all_steps",
    f"""WITH a AS (SELECT min(row_id) AS row_id, bal, nat, seg FROM {GAPPY} GROUP BY bal, nat, seg),
        s AS (SELECT avg(bal) m, stddev_samp(bal) s FROM a),
        b AS (SELECT a.* FROM a, s WHERE abs((bal - m) / s) <= 3),
        f AS (SELECT row_id, bal, coalesce(nat, (SELECT avg(nat) FROM b)) AS nat, seg FROM b)
        SELECT row_id, round((bal - (SELECT avg(bal) FROM f)) / (SELECT stddev_pop(bal) FROM f), 5) AS bal, round(nat, 5) AS nat,
        """
    + ", ".join(
        f"CASE WHEN seg = '{v}' THEN 1 ELSE 0 END AS seg_{v}"
        for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM f",
)
def _(spark, folder):
    plan = cl.CleaningPlan(
        drop_duplicates=True,
        outlier_columns=["bal"],
        one_hot_columns=["seg"],
        missing="mean",
        scaling="z",
        scaling_columns=["bal"],
    )
    return _rounded(cl.clean(_gappy(spark, folder), plan), "bal", "nat", digits=5)


@query(
    "profile_overview",
    f"""SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_columns, count(*) * 4 - count(row_id) - count(bal) - count(nat) - count(seg) AS missing_cells,
        round((count(*) * 4 - count(row_id) - count(bal) - count(nat) - count(seg)) / (count(*) * 4), 6) AS missing_share,
        CAST(3 AS BIGINT) AS numeric_columns, CAST(1 AS BIGINT) AS text_columns, CAST(0 AS BIGINT) AS other_columns FROM {GAPPY}""",
)
def _(spark, folder):
    return _rounded(pr.overview(_gappy(spark, folder)), "missing_share", digits=6)


def _each(columns: dict[str, str], body: str) -> str:
    return " UNION ALL ".join(body.format(c=c, t=t) for c, t in columns.items())


@query(
    "profile_column_counts",
    _each(
        {"l_partkey": "lineitem", "l_quantity": "lineitem", "l_returnflag": "lineitem"},
        """SELECT '{c}' AS "column", count({c}) AS present, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct,
           (SELECT count(*) FROM (SELECT {c} FROM {t} GROUP BY {c} HAVING count(*) = 1)) AS n_once,
           round(count(DISTINCT {c}) / count({c}), 6) AS distinct_share FROM {t}""",
    ),
)
def _(spark, folder):
    df = pr.column_counts(table(spark, folder, "lineitem"), ["l_partkey", "l_quantity", "l_returnflag"])
    return _rounded(df, "distinct_share", digits=6)


@query(
    "profile_numeric",
    _each(
        {"l_quantity": "lineitem", "l_discount": "lineitem", "l_linenumber": "lineitem"},
        """SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
           round(var_samp({c}), 4) AS variance, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, (max({c}) - min({c}))::DOUBLE AS range,
           round(sum({c})::DOUBLE, 2) AS total, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives,
           round(stddev_samp({c}) / avg({c}), 4) AS cv, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
           round(mad({c})::DOUBLE, 4) AS mad FROM {t}""",
    ),
)
def _(spark, folder):
    df = pr.numeric_summary(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])
    return _rounded(
        _rounded(df, "total", digits=2), "mean", "std", "variance", "cv", "skewness", "kurtosis", "mad"
    )


@query(
    "profile_quantiles",
    _each(
        {"o_totalprice": "orders", "o_custkey": "orders"},
        """SELECT '{c}' AS "column", round(p5, 3) AS p5, round(p25, 3) AS p25, round(p50, 3) AS p50, round(p75, 3) AS p75,
           round(p95, 3) AS p95, round(p75 - p25, 3) AS iqr FROM (SELECT quantile_cont({c}::DOUBLE, 0.05) p5, quantile_cont({c}::DOUBLE, 0.25) p25,
           quantile_cont({c}::DOUBLE, 0.5) p50, quantile_cont({c}::DOUBLE, 0.75) p75, quantile_cont({c}::DOUBLE, 0.95) p95 FROM {t})""",
    ),
)
def _(spark, folder):
    df = pr.quantile_table(table(spark, folder, "orders"), ["o_totalprice", "o_custkey"])
    return _rounded(df, "p5", "p25", "p50", "p75", "p95", "iqr", digits=3)


@query(
    "profile_histogram",
    """WITH s AS (SELECT min(value) lo, max(value) hi FROM events),
       b AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 12)), 11) AS INTEGER) AS bin FROM events, s)
       SELECT bin, round(any_value(lo + bin * (hi - lo) / 12), 4) AS lower, round(any_value(lo + (bin + 1) * (hi - lo) / 12), 4) AS upper,
       count(*) AS n FROM b, s GROUP BY bin""",
)
def _(spark, folder):
    return _rounded(pr.histogram(table(spark, folder, "events"), "value", 12), "lower", "upper")


@query(
    "profile_frequent_values",
    """SELECT * FROM (""" + _each(
        {"p_brand": "part", "p_type": "part"},
        """SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
           CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM {t} GROUP BY {c}""",
    ) + ") WHERE rank <= 5",
)
def _(spark, folder):
    return pr.frequent_values(table(spark, folder, "part"), ["p_brand", "p_type"], 5)


@query(
    "profile_text_lengths",
    _each(
        {"text": "documents", "lang": "documents"},
        """SELECT '{c}' AS "column", CAST(min(length({c})) AS INTEGER) AS min_length, round(avg(length({c})), 4) AS mean_length,
           CAST(max(length({c})) AS INTEGER) AS max_length FROM {t}""",
    ),
)
def _(spark, folder):
    return _rounded(pr.text_lengths(table(spark, folder, "documents"), ["text", "lang"]), "mean_length")
