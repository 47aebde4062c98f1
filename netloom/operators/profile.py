"""Column profiles as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.quantiles import exact_quantiles, melt
from netloom.operators.clean import numeric_columns


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and their share, and column counts by kind: one row, one pass."""
    kinds = [f.dataType for f in df.schema.fields]
    numeric = sum(isinstance(k, T.NumericType) for k in kinds)
    text = sum(isinstance(k, T.StringType) for k in kinds)
    width = len(kinds)
    present = sum((F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), present.alias("present")).select(
        "n_rows",
        F.lit(width).cast("bigint").alias("n_columns"),
        (F.col("n_rows") * width - F.col("present")).alias("missing_cells"),
        F.try_divide(F.col("n_rows") * width - F.col("present"), F.col("n_rows") * width).alias("missing_share"),
        F.lit(numeric).cast("bigint").alias("numeric_columns"),
        F.lit(text).cast("bigint").alias("text_columns"),
        F.lit(width - numeric - text).cast("bigint").alias("other_columns"),
    )


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return melt(df, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: present, missing, distinct, values seen once, distinct share.

    All columns share one shuffle of (column, value) counts; ``approximate`` replaces it
    by sketches in a single pass (values seen once are then unknown).
    """
    columns = list(columns or df.columns)
    if approximate:
        counted = melt(df, columns, "string").groupBy("column").agg(
            F.count("value").alias("present"),
            F.count_if(F.col("value").isNull()).alias("missing"),
            F.approx_count_distinct("value").alias("n_distinct"),
            F.lit(None).cast("bigint").alias("n_once"),
        )
    else:
        known = F.col("value").isNotNull()
        counted = _value_counts(df, columns).groupBy("column").agg(
            F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("present"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
            F.count_if(known).alias("n_distinct"),
            F.count_if(known & (F.col("n") == 1)).alias("n_once"),
        )
    return counted.withColumn("distinct_share", F.try_divide(F.col("n_distinct"), F.col("present")))


MOMENTS = ("n", "mean", "std", "variance", "min", "max", "total", "zeros", "negatives", "g1", "g2")


def _moments(value: Column, i: int) -> list[Column]:
    """All moments of one column as aggregates of one pass over the table."""
    found = (
        F.count(value), F.avg(value), F.stddev_samp(value), F.var_samp(value), F.min(value), F.max(value), F.sum(value), F.count_if(value == 0),
        F.count_if(value < 0), F.skewness(value), F.kurtosis(value),
    )
    return [column.alias(f"{name}_{i}") for name, column in zip(MOMENTS, found, strict=True)]


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Moments, extremes, zero and negative counts per numeric column, in two scans.

    Skewness and kurtosis carry the small-sample correction; ``mad`` is the median
    absolute deviation from the median.
    """
    columns = list(columns or numeric_columns(df))
    if not columns:
        raise ValueError("a numeric summary needs a numeric column")
    wide = [_moments(F.col(f"`{c}`").cast("double"), i) for i, c in enumerate(columns)]
    once = df.agg(*[m for each in wide for m in each])
    named = [F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in MOMENTS]) for i, c in enumerate(columns)]
    moments = once.select(F.inline(F.array(*named))).where("n > 0")
    n = F.col("n").cast("double")
    medians = exact_quantiles(df, columns, [0.5])
    centre = {r["column"]: r["quantile"] for r in medians.collect()}  # one row per column
    spread = df.select(
        *(F.abs(F.col(f"`{c}`") - F.lit(centre.get(c))).alias(c) for c in columns)
    )
    mad = exact_quantiles(spread, columns, [0.5]).select("column", F.col("quantile").alias("mad"))
    return (
        moments.join(F.broadcast(mad), "column", "left")  # one row per column
        .select(
            "column",
            "n",
            "mean",
            "std",
            "variance",
            "min",
            "max",
            (F.col("max") - F.col("min")).alias("range"),
            "total",
            "zeros",
            "negatives",
            F.try_divide(F.col("std"), F.col("mean")).alias("cv"),
            F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
            F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
            "mad",
        )
    )


# The quantiles a profile reports.
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def quantile_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """p5, p25, p50, p75, p95 and the interquartile range per numeric column, exact."""
    columns = list(columns or numeric_columns(df))
    wide = (
        exact_quantiles(df, columns, QUANTILES)
        .groupBy("column")
        .pivot("prob", list(QUANTILES))
        .agg(F.first("quantile"))
        .toDF("column", "p5", "p25", "p50", "p75", "p95")
    )
    return wide.withColumn("iqr", F.col("p75") - F.col("p25"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, lower, upper, n) with equal-width bins; the maximum belongs to the last bin."""
    value = F.col(f"`{column}`").cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n bigint")
    width = (high - low) / bins
    index = F.least(F.floor((value - low) / width), F.lit(bins - 1)) if width else F.lit(0)
    return (
        df.where(value.isNotNull())
        .groupBy(index.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (low + F.col("bin") * width).alias("lower"), (low + (F.col("bin") + 1) * width).alias("upper"), "n")
    )


def frequent_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        _value_counts(df, columns)
        .where("value is not null")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def text_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (
        melt(df, columns, "string")
        .groupBy("column")
        .agg(
            F.min(F.length("value")).alias("min_length"),
            F.avg(F.length("value")).alias("mean_length"),
            F.max(F.length("value")).alias("max_length"),
        )
    )
