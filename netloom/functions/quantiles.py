"""Exact quantiles that never gather a column into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.runtime import running_total


def melt(df: DataFrame, columns: Sequence[str], dtype: str) -> DataFrame:
    """One row per (column, value); nulls kept."""
    return df.select(
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(dtype).alias("value"))
                    for c in columns
                )
            )
        ).alias("cell")
    ).select("cell.column", "cell.value")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, prob, quantile) by linear interpolation between the two nearest ranks.

    Equal values are counted first (combined map-side), so a column holding one value in a
    third of its rows costs one row; ranks come from a two-level prefix sum.
    """
    counts = (
        melt(df, columns, "double")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_total(counts, "value", "n", "column")
    sizes = ranked.groupBy("column").agg(F.max("upto").alias("size"))
    wanted = (
        sizes.withColumn("prob", F.explode(F.array(*(F.lit(float(p)) for p in probs))))
        .withColumn("pos", F.col("prob") * (F.col("size") - 1))
        .withColumn("lo", F.floor("pos"))
        .withColumn("hi", F.ceil("pos"))
    )
    hits = ranked.join(F.broadcast(wanted), "column").where(  # len(columns) x len(probs) rows
        ((F.col("before") <= F.col("lo")) & (F.col("lo") < F.col("upto")))
        | ((F.col("before") <= F.col("hi")) & (F.col("hi") < F.col("upto")))
    )
    low = F.min("value")
    return hits.groupBy("column", "prob").agg(
        (low + (F.max("value") - low) * F.max(F.col("pos") - F.col("lo"))).alias("quantile")
    )
