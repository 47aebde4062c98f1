"""Cleaning steps and the fixed order in which a configuration runs them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.names import ROW_ID
from netloom.functions.quantiles import exact_quantiles
from netloom.functions.times import DAY, wall_micros
from netloom.runtime import cut, dense_index

BLOCK_ROWS = 1_000_000


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame, row_id: str = ROW_ID) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != row_id
    ]


def drop_duplicates(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Keep the first of rows equal in every column but the id.

    Grouping by the values with ``min(row_id)`` combines copies map-side, so a row
    repeated a billion times reaches the shuffle once per task.
    """
    values = [_col(c) for c in df.columns if c != row_id]
    return df.groupBy(*values).agg(F.min(row_id).alias(row_id)).select(*(_col(c) for c in df.columns))


def drop_missing(
    df: DataFrame, thresh: int | None = None, how: str = "any", row_id: str = ROW_ID
) -> DataFrame:
    """Drop rows with missing values, or with fewer than ``thresh`` present ones."""
    return df.na.drop(how=how, thresh=thresh, subset=[f"`{c}`" for c in df.columns if c != row_id])


def _value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    kind = df.schema[name].dataType
    return F.nanvl(_col(name), F.lit(None)) if isinstance(kind, (T.DoubleType, T.FloatType)) else _col(name)


def _gaps(df: DataFrame, names: Sequence[str], *more: Column):
    """One pass: the missing values of each column, as ``n0`` …, and further aggregates."""
    return df.agg(*(F.count_if(_value(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(names)), *more).first()


def _fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.select(
        *(
            F.coalesce(_value(df, c).cast("double"), F.lit(values[c])).alias(c) if c in values else _col(c)
            for c in df.columns
        )
    )


def fill_mean(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Missing numbers, NaN included, become the mean; columns without gaps keep their type."""
    names = numeric_columns(df, row_id)
    if not names:
        return df
    seen = _gaps(df, names, *(F.avg(_value(df, c)).alias(f"m{i}") for i, c in enumerate(names)))
    return _fill(df, {c: float(seen[f"m{i}"]) for i, c in enumerate(names) if seen[f"n{i}"] and seen[f"m{i}"] is not None})


def fill_median(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Missing numbers, NaN included, become the median; columns without gaps keep their type."""
    names = numeric_columns(df, row_id)
    if not names:
        return df
    seen = _gaps(df, names)
    open_ = [c for i, c in enumerate(names) if seen[f"n{i}"]]
    if not open_:
        return df
    medians = exact_quantiles(df, open_, [0.5]).collect()  # one row per column
    return _fill(df, {r["column"]: r["quantile"] for r in medians})


def fill_forward(df: DataFrame, row_id: str = ROW_ID, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Carry the last present value down in row order; leading gaps stay, NaN counts as missing.

    Rows are range-partitioned by id, however dense or sparse the ids are. Inside a range of about
    ``block_rows`` rows a window does the work; the value each range inherits comes from a
    running ``last`` over one row per range.
    """
    names = [c for c in df.columns if c != row_id]
    df = df.select(*(_col(c) if c == row_id else _value(df, c).alias(c) for c in df.columns))
    # range bounds are sampled, so the ranges are written out once
    ranges = max(1, math.ceil(df.count() / block_rows))
    blocked = cut(df.repartitionByRange(ranges, _col(row_id)).withColumn("_block", F.spark_partition_id()))
    ends = blocked.groupBy("_block").agg(
        *(F.max_by(_col(c), F.when(_col(c).isNotNull(), _col(row_id))).alias(c) for c in names)
    )
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "_block", *(F.last(_col(c), ignorenulls=True).over(ahead).alias(f"_in_{i}") for i, c in enumerate(names))
    )
    inside = Window.partitionBy("_block").orderBy(row_id).rowsBetween(Window.unboundedPreceding, 0)
    filled = blocked.select(
        "_block",
        _col(row_id),
        *(F.last(_col(c), ignorenulls=True).over(inside).alias(c) for c in names),
    ).join(carried, "_block")
    return filled.select(
        *(
            _col(c) if c == row_id else F.coalesce(_col(c), F.col(f"_in_{names.index(c)}")).alias(c)
            for c in df.columns
        )
    )


def drop_outliers(df: DataFrame, columns: Sequence[str], sigmas: float = 3.0) -> DataFrame:
    """Per column in turn: keep rows within ``sigmas`` sample deviations of the mean.

    Statistics are taken again after each column. A missing value, or a column without
    spread, keeps no row.
    """
    for name in columns:
        stats = df.agg(F.avg(_col(name)).alias("m"), F.stddev_samp(_col(name)).alias("s")).first()
        if stats["m"] is None or not stats["s"]:
            df = df.where(F.lit(False))
            continue
        df = df.where(F.abs((_col(name) - stats["m"]) / stats["s"]) <= sigmas)
    return df


def _rescaled(df: DataFrame, columns: Sequence[str], shift: dict, spread: dict) -> DataFrame:
    def one(c: str) -> Column:
        if c not in columns or shift[c] is None:
            return _col(c)
        return ((_col(c) - F.lit(float(shift[c]))) / F.lit(float(spread[c] or 1.0))).alias(c)

    return df.select(*(one(c) for c in df.columns))


def scale_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x − min) / (max − min); a constant column becomes 0."""
    aggs = [f(_col(c)).alias(f"{t}{i}") for i, c in enumerate(columns) for t, f in (("a", F.min), ("b", F.max))]
    if not aggs:
        return df
    row = df.agg(*aggs).first()
    low = {c: row[f"a{i}"] for i, c in enumerate(columns)}
    spread = {c: (row[f"b{i}"] or 0) - (row[f"a{i}"] or 0) for i, c in enumerate(columns)}
    return _rescaled(df, columns, low, spread)


def scale_z(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x − mean) / population deviation; a constant column becomes 0."""
    aggs = [
        f(_col(c)).alias(f"{t}{i}") for i, c in enumerate(columns) for t, f in (("a", F.avg), ("b", F.stddev_pop))
    ]
    if not aggs:
        return df
    row = df.agg(*aggs).first()
    return _rescaled(
        df, columns, {c: row[f"a{i}"] for i, c in enumerate(columns)}, {c: row[f"b{i}"] for i, c in enumerate(columns)}
    )


def one_hot(df: DataFrame, columns: Sequence[str], max_values: int | None = None) -> DataFrame:
    """Replace each column by sorted ``column_value`` 0/1 columns at the end.

    The values become column names, so they must reach the driver; one job finds those of all columns.
    Where a column has too many values for that, ``one_hot_long`` gives the same facts as rows; ``max_values``
    lets a caller refuse such a column before its values are fetched.
    """
    if not columns:
        return df
    if max_values is not None:
        counts = df.agg(*(F.count_distinct(_col(c)).alias(f"n{i}") for i, c in enumerate(columns))).first()
        for i, name in enumerate(columns):
            if counts[f"n{i}"] > max_values:
                raise ValueError(f"{name} has more than {max_values} values; one-hot would add as many columns")
    sets = df.agg(*(F.collect_set(_col(c)).alias(f"v{i}") for i, c in enumerate(columns))).first()
    encoded = [
        F.when(_col(name) == F.lit(v), 1).otherwise(0).alias(f"{name}_{v}")
        for i, name in enumerate(columns)
        for v in sorted(sets[f"v{i}"])
    ]
    return df.select(*(_col(c) for c in df.columns if c not in columns), *encoded)


def one_hot_long(df: DataFrame, columns: Sequence[str], row_id: str = ROW_ID) -> DataFrame:
    """``(row_id, column, value)``: the ones of ``one_hot`` as rows, for any number of values."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _col(c).cast("string").alias("value")) for c in columns)))
    return df.select(_col(row_id).alias(row_id), cells.alias("_cell")).select(row_id, "_cell.*").where("value is not null")


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by the 0-based rank of its value among the sorted distinct ones."""
    for name in columns:
        codes = dense_index(df.select(_col(name).alias("_v")).where("_v is not null").distinct(), "_code", "_v")
        order = df.columns
        df = (
            df.join(codes, _col(name) == F.col("_v"), "left")
            .select(*(F.col("_code").alias(c) if c == name else _col(c) for c in order))
        )
    return df


def elapsed(
    df: DataFrame, columns: Sequence[str], date: str, unit: str = "days", total: bool = False
) -> DataFrame:
    """Time from each value to ``date``: whole days (floored), or seconds.

    Seconds are the part within the day (0 … 86399) unless ``total`` is set. Times are wall-clock
    times: a clock change between the two adds or takes no hour.
    """

    until = wall_micros(F.lit(date))

    def one(name: str) -> Column:
        gap = until - wall_micros(_col(name).cast("string"))
        seconds = F.floor(gap / F.lit(1_000_000))
        if unit == "days":
            return F.floor(gap / F.lit(DAY))
        return seconds if total else F.pmod(seconds, F.lit(86_400))

    return df.select(*(one(c).alias(c) if c in columns else _col(c) for c in df.columns))


@dataclass(frozen=True)
class CleaningPlan:
    """What to run; the order is always duplicates, outliers, one-hot, labels, dates, gaps, scaling."""

    drop_duplicates: bool = False
    outlier_columns: Sequence[str] = ()
    one_hot_columns: Sequence[str] = ()
    label_columns: Sequence[str] = ()
    date_columns: Sequence[str] = ()
    date: str | None = None
    date_unit: str = "days"
    missing: str = "keep"  # keep | drop | mean | median | forward
    missing_thresh: int | None = None
    scaling: str = "none"  # none | min_max | z
    scaling_columns: Sequence[str] = field(default=())


def clean(df: DataFrame, plan: CleaningPlan, row_id: str = ROW_ID) -> DataFrame:
    if plan.drop_duplicates:
        df = drop_duplicates(df, row_id)
        if plan.outlier_columns:
            df = cut(df)  # each outlier column takes statistics of the rows left
    df = drop_outliers(df, plan.outlier_columns)
    if plan.drop_duplicates or plan.outlier_columns:
        df = cut(df)  # the steps below read their input for values, means and scales
    if plan.one_hot_columns:
        df = one_hot(df, plan.one_hot_columns)
    if plan.label_columns:
        df = label_encode(df, plan.label_columns)
    if plan.date_columns:
        df = elapsed(df, plan.date_columns, plan.date, plan.date_unit)
    if plan.missing == "drop":
        df = drop_missing(df, plan.missing_thresh, row_id=row_id)
    elif plan.missing in ("mean", "median", "forward"):
        df = {"mean": fill_mean, "median": fill_median, "forward": fill_forward}[plan.missing](df, row_id)
    if plan.scaling == "min_max":
        df = scale_min_max(df, plan.scaling_columns)
    elif plan.scaling == "z":
        df = scale_z(df, plan.scaling_columns)
    return df
