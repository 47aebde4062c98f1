"""Row filters and SQL over the named tables of a session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.names import ROW_ID, backtick_brackets, straight_quotes


def project(df: DataFrame, columns: Sequence[str], row_id: str = ROW_ID) -> DataFrame:
    """Row id plus the chosen columns."""
    return df.select(row_id, *(F.col(f"`{c}`") for c in columns))


def where(df: DataFrame, predicate: str | None) -> DataFrame:
    """Keep rows matching a SQL predicate; quotes and bracketed names are normalised."""
    if not predicate or not predicate.strip():
        return df
    return df.where(F.expr(backtick_brackets(straight_quotes(predicate))))


def rows_behind(data: DataFrame, kept: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Original rows whose id survived a filter."""
    return data.join(kept.select(row_id), row_id, "left_semi")


def query(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Any ``SELECT`` over the named tables; views exist only while the text is analysed.

    A temporary view of the caller that bears one of the names is there again afterwards.
    """
    own = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    hidden = {name: spark.table(name) for name in tables if name in own}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(backtick_brackets(text.strip().rstrip(";")))
    finally:
        for name in tables:
            if name in hidden:
                hidden[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
