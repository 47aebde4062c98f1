"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.plans.registry import table  # noqa: F401
from netloom.runtime import cut, scratch_path, setting  # noqa: F401

#: A key counts as hot from this share of all rows on, so there are at most this many hot keys.
HOT_KEYS = 1000

#: Words are runs of anything but the six ASCII white-space characters.
SPACES = r"[ \t-\r]+"


#: Bytes of an Arrow batch where rows are whole texts: a batch stands in a task several times, in both processes.
BATCH_BYTES = 4 << 20


def cut_in_small_batches(df: DataFrame) -> DataFrame:
    """As ``cut``; Python sees batches of about ``BATCH_BYTES`` instead of 10,000 rows of any size."""
    with setting(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        return cut(df)


def words_of(text: str | Column) -> Column:
    """Words of ``text``; null gives an empty list."""
    column = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(column, F.lit("")), SPACES), "")


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """A new schema with further fields."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, weight: str) -> DataFrame:
    """Join every row with the one ``lookup`` row of its key, whatever share of the rows a key has.

    ``weight`` is the number of rows of a key. Keys with a thousandth of all rows or more are at
    most ``HOT_KEYS``, so they are broadcast; the rest meets in an ordinary join, where no
    key can fill a task. Both inputs are read more than once and should be written tables.
    """
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_KEYS >= total
    hot, cold = lookup.where(is_hot), lookup.where(~is_hot)
    often = rows.join(F.broadcast(hot), key)
    seldom = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return often.unionByName(seldom)
