"""Session helpers shared by every operator that runs more than one Spark job."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = 500_000
#: Shuffle files go as soon as the job that made them is over, not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "netloom", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or reuse) a session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a missing
    setting is an error, because a machine-local folder does not survive an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="run-")
    context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from the files.

    The lineage ends there, any executor can read it, and the planner sees the real size; a
    checkpointed frame would keep its plan's size estimate, which multiplies at every
    join and grows without bound in a loop.
    """
    path = scratch_path(df.sparkSession, "state")
    with setting(df.sparkSession, TIDY, "true"):  # what is written needs no shuffle any more
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as the block runs; jobs that need it must end inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Shuffle width for ``rows`` rows: never below one wave of cores, then by size."""
    floor = min(8, spark.sparkContext.defaultParallelism)
    return max(floor, math.ceil(rows / rows_per_task))


@contextmanager
def shuffle_width(spark: SparkSession, rows: int) -> Iterator[int]:
    """Settings for a loop over ``rows`` rows; the caller's are restored afterwards.

    Shuffles are sized to the data.
    """
    width = tasks_for(spark, rows)
    wanted = {"spark.sql.shuffle.partitions": str(width)}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield width
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def dense_index(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Number the rows 0, 1, 2 … in ``order`` without funnelling them through one task.

    Rows are range-partitioned and sorted; the position inside each range is written out
    once (range bounds are sampled, so a second evaluation could differ) and shifted by
    the row counts of the ranges before it — one small row per range.
    """
    spark = df.sparkSession
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    counts = placed.groupBy("_range").count().collect()  # one row per range
    return _shift(spark, placed, counts).select(
        (F.col("_pos") + F.col("_before")).alias(name), *df.columns
    )


def _shift(spark: SparkSession, placed: DataFrame, counts: list) -> DataFrame:
    offsets, before = [], 0
    for row in sorted(counts, key=lambda r: r["_range"]):
        offsets.append((row["_range"], before))
        before += row["count"]
    table = spark.createDataFrame(offsets, "_range int, _before long")
    return placed.join(table, "_range")


def running_total(df: DataFrame, value: str, weight: str, *within: str) -> DataFrame:
    """Add ``before`` and ``upto``: sums of ``weight`` over smaller and up-to-equal values.

    The two-level prefix sum behind exact quantiles. Ranges of the sorted values hold a
    bounded number of rows each; only one total per range and group is summed globally.
    """
    from pyspark.sql import Window

    keys = list(within)
    placed = cut(
        df.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id())
    )
    totals = placed.groupBy(*keys, "_range").agg(F.sum(weight).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    return (
        placed.withColumn("_upto", F.sum(weight).over(inside))
        .join(offsets, [*keys, "_range"])
        .withColumn("upto", F.col("_upto") + F.col("_before"))
        .withColumn("before", F.col("upto") - F.col(weight))
        .drop("_range", "_upto", "_before")
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for tables a job writes and reads back."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}/{name}"
