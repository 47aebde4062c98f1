"""Delimited tables in, session tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions.names import ROW_ID, clean_names, tagged_name
from netloom.runtime import cut, setting

# Texts that mean "missing" in a delimited file.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
DECIMAL_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
BOOLEAN_TEXT = r"^(True|False|TRUE|FALSE|true|false)$"
JAVA_CHARSETS = "spark.sql.legacy.javaCharsets"
STANDARD_ENCODINGS = {"utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"}


def read_delimited(
    spark: SparkSession, path: str, encoding: str = "utf-8", sep: str = ",", multi_line: bool = False
) -> DataFrame:
    """Read a ``.csv``/``.txt`` table with a header row; types are settled over all rows.

    An encoding outside the standard ones (GBK, say) needs a session setting, so its texts are written down while that is in force.
    """
    if not path.lower().rstrip("/").endswith((".csv", ".txt")):
        raise ValueError(f"only .csv and .txt tables are read: {path}")
    encoding = {"ascii": "us-ascii", "utf8": "utf-8"}.get(encoding.lower(), encoding.lower())
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    if encoding in STANDARD_ENCODINGS:
        return settle_types(reader.csv(path))
    with setting(spark, JAVA_CHARSETS, "true"):
        raw = cut(reader.csv(path))
    return settle_types(raw)


def _present(name: str) -> Column:
    col = F.col(f"`{name}`")
    return F.when(~col.isin(*MISSING_TEXTS), col)


def settle_types(raw: DataFrame) -> DataFrame:
    """Text columns → bigint, decimal, double, boolean or string: the narrowest that fits every value.

    One aggregation over the file decides for all columns; dates stay text. Whole numbers beyond
    bigint become decimals of 38 digits, beyond those text, so no digit is lost.
    """
    checks = []
    for i, name in enumerate(raw.columns):
        text = _present(name)
        checks += [
            F.count(text).alias(f"n{i}"),
            F.count_if(text.rlike(INTEGER_TEXT)).alias(f"w{i}"),
            F.count_if(text.rlike(INTEGER_TEXT) & F.trim(text).try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count_if(text.rlike(INTEGER_TEXT) & F.trim(text).try_cast("decimal(38,0)").isNotNull()).alias(f"l{i}"),
            F.count_if(text.rlike(DECIMAL_TEXT)).alias(f"d{i}"),
            F.count_if(text.rlike(BOOLEAN_TEXT)).alias(f"b{i}"),
        ]
    if not checks:
        return raw
    found = raw.agg(*checks).first()

    def typed(i: int, name: str) -> Column:
        n = found[f"n{i}"]
        if n and found[f"i{i}"] == n:
            return F.trim(_present(name)).cast("bigint")
        if n and found[f"w{i}"] == n:
            return F.trim(_present(name)).cast("decimal(38,0)") if found[f"l{i}"] == n else _present(name)
        if found[f"d{i}"] == n:  # an all-missing column is numeric
            return F.trim(_present(name)).cast("double")
        if found[f"b{i}"] == n:
            return _present(name).cast("boolean")
        return _present(name)

    return raw.select(*(typed(i, c).alias(c) for i, c in enumerate(raw.columns)))


def add_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Number the rows of a file scan 0, 1, 2 … in file order, id first.

    Each row knows its position in its task; per file block one count is taken, and blocks
    are offset in (file, byte offset) order. The running total is over one row per block.
    """
    block = ["_file", "_start"]
    placed = df.select(
        "*",
        F.monotonically_increasing_id().alias("_pos"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )
    blocks = placed.groupBy(*block).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    ahead = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    return placed.join(offsets, block).select(
        (F.col("_before") + F.col("_pos") - F.col("_first")).alias(name), *df.columns
    )


def load_table(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Read, number and rename: the ``data`` table of a session."""
    return clean_names(add_row_id(read_delimited(spark, path, encoding)))


def preview(df: DataFrame, lines: int = -1, tagged: bool = False, row_id: str = ROW_ID) -> DataFrame:
    """First ``lines`` rows in row order (-1: all) without the id, header optionally typed."""
    if lines >= 0:
        df = df.orderBy(row_id).limit(lines) if row_id in df.columns else df.limit(lines)
    if row_id in df.columns:
        df = df.drop(row_id)
    return df.toDF(*map(tagged_name, df.schema.fields)) if tagged else df


def write_csv(df: DataFrame, path: str) -> None:
    """One session table as CSV part files with headers."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
