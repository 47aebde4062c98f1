"""Column naming rules and SQL text clean-up."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROW_ID = "row_id"

# Dtype tags a preview header may carry after a "$".
DTYPE_TAGS = {
    T.ByteType: "int8",
    T.ShortType: "int16",
    T.IntegerType: "int32",
    T.LongType: "int64",
    T.FloatType: "float32",
    T.DoubleType: "float64",
    T.BooleanType: "bool",
    T.TimestampType: "datetime64[ns]",
    T.TimestampNTZType: "datetime64[ns]",
    T.DateType: "datetime64[ns]",
}


def clean_name(name: str) -> str:
    """Trim, then turn spaces and underscores into hyphens."""
    return name.strip().replace(" ", "-").replace("_", "-")


def clean_names(df: DataFrame, keep: tuple[str, ...] = (ROW_ID,)) -> DataFrame:
    return df.toDF(*(c if c in keep else clean_name(c) for c in df.columns))


def tagged_name(field: T.StructField) -> str:
    return f"{field.name}${DTYPE_TAGS.get(type(field.dataType), 'object')}"


def straight_quotes(text: str) -> str:
    """Typographic quotes typed into a predicate become plain ones."""
    return re.sub("[‘’“”\"]", "'", text)


def backtick_brackets(text: str) -> str:
    """``[col-name]`` → `` `col-name` ``, leaving string literals alone."""
    pieces = re.split(r"('(?:[^']|'')*')", text)
    return "".join(
        piece if i % 2 else re.sub(r"\[([^\[\]]+)\]", r"`\1`", piece)
        for i, piece in enumerate(pieces)
    )
