"""Chart encodings as column operators: sizes, colours, widths, labels."""

from __future__ import annotations

import colorsys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Well-separated hues, one golden-ratio step apart.
PALETTE = tuple(
    "#" + "".join(f"{round(255 * part):02x}" for part in colorsys.hsv_to_rgb(i * 0.618034 % 1, 0.65, 0.9))
    for i in range(180)
)
# Offsets, factors and class counts of the encodings.
SIZE_COMPUTED = (20, 5)  # offset and factor for degree, betweenness, closeness
SIZE_ATTRIBUTE = (30, 40)  # the same for any other attribute
COLOUR_CLASSES = 10
WIDTH_RANGE = (0.2, 1.0)
WIDTH_SCALE = (10, 20)
COMPUTED = ("degree", "betweenness", "closeness")
SHAPES = ("circle", "triangle", "rect", "diamond", "image")


def rescaled(df: DataFrame, column: str, low: float, high: float) -> Column:
    """Map a column linearly onto [low, high]; a constant column maps to ``low``."""
    value = F.col(f"`{column}`").cast("double")
    least, most = df.agg(F.min(value), F.max(value)).first()
    if least is None or most == least:
        return F.when(value.isNotNull(), F.lit(float(low)))
    return F.lit(float(low)) + F.lit((high - low) / (most - least)) * (value - F.lit(least))


def node_size(df: DataFrame, column: str) -> Column:
    base, factor = SIZE_COMPUTED if column in COMPUTED else SIZE_ATTRIBUTE
    return (base + factor * rescaled(df, column, 1, 10)).cast("int")


def value_class(df: DataFrame, column: str, classes: int = COLOUR_CLASSES) -> Column:
    """1 … classes, by value."""
    return F.ceil(rescaled(df, column, 1, classes)).cast("int")


def palette_colour(index: Column, palette: Sequence[str] = PALETTE) -> Column:
    return F.element_at(F.array(*map(F.lit, palette)), (index + 1).cast("int"))


def category_class(df: DataFrame, column: str, out: str, classes: int = len(PALETTE)) -> DataFrame:
    """Add the palette index of each distinct value, the last one shared when colours run out.

    Only values that get a colour of their own are numbered: the first ``classes − 1``
    in order. Every other value shares the last, so the lookup is at most that long.
    """
    first = df.select(F.col(f"`{column}`").alias("_value")).distinct().orderBy("_value").limit(classes - 1)
    own = first.withColumn("_index", F.row_number().over(Window.orderBy("_value")) - 1)
    joined = df.join(F.broadcast(own), F.col(f"`{column}`").eqNullSafe(F.col("_value")), "left")
    return joined.withColumn(out, F.coalesce("_index", F.lit(classes - 1)).cast("int")).drop("_value", "_index")


def edge_width(df: DataFrame, column: str) -> Column:
    """Thicker for larger ``weight``, thinner for larger ``dist``."""
    base, factor = WIDTH_SCALE
    share = rescaled(df, column, *WIDTH_RANGE)
    if column == "dist":
        share = 1 / share
    elif column != "weight":
        raise ValueError("edge width follows weight or dist")
    return (base + factor * share).cast("int")


def label(df: DataFrame, column: str = "", vid: str = "vid") -> Column:
    """A chosen attribute; the name if none is chosen; the number if the choice or the name is not there."""
    wanted = column or "name"
    chosen = wanted if wanted in df.columns else vid
    return F.col(f"`{chosen}`").cast("string")


def tooltip(columns: Sequence[str], vid: str = "vid") -> Column:
    """``ID:…`` and one ``name:value`` line per attribute."""
    lines = [
        F.concat(F.lit(f"{c}:"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))) for c in columns
    ]
    return F.concat_ws("\n", F.concat(F.lit("ID:"), F.col(vid).cast("string")), *lines)


def shape(name: str = "circle", image: str = "image") -> tuple[Column, Column]:
    """Symbol and image columns; the image attribute is used only for the image shape."""
    if name not in SHAPES:
        raise ValueError(f"shape must be one of {SHAPES}")
    picture = F.col(f"`{image}`").cast("string") if name == "image" else F.lit(None).cast("string")
    return F.lit(name), picture
