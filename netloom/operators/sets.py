"""Similarity edges between sets of varying size, exact, over an inverted index of their rarest items.

Two sets that are similar enough must share an item among the rarest few of each (prefix filter, Chaudhuri et al. 2006;
length and position bounds after Xiao et al. 2008). Only these few are indexed, so a frequent item is looked up only by the sets that have
nothing rarer, and no pair meets more than once. Equal sets are one class throughout.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.pairs import TILE_ROWS, tiled_join
from netloom.runtime import cut

# Measure names.
MEASURES = ("jaccard", "dice", "cosine")
SLACK = 1e-9


def _similarity(measure: str, common: Column, a: Column, b: Column) -> Column:
    if measure == "jaccard":
        return common / (a + b - common)
    if measure == "dice":
        return 2 * common / (a + b)
    return common / F.sqrt((a * b).cast("double"))


def _least_common(measure: str, least: float, a: Column, b: Column) -> Column:
    """Items that two sets of these sizes must share; never too many, whatever the rounding."""
    if measure == "jaccard":
        need = (a + b) * (least / (1 + least))
    elif measure == "dice":
        need = (a + b) * (least / 2)
    else:
        need = F.sqrt((a * b).cast("double")) * least
    return F.ceil(need - SLACK)


def _least_of_any(measure: str, least: float, size: Column) -> Column:
    """Items that a set of this size must share with any partner, and so the size of its smallest partner."""
    share = {"jaccard": least, "dice": least / (2 - least), "cosine": least * least}[measure]
    return F.greatest(F.ceil(size * share - SLACK), F.lit(1))


@dataclass(frozen=True)
class SetEdges:
    """Edges between classes of equal sets, and the rows of every class.

    ``edges(source, target, dist)`` link classes by their least ids, ``members(id, class, size)`` has every row with a set,
    ``candidates(source, target)`` the pairs whose sets were compared.
    """

    edges: DataFrame
    members: DataFrame
    candidates: DataFrame

    def rows(self) -> DataFrame:
        """``(source, target, dist)`` of all pairs of rows, copies included: their number is the square of a class's size."""
        inside = self.members.select(F.col("id").alias("source"), "class").join(self.members.select(F.col("id").alias("target"), "class"), "class")
        copies = inside.where("source < target").select("source", "target", F.lit(0.0).alias("dist"))
        left = self.members.select(F.col("id").alias("a"), F.col("class").alias("source"))
        right = self.members.select(F.col("id").alias("b"), F.col("class").alias("target"))
        across = self.edges.join(left, "source").join(right, "target")
        return copies.unionByName(across.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "dist"))


def set_edges(
    df: DataFrame,
    id_col: str,
    items_col: str,
    max_dist: float,
    measure: str = "jaccard",
    inclusive: bool = False,
    tile_rows: int = TILE_ROWS,
) -> SetEdges:
    """Pairs of sets with ``1 - similarity < max_dist`` (``<=`` if ``inclusive``), by class of equal sets.

    ``items_col`` is an array; repeated and null items count once and not at all. Null and empty sets are
    linked with nothing. Similarities are ``|x ∩ y|`` over ``|x ∪ y|`` (jaccard), the mean size (dice) or the geometric mean of the
    sizes (cosine). The bound lies below 1: sets without a common item have no key to meet by.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; one of {MEASURES}")
    if not 0 <= max_dist <= 1 or (inclusive and max_dist == 1):
        raise ValueError("the bound on a set distance lies between 0 and 1")
    least = 1 - max_dist
    items = F.array_sort(F.array_distinct(F.array_compact(F.col(f"`{items_col}`"))))
    given = cut(df.select(F.col(f"`{id_col}`").alias("id"), items.alias("items")).where(F.size("items") > 0))
    keyed = given.withColumn("size", F.size("items")).withColumn("_h", F.xxhash64("items"))
    # classes by content: a hash makes the shuffle key short, the items keep classes apart that share it
    classes = cut(keyed.groupBy("_h", "items", "size").agg(F.min("id").alias("id")))
    heads = classes.select("_h", "items", F.col("id").alias("class"))
    members = cut(keyed.join(heads, ["_h", "items"]).select("id", "class", "size"))
    sets = classes.select("id", "size", "items")

    each = sets.select("id", F.explode("items").alias("item"))
    often = cut(each.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    ranked = each.join(often, "item").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("r"))
    kept = F.col("size") - _least_of_any(measure, least, F.col("size")) + 1
    ordered = ranked.join(sets.select("id", "size"), "id").select(
        "id", "size", F.transform(F.slice("r", 1, kept.cast("int")), lambda x: x["item"]).alias("prefix")
    )
    index = cut(ordered.select("id", "size", "prefix", F.posexplode("prefix").alias("at", "item")))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    long_enough = (a("size") >= _least_of_any(measure, least, b("size"))) & (b("size") >= _least_of_any(measure, least, a("size")))
    # what still can be common from this item on
    room = 1 + F.least(a("size") - a("at"), b("size") - b("at")) - 1
    enough = room >= _least_common(measure, least, a("size"), b("size"))
    before = lambda side: F.slice(F.col(f"{side}.prefix"), 1, F.col(f"{side}.at"))
    first = ~F.arrays_overlap(before("a"), before("b"))
    met = tiled_join(index, index, ["item"], (a("id") < b("id")) & long_enough & enough & first, tile_rows)
    candidates = cut(met.select(F.col("a.id").alias("source"), F.col("b.id").alias("target")))

    left = sets.select(F.col("id").alias("source"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("target"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    paired = candidates.join(left, "source").join(right, "target")
    dist = 1 - _similarity(measure, common, F.size("x"), F.size("y"))
    near = F.col("dist") <= max_dist if inclusive else F.col("dist") < max_dist
    edges = paired.select("source", "target", dist.alias("dist")).where(near)
    return SetEdges(edges, members, candidates)


def share_of_pairs(edges: SetEdges) -> float:
    """Compared pairs of classes over all pairs of classes: what the filters leave of the quadratic work."""
    n = edges.members.select("class").distinct().count()
    return edges.candidates.count() / max(1, math.comb(n, 2))
