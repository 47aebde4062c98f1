"""Similarity edges: all pairs of rows closer than a bound, found by exact equi-joins.

Every distance gets a candidate key derived from a lower bound of that distance, so a pair
within ``max_dist`` always shares a key (a grid cell or its neighbour, or a block of equal
coordinates) and nothing is lost; the real distance is then checked on each candidate. An
infinite ``max_dist`` is allowed and returns the whole pair table, whose size is then
quadratic by definition.
"""

from __future__ import annotations

import itertools
import math
import re
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.names import backtick_brackets, straight_quotes
from netloom.runtime import cut, dense_index, tasks_for

TILE_ROWS = 10_000
TASK_PAIRS = 4_000_000  # candidates a task compares
MOST_TASKS = 20_000
MAX_GRID = 3
SLACK = 1 + 1e-6
FINEST = 2**30  # rounding of a cell number is then far below the slack

# Distance names.
GRID_METRICS = (
    "euclidean", "seuclidean", "sqeuclidean", "cityblock", "chebyshev", "minkowski", "cosine",
    "correlation", "mahalanobis", "braycurtis", "canberra", "jensenshannon",
)
COUNT_METRICS = ("hamming", "jaccard", "jaccard_boolean", "dice", "rogerstanimoto", "sokalsneath")
OPEN_METRICS = ("russellrao", "yule")
METRICS = GRID_METRICS + COUNT_METRICS + OPEN_METRICS
# see only whether a coordinate is zero: at most 2 ** d kinds of rows
FLAG_METRICS = ("jaccard_boolean", "dice", "rogerstanimoto", "sokalsneath", *OPEN_METRICS)


WIDE = 16


def _sum(parts: Sequence[Column]) -> Column:
    """Sum as generated arithmetic; wide rows fold an array, as the planner is slow on long sums."""
    if len(parts) > WIDE:
        return F.aggregate(F.array(*parts), F.lit(0.0), lambda total, part: total + part)
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def _flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def distance(metric: str, x: Sequence[Column], y: Sequence[Column], p: float = 2.0) -> Column:
    """The distance of two rows as one arithmetic expression over their columns.

    Undefined values (0/0) come out null. ``seuclidean``, ``mahalanobis``, ``cosine``,
    ``correlation`` and ``jensenshannon`` expect the prepared columns of :func:`_prepare`.
    """
    pairs = list(zip(x, y))
    d = len(pairs)
    if metric in ("euclidean", "seuclidean", "mahalanobis"):
        return F.sqrt(_sum([(a - b) * (a - b) for a, b in pairs]))
    if metric == "sqeuclidean":
        return _sum([(a - b) * (a - b) for a, b in pairs])
    if metric in ("cosine", "correlation"):
        return 1 - _sum([a * b for a, b in pairs])
    if metric == "cityblock":
        return _sum([F.abs(a - b) for a, b in pairs])
    if metric == "chebyshev":
        gaps = [F.abs(a - b) for a, b in pairs]
        return F.greatest(*gaps) if d > 1 else gaps[0]
    if metric == "minkowski":
        return F.pow(_sum([F.pow(F.abs(a - b), F.lit(p)) for a, b in pairs]), F.lit(1 / p))
    if metric == "braycurtis":
        return F.try_divide(_sum([F.abs(a - b) for a, b in pairs]), _sum([F.abs(a + b) for a, b in pairs]))
    if metric == "canberra":
        return _sum(
            [F.coalesce(F.try_divide(F.abs(a - b), F.abs(a) + F.abs(b)), F.lit(0.0)) for a, b in pairs]
        )
    if metric == "jensenshannon":
        def half(a: Column, m: Column) -> Column:
            return F.when(a > 0, a * F.ln(a / m)).otherwise(0.0)

        total = _sum([half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in pairs])
        return F.sqrt(F.greatest(total, F.lit(0.0)) / 2)
    if metric == "hamming":
        return _sum([_flag(a != b) for a, b in pairs]) / d
    if metric == "jaccard":
        differ = _sum([_flag(a != b) for a, b in pairs])
        either = _sum([_flag((a != 0) | (b != 0)) for a, b in pairs])
        return F.coalesce(F.try_divide(differ, either), F.lit(0.0))
    tt = _sum([_flag((a != 0) & (b != 0)) for a, b in pairs])
    tf = _sum([_flag((a != 0) & (b == 0)) for a, b in pairs])
    ft = _sum([_flag((a == 0) & (b != 0)) for a, b in pairs])
    differ = tf + ft
    if metric == "jaccard_boolean":
        return F.coalesce(F.try_divide(differ, tt + differ), F.lit(0.0))
    if metric == "dice":
        return F.try_divide(differ, 2 * tt + differ)
    if metric == "rogerstanimoto":
        return 2 * differ / (d + differ)
    if metric == "sokalsneath":
        return F.try_divide(2 * differ, tt + 2 * differ)
    if metric == "russellrao":
        return (d - tt) / d
    if metric == "yule":
        ff = d - tt - differ
        return F.when(tf * ft == 0, 0.0).otherwise(F.try_divide(2 * tf * ft, tt * ff + tf * ft))
    raise ValueError(f"unknown distance {metric!r}; one of {METRICS}")


def _minkowski_below(x: Sequence[Column], y: Sequence[Column], p: float, bound: float, near: Column) -> Column:
    """``near``, the test of a Minkowski distance against ``bound``, without a power where plain products leave no doubt."""
    if not (0 < bound < math.inf and float(p).is_integer() and 1 <= p <= WIDE and 1e-200 < bound**p < 1e200):
        return near

    def power(gap: Column) -> Column:
        out = gap
        for _ in range(int(p) - 1):
            out = out * gap
        return out

    total = _sum([power(F.abs(a - b)) for a, b in zip(x, y)])
    doubt = 1e-9  # products and powers differ by far less
    return (total < bound**p * (1 + doubt)) & ((total < bound**p * (1 - doubt)) | near)


@dataclass(frozen=True)
class _Prepared:
    """Rows ``(id, x0 …)`` ready for :func:`distance`, and how near rows must agree."""

    rows: DataFrame
    dims: int
    grid: Sequence[Column]  # |difference| of each is below ``width`` for a wanted pair
    width: float
    mismatches: int | None = None  # wanted pairs differ in at most this many coordinates


def _prepare(df: DataFrame, id_col: str, cols: Sequence[str], metric: str, max_dist: float, p: float) -> _Prepared:
    d = len(cols)
    if not d:
        raise ValueError("name at least one column")
    names = [f"x{i}" for i in range(d)]
    value = [F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names)]
    rows = df.select(F.col(f"`{id_col}`").alias("id"), *value)
    x = [F.col(n) for n in names]
    # a missing coordinate makes every distance of the row undefined
    rows = rows.where(~F.exists(F.array(*x), lambda v: v.isNull() | F.isnan(v)))

    def replaced(new: Sequence[Column]) -> DataFrame:
        return rows.select("id", *(c.alias(n) for c, n in zip(new, names))).where(
            _all([F.col(n).isNotNull() for n in names])
        )

    if metric == "seuclidean":
        # the variance of the table stacked on itself
        stats = rows.agg(F.count(F.lit(1)).alias("n"), *(F.var_pop(c).alias(n) for c, n in zip(x, names))).first()
        n = stats["n"]
        scale = [math.sqrt(stats[c] * 2 * n / (2 * n - 1)) if n and stats[c] else 0.0 for c in names]
        rows = replaced([F.try_divide(c, F.lit(s)) for c, s in zip(x, scale)])
        return _Prepared(rows, d, x, max_dist)
    if metric == "mahalanobis":
        rows = replaced(_whitened(rows, names))
        return _Prepared(rows, d, x, max_dist)
    if metric in ("cosine", "correlation"):
        # mean and length are columns of their own, so wide rows do not repeat their sums
        mean = _sum(x) / d if metric == "correlation" else F.lit(0.0)
        rows = rows.withColumn("_mean", mean)
        base = [c - F.col("_mean") for c in x] if metric == "correlation" else x
        rows = rows.withColumn("_norm", F.sqrt(_sum([c * c for c in base])))
        rows = rows.where("_norm > 0").select("id", *((c / F.col("_norm")).alias(n) for c, n in zip(base, names)))
        return _Prepared(rows, d, x, math.sqrt(2 * max(max_dist, 0.0)))
    if metric == "jensenshannon":
        total = _sum(x)
        rows = replaced([F.try_divide(c, total) for c in x])
        return _Prepared(rows, d, x, math.sqrt(2) * max_dist)
    if metric in ("braycurtis", "canberra"):
        ratio = math.log((1 + max_dist) / (1 - max_dist)) if max_dist < 1 else math.inf
        sizes = [_sum([F.abs(c) for c in x])] if metric == "braycurtis" else [F.abs(c) for c in x]
        logs = [F.when(s > 0, F.ln(s)).otherwise(0.0) for s in sizes]
        return _Prepared(rows, d, logs, ratio)
    if metric in COUNT_METRICS:
        return _Prepared(rows, d, (), math.inf, _most_mismatches(metric, d, max_dist))
    if metric in OPEN_METRICS:
        return _Prepared(rows, d, (), math.inf)
    width = math.sqrt(max(max_dist, 0.0)) if metric == "sqeuclidean" else max_dist
    return _Prepared(rows, d, x, width)


def _all(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _whitened(rows: DataFrame, names: Sequence[str]) -> list[Column]:
    """Columns in which the mahalanobis distance is plain euclidean.

    The covariance (of the table stacked on itself) is one aggregation; only the d × d
    matrix is factored on the driver.
    """
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs),
    ).first()
    n = stats["n"] or 1
    cov = np.empty((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = (stats[f"c{i}_{j}"] or 0.0) * 2 * n / (2 * n - 1)
    turn = np.linalg.cholesky(np.linalg.inv(cov)).T
    return [
        _sum([F.lit(float(turn[i, j])) * F.col(names[j]) for j in range(len(names))]) for i in range(len(names))
    ]


def _most_mismatches(metric: str, d: int, bound: float) -> int | None:
    """Largest number of unequal coordinates a pair closer than ``bound`` can have."""
    if metric in ("hamming", "jaccard", "jaccard_boolean"):
        most = bound * d
    elif bound >= 1:
        return None
    elif metric == "dice":
        most = 2 * bound * d / (1 + bound)
    else:  # rogerstanimoto, sokalsneath
        most = bound * d / (2 - bound)
    allowed = math.ceil(most - 1e-9) - 1
    return None if allowed >= d else max(allowed, 0)


def tiled_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], condition: Column, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Equi-join on ``key`` plus ``condition``, with hot keys cut into tiles.

    A key with many rows on either side becomes a grid of tiles of at most about
    ``tile_rows`` × ``tile_rows`` candidates: each row joins one stripe of its own side and
    is repeated once per stripe of the other. Only keys over the limit — at most
    rows / tile_rows of them — are looked up. Key columns must carry the same names on
    both sides and be absent from ``condition``'s columns.
    """
    sizes = (
        left.groupBy(*key).agg(F.count(F.lit(1)).alias("_l"), F.lit(0).cast("bigint").alias("_r"))
        .unionByName(right.groupBy(*key).agg(F.lit(0).cast("bigint").alias("_l"), F.count(F.lit(1)).alias("_r")))
        .groupBy(*key)
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    )
    sizes = cut(sizes.where((F.col("_l") > 0) & (F.col("_r") > 0)))
    hot = sizes.where(F.greatest("_l", "_r") > tile_rows).select(
        *key,
        F.ceil(F.col("_l") / tile_rows).alias("_ls"),
        F.ceil(F.col("_r") / tile_rows).alias("_rs"),
    )
    pairs, most = sizes.agg(F.sum(F.col("_l").cast("double") * F.col("_r")), F.max(F.greatest("_l", "_r"))).first()
    stripes = (most or 0) > tile_rows
    if stripes:
        hot = cut(hot)
    # the rows of a task say little about its work, so tasks are counted by what they compare
    width = min(MOST_TASKS, tasks_for(left.sparkSession, int(pairs or 0), TASK_PAIRS))

    def striped(side: DataFrame, own: str, other: str, mine: str, theirs: str, seed: int) -> DataFrame:
        return (
            side.join(hot, list(key), "left")
            .withColumn(mine, F.pmod(F.xxhash64("id", F.lit(seed)), F.coalesce(own, F.lit(1))))
            .withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(other) - 1, F.lit(0)))))
            .drop("_ls", "_rs")
        )

    def packed(side: DataFrame, tag: str) -> DataFrame:
        extra = [F.col(c).alias(f"_{tag}{c}") for c in ("_i", "_j")] if stripes else []
        keys = [F.col(k).alias(f"_{tag}{n}") for n, k in enumerate(key)]
        return side.select(*keys, *extra, F.struct(*(c for c in side.columns if c not in ("_i", "_j"))).alias(tag))

    if stripes:
        left = striped(left, "_ls", "_rs", "_i", "_j", 1)
        right = striped(right, "_rs", "_ls", "_j", "_i", 2)
    names = [str(n) for n in range(len(key))] + (["_i", "_j"] if stripes else [])
    same = _all([F.col(f"_a{n}") == F.col(f"_b{n}") for n in names])
    dealt = [packed(side, tag).repartition(width, *(f"_{tag}{n}" for n in names)) for side, tag in ((left, "a"), (right, "b"))]
    # repeated rows make size estimates too low to trust for a broadcast
    return dealt[0].hint("merge").join(dealt[1], same & condition).select("a", "b")


def _grid(prep: _Prepared, limit: int = MAX_GRID) -> tuple[DataFrame, list[str], float]:
    """Add cell columns on the widest-spread coordinates; none if the bound spans the data.

    Cells are counted from the smallest value and never finer than ``FINEST`` to the span, so they stay
    exact for bounds of any smallness, zero included.
    """
    width = max(prep.width, 0.0) * SLACK
    if not prep.grid or not math.isfinite(width):
        return prep.rows, [], width
    ends = prep.rows.agg(*(f(c) for c in prep.grid for f in (F.min, F.max))).first()
    cells = []
    for i in range(len(prep.grid)):
        low, high = ends[2 * i], ends[2 * i + 1]
        if low is None or not math.isfinite(high - low) or high == low:
            continue
        step = max(width, (high - low) / FINEST)
        if (high - low) / step > 2:
            cells.append(((high - low) / step, i, low, step))
    cells = sorted(cells, reverse=True)[:limit]
    names = [f"c{n}" for n in range(len(cells))]
    rows = prep.rows.select(
        "*", *(F.floor((prep.grid[i] - F.lit(low)) / F.lit(step)).alias(n) for n, (_, i, low, step) in zip(names, cells))
    )
    return rows, names, width


def _neighbour_cells(rows: DataFrame, cells: Sequence[str], half: bool) -> DataFrame:
    """Repeat each row for its own cell and the adjacent ones (one of each opposite pair if half)."""
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(cells))]
    if half:
        steps = [s for s in steps if s >= (0,) * len(cells)]
    others = [c for c in rows.columns if c not in cells]
    own = F.lit(True) if not cells else None
    moved = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(not any(s)).alias("own"),
                    *((F.col(c) + F.lit(k)).alias(c) for c, k in zip(cells, s)),
                )
                for s in steps
            )
        )
    )
    if own is not None:
        return rows.withColumn("own", own)
    return rows.select(*others, moved.alias("_cell")).select(*others, "_cell.own", *(f"_cell.{c}" for c in cells))


def similarity_edges(
    df: DataFrame,
    id_col: str,
    cols: Sequence[str],
    metric: str = "euclidean",
    max_dist: float = 1.0,
    p: float = 2.0,
    inclusive: bool = False,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``(source, target, dist)`` for all pairs with dist < max_dist, source id before target id."""
    if metric not in METRICS:
        raise ValueError(f"unknown distance {metric!r}; one of {METRICS}")
    bound = math.nextafter(max_dist, math.inf) if inclusive and math.isfinite(max_dist) else max_dist
    prep = _prepare(df, id_col, cols, metric, bound, p)
    prep = replace(prep, rows=cut(prep.rows))  # read several times below: id and coordinates only
    members = None
    if metric in FLAG_METRICS:
        prep, members = _flag_classes(prep)
    x = [F.col(f"a.x{i}") for i in range(prep.dims)]
    y = [F.col(f"b.x{i}") for i in range(prep.dims)]
    dist = distance(metric, x, y, p)
    near = dist <= max_dist if inclusive else dist < max_dist
    if metric == "minkowski":
        near = _minkowski_below(x, y, p, max_dist, near)
    if prep.mismatches is not None:
        joined = _equal_block_join(prep, x, y, metric in ("hamming", "jaccard"), near, tile_rows)
    else:
        rows, cells, _ = _grid(prep)
        key = cells or ["c0"]
        if not cells:
            if math.isfinite(max_dist) and not rows.isEmpty():
                warnings.warn(f"a {metric} bound of {max_dist} rules out no pair beforehand: all pairs are compared", stacklevel=2)
            # always 0, but not a constant: the planner would drop that from the key and lose the number of tasks
            rows = rows.withColumn("c0", F.col("x0").isNull().cast("int"))
        left = _neighbour_cells(rows, cells, half=True)
        once = ~F.col("a.own") | (F.col("a.id") < F.col("b.id"))
        joined = tiled_join(left, rows, key, once & near, tile_rows)
    edges = joined.select(*_ends(), dist.alias("dist"))
    if members is None:
        return edges
    own = [F.col(f"x{i}") for i in range(prep.dims)]
    inside = prep.rows.select(F.col("id").alias("source"), F.col("id").alias("target"), distance(metric, own, own, p).alias("dist"))
    inside = inside.where(F.col("dist") <= max_dist if inclusive else F.col("dist") < max_dist)
    return _member_pairs(members, cut(edges.unionByName(inside)), tile_rows)


def _ends() -> list[Column]:
    return [F.least("a.id", "b.id").alias("source"), F.greatest("a.id", "b.id").alias("target")]


def _flag_classes(prep: _Prepared) -> tuple[_Prepared, DataFrame]:
    """Rows that are zero at the same coordinates as one class, numbered in place of an id, and ``(id, class)`` of every row."""
    names = [f"x{i}" for i in range(prep.dims)]
    flagged = prep.rows.select("id", *((F.col(n) != 0).cast("double").alias(n) for n in names))
    classes = cut(dense_index(flagged.select(*names).distinct(), "id", *names))
    members = flagged.join(classes.withColumnRenamed("id", "class"), names).select("id", "class")
    return replace(prep, rows=classes), cut(members)


def _member_pairs(members: DataFrame, links: DataFrame, tile_rows: int) -> DataFrame:
    """Every pair of members of linked classes once, at the distance of the classes."""
    left = members.join(links, F.col("class") == F.col("source")).select("id", "source", "target", "dist")
    right = members.join(links, F.col("class") == F.col("target")).select("id", "source", "target")
    inside = F.col("a.source") == F.col("a.target")
    once = F.when(inside, F.col("a.id") < F.col("b.id")).otherwise(F.col("a.id") != F.col("b.id"))
    joined = tiled_join(left, right, ["source", "target"], once, tile_rows)
    return joined.select(*_ends(), F.col("a.dist").alias("dist"))


def _equal_block_join(
    prep: _Prepared, x: list[Column], y: list[Column], exact: bool, near: Column, tile_rows: int
) -> DataFrame:
    """Pairs differing in at most m coordinates agree on one of m + 1 blocks of them.

    Rows join per block on its whole content; a pair agreeing on several blocks is taken
    at the first only.
    """
    blocks = np.array_split(np.arange(prep.dims), prep.mismatches + 1)
    as_key: Callable[[Column], Column] = (lambda c: c) if exact else (lambda c: c != 0)

    def content(block: np.ndarray) -> Column:
        return F.to_json(F.array(*(as_key(F.col(f"x{i}")) for i in block)))

    keyed = prep.rows.select(
        "*",
        F.explode(
            F.array(*(F.struct(F.lit(n).alias("block"), content(b).alias("content")) for n, b in enumerate(blocks)))
        ).alias("_k"),
    ).select(*prep.rows.columns, "_k.block", "_k.content")
    agree = [_all([as_key(x[i]) == as_key(y[i]) for i in b]) for b in blocks]
    first = F.coalesce(*(F.when(t, F.lit(n)) for n, t in enumerate(agree)))
    once = (F.col("a.id") < F.col("b.id")) & (F.col("a.block") == first)
    return tiled_join(keyed, keyed, ["block", "content"], once & near, tile_rows)


_UPPER = re.compile(r"^\s*`?dist`?\s*(<=?)\s*([0-9.eE+-]+)\s*$|^\s*([0-9.eE+-]+)\s*(>=?)\s*`?dist`?\s*$")


def similarity_where(
    df: DataFrame, id_col: str, cols: Sequence[str], metric: str, predicate: str, p: float = 2.0
) -> DataFrame:
    """``(source, target, dist)`` of the pairs that satisfy a predicate on ``dist``.

    Upper bounds that the whole predicate demands (``dist < 0.3 and …``) limit the join; what else it
    says is filtered afterwards. Brackets and typographic quotes are taken as in row filters. A
    predicate without such a bound asks for all pairs.
    """
    text = backtick_brackets(straight_quotes(predicate))
    bound = math.inf
    if not re.search(r"\b(or|not|case|between)\b", text, re.IGNORECASE):
        for part in re.split(r"\band\b", text, flags=re.IGNORECASE):
            found = _UPPER.match(part.strip().strip("()"))
            if found:
                bound = min(bound, float(found[2] or found[3]))
    return similarity_edges(df, id_col, cols, metric, bound, p, inclusive=True).where(text)
