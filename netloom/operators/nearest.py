"""Nearest-neighbour graphs without a distance bound, exact, in any number of dimensions.

Rows are dealt to the nearest of a bounded number of pivots (after Lu et al. 2012) and first meet the rows of their own cell. The ``k``-th best
distance there bounds the answer, and by the triangle inequality a row need only ask the other cells that reach into that distance: only rows
next to a border travel, and only as askers. Cells meet block against block, and the best of every block are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators import pairs as pw
from netloom.runtime import cut

CELL_ROWS = 2_000
#: Of wide vectors a task compares more: where nothing can be ruled out, every row travels once for each cell.
WIDE_ROWS = 16_000
#: Distances that are held at once.
AT_ONCE = 4_000_000
#: No more pivots than this; they and their distances travel to every task.
PIVOTS = 1_024
_STRAIGHT = ("euclidean", "sqeuclidean", "seuclidean", "mahalanobis", "cosine", "correlation")


def _cross(metric: str, a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Distances of all rows of ``a`` and ``b`` in a form that obeys the triangle inequality, nearly exact."""
    if metric in _STRAIGHT:
        squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(squares, 0))
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        gap = np.abs(x[:, None] - y[None, :])
        if metric == "chebyshev":
            np.maximum(out, gap, out=out)
        elif metric == "jensenshannon":
            out += _divergence(x[:, None], y[None, :])
        else:
            out += gap**p if metric == "minkowski" else gap
    if metric == "minkowski":
        return out ** (1 / p)
    return np.sqrt(np.maximum(out, 0) / 2) if metric == "jensenshannon" else out


def _divergence(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    middle = (x + y) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, x * np.log(x / middle), 0.0) + np.where(y > 0, y * np.log(y / middle), 0.0)


def _exact(metric: str, a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """The distance itself, row by row."""
    if metric in ("cosine", "correlation"):
        return 1 - (a * b).sum(1)
    gap = np.abs(a - b)
    if metric == "cityblock":
        return gap.sum(1)
    if metric == "chebyshev":
        return gap.max(1)
    if metric == "minkowski":
        return (gap**p).sum(1) ** (1 / p)
    if metric == "jensenshannon":
        return np.sqrt(np.maximum(_divergence(a, b).sum(1), 0) / 2)
    squares = (gap * gap).sum(1)
    return squares if metric == "sqeuclidean" else np.sqrt(squares)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(metric: str, asking: np.ndarray, others: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, other, dist)`` of the ``k`` nearest others of every row; of equal distances the earlier other comes first."""
    step = max(1, AT_ONCE // max(1, len(others)))
    if len(asking) > step:
        parts = [_best(metric, asking[s : s + step], others, k, p) for s in range(0, len(asking), step)]
        rows = np.concatenate([part[0] + s * step for s, part in enumerate(parts)])
        return rows, *(np.concatenate([part[i] for part in parts]) for i in (1, 2))
    rough = _cross(metric, asking, others, p)
    last = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(others) else np.full(len(asking), math.inf)
    largest = math.sqrt(max((asking * asking).sum(1).max(initial=0), (others * others).sum(1).max(initial=0)))
    rows, cols = np.nonzero(rough**2 <= (last**2 + 1e-12 * largest**2 * asking.shape[1] + 1e-300)[:, None])
    dist = np.empty(len(rows))
    for start in range(0, len(rows), 1 << 18):
        part = slice(start, start + (1 << 18))
        dist[part] = _exact(metric, asking[rows[part]], others[cols[part]], p)
    order = np.lexsort((cols, dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    keep = place < k
    return rows[keep], cols[keep], dist[keep]


class _Cells:
    """Pivots, the radius of every cell, and the reach within which all its rows have ``k`` points."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, nearest: list[list[float]], k: int, metric: str, p: float, largest: float):
        self.pivots, self.radius, self.metric, self.p = pivots, radius, metric, p
        self.slack = 1e-6 * largest + 1e-9
        self.apart = _cross(metric, pivots, pivots, p)
        near = np.array([row + [math.inf] * (k - len(row)) for row in nearest])
        self.reach = np.empty(len(pivots))
        for i in range(len(pivots)):
            bounds = (radius[i] + self.apart[i][:, None] + near).ravel()
            self.reach[i] = np.partition(bounds, k - 1)[k - 1] if len(bounds) >= k else math.inf

    def own(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = _cross(self.metric, vectors, self.pivots, self.p)
        return away, away.argmin(1)

    def beyond(self, vectors: np.ndarray, within: np.ndarray, capped: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """``(row, cell)`` of the cells, other than its own, that may hold a point ``within`` a row's distance.

        ``capped``: or, if that is less, within the distance that bounds the nearest of every row of the cell.
        """
        away, home = self.own(vectors)
        every = np.arange(len(home))
        limit = (np.minimum(within, self.reach[home]) if capped else within)[:, None] + self.slack
        may = away <= self.radius[None, :] + limit
        if self.metric in _STRAIGHT:  # distance to the plane between two pivots
            may &= (away**2 - away[every, home][:, None] ** 2) / (2 * np.maximum(self.apart[home], 1e-300)) <= limit
        else:
            may &= (away - away[every, home][:, None]) / 2 <= limit
        may &= (self.radius >= 0)[None, :]
        may[every, home] = False
        return np.nonzero(may)


def _cells(points: DataFrame, k: int, metric: str, p: float, wanted: int | None = None) -> _Cells:
    wanted = min(PIVOTS, max(1, wanted or math.ceil(math.sqrt(points.count()))))
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()  # at most PIVOTS rows
    pivots = np.array([r["vec"] for r in chosen], float).reshape(len(chosen), -1)
    shared = points.sparkSession.sparkContext.broadcast(_Cells(pivots, np.zeros(len(pivots)), [[]] * len(pivots), 1, metric, p, 0.0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        near: dict[int, np.ndarray] = {}
        far, largest = np.zeros(len(cells.pivots)), 0.0
        for batch in batches:
            vectors = _vectors(batch.column(0))
            if not len(vectors):
                continue
            away, home = cells.own(vectors)
            least = away[np.arange(len(home)), home]
            largest = max(largest, float(np.abs(vectors).max()) * math.sqrt(vectors.shape[1]))
            np.maximum.at(far, home, least)
            for cell in np.unique(home):
                near[cell] = np.sort(np.concatenate([near.get(cell, np.empty(0)), least[home == cell]]))[:k]
        found = sorted(near)
        columns = [pa.array(found, pa.int32()), pa.array([far[c] for c in found], pa.float64()), pa.array([near[c].tolist() for c in found], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([largest] * len(found), pa.float64())], names=["cell", "far", "near", "largest"])

    seen = points.select("vec").mapInArrow(measure, "cell int, far double, near array<double>, largest double")
    ends = seen.groupBy("cell").agg(F.max("far").alias("far"), F.max("largest").alias("largest"))
    first = Window.partitionBy("cell").orderBy("d")
    close = seen.select("cell", F.explode("near").alias("d")).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    near = close.groupBy("cell").agg(F.array_sort(F.collect_list("d")).alias("near"))
    radius, nearest, largest = np.full(len(pivots), -1.0), [[] for _ in pivots], 0.0  # a pivot that is nearest to nothing has no cell
    for r in ends.join(near, "cell").collect():  # a row per pivot
        radius[r["cell"]], nearest[r["cell"]], largest = r["far"], list(r["near"]), max(largest, r["largest"])
    return _Cells(pivots, radius, nearest, k, metric, p, largest)


_PLACED = ("cell", "id", "vec")


def _placed_schema(points: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("cell", T.IntegerType()), *points.select("id", "vec").schema.fields])


def _at(cells: np.ndarray, rows: np.ndarray, ids: pa.Array, vectors: pa.Array) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), 10_000):
        part = slice(start, start + 10_000)
        at = pa.array(rows[part])
        yield pa.RecordBatch.from_arrays([pa.array(cells[part], pa.int32()), ids.take(at), vectors.take(at)], names=list(_PLACED))


def at_home(points: DataFrame, shared) -> DataFrame:
    """``(cell, id, vec)``: every point in the cell of its nearest pivot."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                home = shared.value.own(_vectors(batch.column(1)))[1]
                yield from _at(home, np.arange(len(home)), batch.column(0), batch.column(1))

    return points.select("id", "vec").mapInArrow(place, _placed_schema(points))


def asking_elsewhere(home: DataFrame, found: DataFrame, k: int, metric: str, shared) -> DataFrame:
    """``(cell, id, vec)``: the points once for every other cell that may hold one of their ``k`` nearest."""
    last = F.when(F.count(F.lit(1)) >= k, F.max("dist"))
    straight = F.sqrt(F.abs(2 * F.col("last"))) if metric in ("cosine", "correlation") else F.sqrt("last") if metric == "sqeuclidean" else F.col("last")
    within = found.groupBy("id").agg(last.alias("last")).select("id", F.coalesce(straight, F.lit(math.inf)).alias("within"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows, cells = shared.value.beyond(_vectors(batch.column(1)), np.asarray(batch.column(2)))
                yield from _at(cells, rows, batch.column(0), batch.column(1))

    return home.join(within, "id").select("id", "vec", "within").mapInArrow(send, _placed_schema(home))


def _blocks(asking: DataFrame, others: DataFrame, rows: int, columns: Sequence[str] = ("id", "vec")) -> tuple[DataFrame, DataFrame]:
    """Both sides of the cells, keyed by cell, block of asking rows and block of rows asked for."""
    count = lambda side, name: side.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).alias(name))
    sizes = F.broadcast(count(asking, "_a").join(count(others, "_b"), "cell"))  # at most a row per pivot
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asking.join(sizes, "cell").withColumn("i", block("_a")).withColumn("j", every("_b"))
    right = others.join(sizes, "cell").withColumn("j", block("_b")).withColumn("i", every("_a"))
    # columns of their own for either side: both come from one table
    return tuple(side.select(*[F.col(c).alias(f"{tag}_{c}") for c in ("cell", "i", "j", *columns)]) for tag, side in (("a", left), ("b", right)))


def _met(asking: DataFrame, others: DataFrame, k: int, metric: str, p: float, rows: int) -> DataFrame:
    """``(id, target, dist)``: for every block of a cell, the ``k`` points of it nearest to each asking one."""
    left, right = _blocks(asking, others, rows)
    kind = asking.schema["id"].dataType

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = a.schema.field("a_id").type
        if not len(a) or not len(b):
            return pa.table({"id": pa.array([], kinds), "target": pa.array([], kinds), "dist": pa.array([], pa.float64())})
        b = b.sort_by("b_id")
        at, to, dist = _best(metric, _vectors(a["a_vec"].combine_chunks()), _vectors(b["b_vec"].combine_chunks()), k, p)
        return pa.table([a["a_id"].take(pa.array(at)), b["b_id"].take(pa.array(to)), pa.array(dist)], names=["id", "target", "dist"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("target", kind), T.StructField("dist", T.DoubleType())])
    return left.groupBy("a_cell", "a_i", "a_j").cogroup(right.groupBy("b_cell", "b_i", "b_j")).applyInArrow(nearest, schema)


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id").orderBy("dist", "target")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def _k_nearest(points: DataFrame, k: int, metric: str, p: float, rows: int) -> DataFrame:
    """``(id, target, dist)``: the ``k`` points nearest to each point, itself among them."""
    # cells of a block or more each: where nothing can be ruled out, a row is sent once for every cell
    shared = points.sparkSession.sparkContext.broadcast(_cells(points, k, metric, p, math.ceil(points.count() / rows)))
    home = cut(at_home(points, shared))
    near = cut(_first(_met(home, home, k, metric, p, rows), k))
    elsewhere = asking_elsewhere(home, near, k, metric, shared)
    return _first(near.unionByName(_met(elsewhere, home, k, metric, p, rows)), k)


def _neighbours(rows: DataFrame, k: int, metric: str, p: float, block: int) -> DataFrame:
    """Answer for ``(id, vec)``; rows equal in every coordinate are one point that keeps its ``k + 1`` least ids."""
    if k < 1:
        raise ValueError("ask for one neighbour at least")
    asked = cut(rows)
    ranked = asked.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_n") <= k + 1)
    points = cut(ranked.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]))
    if points.isEmpty():
        near = points.select("id", F.col("id").alias("target"), F.lit(0.0).alias("dist"))
    else:
        near = cut(_k_nearest(points, k + 1, metric, p, block))
    copies = points.select(F.col("id").alias("target"), "ids")
    best = Window.partitionBy("id").orderBy("dist", "target")
    short = (
        near.join(copies, "target")
        .select("id", F.explode("ids").alias("target"), "dist")
        .withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= k + 1)  # enough for any copy of the point
        .select(F.col("id").alias("point"), "target", "dist")
    )
    rank = Window.partitionBy("source").orderBy("dist", "target")
    return (
        asked.join(points.select(F.col("id").alias("point"), "vec"), "vec")
        .select(F.col("id").alias("source"), "point")
        .join(short, "point")
        .where("source <> target")
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select("source", "target", "dist", "rank")
    )


def _array(columns: Sequence[Column]) -> Column:
    return F.array(*[c + F.lit(0.0) for c in columns])  # minus zero is zero


def nearest_neighbours(
    df: DataFrame, id_col: str, cols: Sequence[str], k: int, metric: str = "euclidean", cell_rows: int = CELL_ROWS, p: float = 2.0
) -> DataFrame:
    """``(source, target, dist, rank)``: the ``k`` nearest other rows of each row, ties by id. Exact.

    ``cell_rows`` bounds the rows a task compares at once. Rows with a missing coordinate have no neighbours and are nobody's.
    """
    if metric not in pw.GRID_METRICS or metric in ("braycurtis", "canberra"):
        raise ValueError("nearest neighbours need a distance that obeys the triangle inequality")
    prep = pw._prepare(df, id_col, cols, metric, 1.0, p)
    return _neighbours(prep.rows.select("id", _array([F.col(f"x{i}") for i in range(prep.dims)]).alias("vec")), k, metric, p, cell_rows)


def vector_rows(df: DataFrame, id_col: str, vector_col: str, metric: str) -> DataFrame:
    """``(id, vec)`` of the rows whose vector is whole; unit vectors for the cosine distance, where zero vectors have none."""
    vec = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double") + F.lit(0.0))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec"))
    rows = rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v)))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
        rows = rows.withColumn("_norm", norm).where("_norm > 0").select("id", F.transform("vec", lambda v: v / F.col("_norm")).alias("vec"))
    sizes = rows.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} numbers have no distance")
    return rows


def nearest_vectors(df: DataFrame, id_col: str, vector_col: str, k: int, metric: str = "euclidean", cell_rows: int = WIDE_ROWS, p: float = 2.0) -> DataFrame:
    """As :func:`nearest_neighbours`, for an array column of any length. Null vectors and vectors with a null or NaN have no neighbours."""
    if metric not in ("euclidean", "sqeuclidean", "cosine", "cityblock", "chebyshev", "minkowski"):
        raise ValueError(f"no nearest vectors by {metric!r}")
    return _neighbours(vector_rows(df, id_col, vector_col, metric), k, metric, p, cell_rows)
