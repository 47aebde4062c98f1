"""Similarity edges between wide vectors, exact, by pivots and the triangle inequality.

Vectors are dealt to the nearest of a few pivots. A pair within the bound either shares a cell or one of the two lies so close to the border that
it may reach into the other's cell; it asks there, and every pair of cells is looked at from one side only. Inside a cell blocks of
vectors meet as matrices, so nothing but links leaves a task: all of them, or only their number for every vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from netloom.operators import nearest as nn
from netloom.runtime import cut

CELL_ROWS = 2_000


@dataclass(frozen=True)
class Bound:
    metric: str
    max_dist: float
    inclusive: bool

    @property
    def straight(self) -> float:
        """The plain distance that the bound stands for, of unit vectors in the case of the cosine."""
        d = self.max_dist
        return math.sqrt(2 * d) if self.metric == "cosine" else math.sqrt(d) if self.metric == "sqeuclidean" else d

    def near(self, a: pa.Table, b: pa.Table, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in both blocks and distance of the pairs within; of two blocks of one cell each pair once."""
        left, right = nn._vectors(a["a_vec"].combine_chunks()), nn._vectors(b["b_vec"].combine_chunks())
        rough = nn._cross("euclidean", left, right, 2.0)
        largest = math.sqrt(max((left * left).sum(1).max(initial=0), (right * right).sum(1).max(initial=0)))
        rows, cols = np.nonzero(rough <= self.straight * (1 + 1e-9) + 1e-6 * largest + 1e-12)
        if same:
            once = a["a_no"].to_numpy()[rows] < b["b_no"].to_numpy()[cols]
            rows, cols = rows[once], cols[once]
        parts = [nn._exact(self.metric, left[rows[s : s + 65536]], right[cols[s : s + 65536]], 2.0) for s in range(0, len(rows), 65536)]
        dist = np.concatenate([np.empty(0), *parts])
        keep = dist <= self.max_dist if self.inclusive else dist < self.max_dist
        return rows[keep], cols[keep], dist[keep]


@dataclass(frozen=True)
class VectorJoin:
    """Cells of the vectors, ready to be compared."""

    home: DataFrame
    asking: DataFrame
    bound: Bound
    cell_rows: int

    def _met(self, schema: T.StructType, tell) -> DataFrame:
        out, bound, empty = None, self.bound, _arrow(schema).empty_table()

        def comparing(same: bool):
            return lambda a, b: tell(a, b, *bound.near(a, b, same)) if len(a) and len(b) else empty

        for asking, same in ((self.home, True), (self.asking, False)):
            left, right = nn._blocks(asking, self.home, self.cell_rows, ("id", "no", "vec"))
            part = left.groupBy("a_cell", "a_i", "a_j").cogroup(right.groupBy("b_cell", "b_i", "b_j")).applyInArrow(comparing(same), schema)
            out = part if out is None else out.unionByName(part)
        return out

    def edges(self) -> DataFrame:
        """``(source, target, dist)`` of all pairs, source id before target id."""
        kind = self.home.schema["id"].dataType
        schema = T.StructType([T.StructField("p", kind), T.StructField("q", kind), T.StructField("dist", T.DoubleType())])
        whole = _arrow(schema)

        def tell(a, b, rows, cols, dist):
            ids = [a["a_id"].take(pa.array(rows)), b["b_id"].take(pa.array(cols))]
            return pa.table([*ids, pa.array(dist)], names=["p", "q", "dist"]).cast(whole)

        return self._met(schema, tell).select(F.least("p", "q").alias("source"), F.greatest("p", "q").alias("target"), "dist")

    def link_counts(self) -> DataFrame:
        """``(id, n_links)`` of every vector, those without links included; no pair is written down."""
        kind = self.home.schema["id"].dataType
        schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType())])
        whole = _arrow(schema)

        def tell(a, b, rows, cols, dist):
            sides = []
            for ids, at in ((a["a_id"], rows), (b["b_id"], cols)):
                found, n = np.unique(at, return_counts=True)
                sides.append(pa.table([ids.take(pa.array(found)), pa.array(n, pa.int64())], names=["id", "n"]).cast(whole))
            return pa.concat_tables(sides)

        counted = self._met(schema, tell).unionByName(self.home.select("id", F.lit(0).cast("long").alias("n")))
        return counted.groupBy("id").agg(F.sum("n").alias("n_links"))

    @cached_property
    def compared(self) -> int:
        """Pairs of vectors that meet in a cell."""
        own = self.home.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        more = self.asking.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
        both = own.join(more, "cell", "left").agg(F.sum(F.expr("n * (n - 1) div 2 + n * coalesce(m, 0)"))).first()
        return both[0] or 0


def _arrow(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def vector_join(
    df: DataFrame, id_col: str, vector_col: str, max_dist: float, metric: str = "euclidean", inclusive: bool = False, cell_rows: int = CELL_ROWS
) -> VectorJoin:
    """All pairs of vectors with ``dist < max_dist`` (``<=`` if ``inclusive``), to be listed or counted.

    ``vector_col`` is an array column; all arrays are of one length. Null vectors and vectors with a null or NaN take no part, nor do zero vectors
    by the cosine distance. Rows are told apart by position, so repeated ids are rows of their own. ``cell_rows`` bounds the rows a task
    compares at once. The edges within a group of near copies are the square of its size; their counts are not.
    """
    if metric not in ("euclidean", "sqeuclidean", "cosine"):
        raise ValueError(f"no vector edges by {metric!r}")
    if not max_dist >= 0 or not math.isfinite(max_dist):
        raise ValueError("the bound on a distance is a number from 0 on")
    bound = Bound(metric, max_dist, inclusive)
    rows = cut(nn.vector_rows(df, id_col, vector_col, metric).withColumn("no", F.monotonically_increasing_id()))
    plain = "euclidean"  # unit vectors and squares are bounded by the plain distance
    points = rows.select(F.col("no").alias("id"), "vec")
    home_schema = T.StructType([T.StructField("cell", T.IntegerType()), *rows.select("id", "no", "vec").schema.fields])
    if rows.isEmpty():
        empty = df.sparkSession.createDataFrame([], home_schema)
        return VectorJoin(empty, empty, bound, cell_rows)
    shared = df.sparkSession.sparkContext.broadcast(nn._cells(points, 1, plain, 2.0, math.ceil(rows.count() / cell_rows)))
    within = bound.straight * (1 + 1e-9)

    def place(elsewhere: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                vectors = nn._vectors(batch.column(2))
                own = shared.value.own(vectors)[1]
                at, cells = np.arange(len(own)), own
                if elsewhere:
                    at, cells = shared.value.beyond(vectors, np.full(len(own), within), capped=False)
                    at, cells = at[cells > own[at]], cells[cells > own[at]]
                for start in range(0, len(at), 10_000):
                    part = slice(start, start + 10_000)
                    taken = [c.take(pa.array(at[part])) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([pa.array(cells[part], pa.int32()), *taken], names=["cell", "id", "no", "vec"])

        return run

    given = rows.select("id", "no", "vec")
    home, asking = (cut(given.mapInArrow(place(e), home_schema)) for e in (False, True))
    return VectorJoin(home, asking, bound, cell_rows)
