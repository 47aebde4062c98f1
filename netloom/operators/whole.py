"""Graphs that one task can hold: the arcs as arrays in every task, and the searches from all vertices dealt over the tasks.

A search by joins pays for a shuffle of the arcs at every level. Up to ``WHOLE_ARCS`` arcs are cheaper to hand to every task once; a task
then searches from its own sources without hearing of the others. Larger graphs are searched by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from netloom.runtime import cut

WHOLE_ARCS = 5_000_000
#: Receivers with more arcs than this hear the rest of them in one go.
SINGLY = 64
#: Vertices that hear at once, and longs of state a search holds: what stays in fast memory.
BLOCK = 8_192
STATE_LONGS = 1 << 20
#: Arcs that paths are counted along at a time.
ARCS = 1 << 15


@dataclass(frozen=True)
class Net:
    """Vertices with an arc as ``vids`` (sorted), and arcs ``src`` → ``dst`` between positions in it, with further columns."""

    vids: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    more: tuple[np.ndarray, ...]

    @property
    def n(self) -> int:
        return len(self.vids)


def net(arcs: DataFrame) -> Net | None:
    """The arcs ``(src, dst, …)`` as arrays; none if they are too many. ``arcs`` are read twice."""
    if arcs.count() > WHOLE_ARCS:
        return None
    src, dst, *more = (c.to_numpy() for c in arcs.toArrow().columns)
    vids = np.unique(np.concatenate([src, dst]))
    return Net(vids, np.searchsorted(vids, src), np.searchsorted(vids, dst), tuple(more))


def pieces(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest position that every position is connected with."""
    root = np.arange(n)
    while True:
        a, b = root[src], root[dst]
        low, new = np.minimum(a, b), root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, root):
            return root
        root = new


def ranks(groups: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """The place 0, 1, 2 … of every position within its group, in ``order`` where given."""
    by = np.lexsort((np.arange(len(groups)) if order is None else order, groups))
    sorted_ = groups[by]
    first = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1]) if len(by) else by
    out = np.empty(len(groups), np.int64)
    out[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return out


@dataclass(frozen=True)
class Ears:
    """Whom every vertex hears: ``near[k]`` are the k-th senders of the vertices with more than k, which come first.

    Vertices are numbered by falling number of senders; ``place`` is the number of every position. A vertex with more than ``SINGLY`` senders
    has the others in ``rest``, from ``at`` on.
    """

    place: np.ndarray
    near: list[np.ndarray]
    rest: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, n: int, src: np.ndarray, dst: np.ndarray) -> Ears:
        count = np.bincount(dst, minlength=n)
        order = np.argsort(-count, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        by = np.argsort(place[dst], kind="stable")
        senders, count = place[src[by]], count[order]
        starts = np.cumsum(count) - count
        near = [senders[starts[: (count > k).sum()] + k] for k in range(min(SINGLY, int(count.max(initial=0))))]
        hubs = count[count > SINGLY] - SINGLY
        at = np.append(0, np.cumsum(hubs))
        rest = np.repeat(starts[: len(hubs)] + SINGLY - at[:-1], hubs) + np.arange(at[-1])
        return cls(place, near, senders[rest], at)

    def unite(self, bits: np.ndarray) -> np.ndarray:
        """For every vertex all bits of those it hears."""
        out = np.zeros_like(bits)
        for low in range(0, len(self.near[0]) if self.near else 0, BLOCK):
            block = out[low : low + BLOCK]
            for senders in self.near:
                if not len(some := senders[low : low + BLOCK]):
                    break
                block[: len(some)] |= bits.take(some, axis=0)
        for i, (low, high) in enumerate(zip(self.at[:-1], self.at[1:])):
            for some in range(low, high, BLOCK):
                out[i] |= np.bitwise_or.reduce(bits.take(self.rest[some : min(some + BLOCK, high)], axis=0), axis=0)
        return out

    def search(self, vertex: np.ndarray, bit: np.ndarray, words: int) -> Iterator[np.ndarray]:
        """The bits that first reach each vertex at 0, 1, 2 … hops, if ``vertex`` starts with ``bit``; until none does."""
        fresh = np.zeros((len(self.place), words), np.uint64)
        np.bitwise_or.at(fresh, (vertex, bit // 64), np.left_shift(np.uint64(1), (bit % 64).astype(np.uint64)))
        seen = np.zeros_like(fresh)
        while fresh.any():
            yield fresh
            seen |= fresh
            fresh = self.unite(fresh)
            fresh &= ~seen


def dealt(spark: SparkSession, held: object, jobs: int, run: Callable, schema: str) -> DataFrame:
    """What ``run(held, numbers)`` yields as record batches, with the jobs 0 … ``jobs`` - 1 dealt over tasks, written out."""
    told = spark.sparkContext.broadcast(cloudpickle.dumps(held))  # tasks need not find this module

    def batches(numbers: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(cloudpickle.loads(told.value), (n for batch in numbers for n in batch.column(0).to_pylist()))

    tasks = min(jobs, 3 * spark.sparkContext.defaultParallelism)
    try:
        return cut(spark.range(0, jobs, 1, tasks).mapInArrow(batches, schema))
    finally:
        told.destroy()


def _columns(*columns: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[low : low + (1 << 16)]) for c in columns], names=names)


def hop_sums(spark: SparkSession, arcs: Net, words: int) -> DataFrame:
    """``(hops, vid, far, reached)`` over the searches from all vertices along the arcs.

    A row with ``hops`` has in ``reached`` the ordered pairs so far apart, own pairs left out; one with ``vid`` the hops to
    it and the number of vertices it is reached from. Several rows of a key add up. Vertices of different components share bits.
    """
    words = max(1, min(words, STATE_LONGS // max(1, arcs.n)))
    ears = Ears.of(arcs.n, arcs.src, arcs.dst)
    order = np.empty_like(ears.place)
    order[ears.place] = np.arange(arcs.n)
    source = ranks(pieces(arcs.n, arcs.src, arcs.dst))[order]
    held = ears, arcs.vids[order], source, words

    def run(held: tuple, numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
        ears, vids, source, words = held
        pairs, far, reached = [], np.zeros(len(vids), np.int64), np.zeros(len(vids), np.int64)
        for number in numbers:
            low = number * 64 * words
            mine = np.flatnonzero((source >= low) & (source < low + 64 * words))
            for hops, fresh in enumerate(ears.search(mine, source[mine] - low, words)):
                if hops:
                    found = np.bitwise_count(fresh).sum(axis=1, dtype=np.int64)
                    far += hops * found
                    reached += found
                    pairs += [0] * (hops - len(pairs))
                    pairs[hops - 1] += int(found.sum())
        names = ["hops", "vid", "far", "reached"]
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(1, len(pairs) + 1), pa.int64()), none, none, pa.array(pairs, pa.int64())], names=names)
        for batch in _columns(vids, far, reached, names=names[1:]):
            yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), *batch.columns], names=names)

    return dealt(spark, held, -(-(int(source.max(initial=-1)) + 1) // (64 * words)), run, "hops long, vid long, far long, reached long")


def _hops(starts: np.ndarray, dst: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Hops of every vertex from the nearest root."""
    depth = np.full(len(starts) - 1, -1)
    depth[roots] = 0
    front, hops = roots, 0
    while len(front):
        hops += 1
        low = starts[front]
        count = starts[front + 1] - low
        to = dst[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        front = np.unique(to[depth[to] < 0])
        depth[front] = hops
    return depth


def _far(ears: Ears, piece: np.ndarray, sources: np.ndarray, bits: np.ndarray) -> tuple[int, np.ndarray]:
    """The longest distance from 64 sources of every piece, and a bound on the distances from each vertex.

    A vertex d hops from a source is at most d and the source's longest distance away from any other.
    """
    levels = list(ears.search(sources, bits, 1))
    by = np.argsort(piece, kind="stable")
    heads = np.flatnonzero(np.append(True, piece[by][1:] != piece[by][:-1]))
    reached = [np.bitwise_or.reduceat(fresh[by, 0], heads) for fresh in levels] + [np.zeros(len(heads), np.uint64)]
    index = np.empty(len(piece), np.int64)
    index[by] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(piece))))
    bound = np.full(len(piece), np.iinfo(np.int32).max, np.int32)
    for longest in range(len(levels)):
        ends = reached[longest] & ~reached[longest + 1]  # sources that reach no further
        if ends.any():
            ends = ends[index]
            for hops, fresh in enumerate(levels[: longest + 1]):
                near = (fresh[:, 0] & ends) != 0
                bound[near] = np.minimum(bound[near], hops + longest)
    return len(levels) - 1, bound


def diameter(spark: SparkSession, arcs: Net) -> tuple[int, int]:
    """Largest finite distance along symmetric arcs, and the most searches made in a component after the first three.

    Two searches give each component a long shortest path, a third starts in its middle. Every search bounds the distances from all vertices
    (Takes and Kosters 2011); those whose bound is above the longest distance found are searched from, 64 in each component and task at a time.
    """
    ears = Ears.of(arcs.n, arcs.src, arcs.dst)
    src, dst = ears.place[arcs.src], ears.place[arcs.dst]
    by = np.argsort(src, kind="stable")
    src, dst = src[by], dst[by]
    count = np.bincount(src, minlength=arcs.n)
    starts = np.append(0, np.cumsum(count))
    piece = pieces(arcs.n, src, dst)

    def farthest(depth: np.ndarray) -> np.ndarray:
        order = np.lexsort((np.arange(arcs.n), -depth, piece))
        return order[np.flatnonzero(np.append(True, piece[order][1:] != piece[order][:-1]))]

    best, bound = 0, np.full(arcs.n, np.iinfo(np.int32).max)
    long = np.zeros(arcs.n, np.int64)

    def searched(roots: np.ndarray) -> np.ndarray:
        nonlocal best, bound
        depth = _hops(starts, dst, roots)
        long[piece[roots]] = 0
        np.maximum.at(long, piece, depth)
        best = max(best, int(depth.max()))
        bound = np.minimum(bound, depth + long[piece])
        return depth

    ahead = searched(farthest(searched(farthest(count))))
    back = searched(farthest(ahead))
    path = long[piece]
    off = np.where(ahead + back == path, np.abs(2 * ahead - path), arcs.n)
    searched(farthest(-off))
    tasks, most, turn = spark.sparkContext.defaultParallelism, 0, 0
    told = spark.sparkContext.broadcast(cloudpickle.dumps((ears, piece)))
    draw = np.random.default_rng(0)
    try:
        while len(left := np.flatnonzero(bound > best)):
            # by turns those with most neighbours, which bound many, and those that may be farthest
            worth = count[left] if turn % 2 else bound[left]
            place = ranks(piece[left], np.lexsort((draw.random(len(left)), -worth)).argsort())
            some = place < 64 * tasks
            sources, place, turn = left[some], place[some], turn + 1
            most += int(place.max()) + 1
            parts = [(sources[here], place[here] // tasks) for k in range(tasks) if (here := np.flatnonzero(place % tasks == k)).size]
            rows = spark.sparkContext.parallelize(parts, len(parts)).map(lambda part: _far(*cloudpickle.loads(told.value), *part)).collect()
            best = max(best, *(longest for longest, _ in rows))
            for _, low in rows:
                bound = np.minimum(bound, low)
    finally:
        told.destroy()
    return best, most


@dataclass(frozen=True)
class Paths:
    """Arcs ``starts[v]`` to ``starts[v + 1]`` lead from ``v``, their ``src``, to ``dst``; each counts for as many ways as it has."""

    starts: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    ways: np.ndarray | None

    def through(self, source: int, edges: bool) -> np.ndarray:
        """What each vertex (or arc) carries of the shortest paths from the source.

        Counts of paths go forward level by level, shares come back the same way (Brandes 2001).
        """
        n = len(self.starts) - 1
        sigma, delta, due, unmet = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n, bool)
        flow = np.zeros(len(self.dst)) if edges else None
        front = np.array([source])
        sigma[source], unmet[source] = 1.0, False
        levels, steps = [front], []
        while len(front):
            step = []
            for arc in self._leaving(front):
                new = np.flatnonzero(unmet.take(self.dst.take(arc)))
                arc = arc.take(new)
                src, dst = self.src.take(arc), self.dst.take(arc)
                np.add.at(sigma, dst, sigma.take(src) if self.ways is None else sigma.take(src) * self.ways.take(arc))
                step.append((src, dst, arc if edges or self.ways is not None else None))
            if 16 * sum(len(dst) for _, dst, _ in step) < n:
                front = np.unique(np.concatenate([dst for _, dst, _ in step])) if step else front[:0]
            else:
                front = np.flatnonzero((sigma > 0) & unmet)
            unmet[front] = False
            levels.append(front)
            steps.append(step)
        for here, beyond, step in zip(levels[-2::-1], levels[:0:-1], steps[::-1]):
            due[beyond] = (1 + delta.take(beyond)) / sigma.take(beyond)
            for src, dst, arc in step:
                back = due.take(dst) if self.ways is None else due.take(dst) * self.ways.take(arc)
                np.add.at(delta, src, back)
                if edges:
                    flow[arc] = back * sigma.take(src)
            delta[here] *= sigma.take(here)
        delta[source] = 0.0
        return flow if edges else delta

    def _leaving(self, front: np.ndarray) -> Iterator[np.ndarray]:
        """The arcs that leave the front, some at a time."""
        low = self.starts.take(front)
        count = self.starts.take(front + 1) - low
        upto = np.cumsum(count)
        shift, at = low - (upto - count), 0
        while at < len(front):
            before = upto[at] - count[at]
            end = max(at + 1, int(np.searchsorted(upto, before + ARCS, side="right")))
            yield np.repeat(shift[at:end], count[at:end]) + np.arange(before, upto[end - 1])
            at = end


def path_shares(spark: SparkSession, arcs: Net, sources: np.ndarray | None, edges: bool) -> DataFrame:
    """``(vid, delta)``, or ``(v, w, flow)`` with ``edges``: what is carried of the shortest paths from the ``sources`` (default: all vertices); several rows of a key add up."""
    by = np.argsort(arcs.src, kind="stable")
    src, dst, ways = arcs.src[by], arcs.dst[by], arcs.more[0][by]
    paths = Paths(np.append(0, np.cumsum(np.bincount(src, minlength=arcs.n))), src, dst, None if (ways == 1).all() else ways.astype(float))
    sources = np.arange(arcs.n) if sources is None else np.flatnonzero(np.isin(arcs.vids, sources))
    sources = sources[paths.starts[sources + 1] > paths.starts[sources]]
    sources = sources[np.random.default_rng(0).permutation(len(sources))]  # tasks get equal shares of dear ones
    held = paths, sources, (arcs.vids[src], arcs.vids[dst]) if edges else (arcs.vids,)
    names = ["v", "w", "flow"] if edges else ["vid", "delta"]

    def run(held: tuple, numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
        paths, sources, ends = held
        total = np.zeros(len(ends[0]))
        for number in numbers:
            total += paths.through(sources[number], edges)
        carried = np.flatnonzero(total)
        yield from _columns(*(e[carried] for e in ends), total[carried], names=names)

    schema = "v long, w long, flow double" if edges else "vid long, delta double"
    return dealt(spark, held, len(sources), run, schema)
