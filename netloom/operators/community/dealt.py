"""Rounds on a level that tasks can hold: the arcs are handed out once, a round is one job over slices of the vertices.

A task hears and rates for its slice; who moves is settled on the driver, which holds a number per vertex. Hashes and sums
are those of the rounds by joins, so both find the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netloom.operators.community.levels import Level
from netloom.operators.whole import WHOLE_ARCS
from netloom.runtime import cut

EPSILON = 1e-9
#: Vertices rated at a time.
ROWS = 4_096

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _ended(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def hash_long(value: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """As ``xxhash64`` of bigints, after what is in the seed."""
    seed = np.asarray(seed, np.uint64)
    h = (seed + _P5 + np.uint64(8)) ^ (_turned(np.asarray(value).astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
    return _ended(_turned(h, 27) * _P1 + _P4)


def hash_int(value: int, seed: np.ndarray) -> np.ndarray:
    """As ``xxhash64`` of one int, after what is in the seed."""
    h = (seed + _P5 + np.uint64(4)) ^ (np.array([value & 0xFFFFFFFF], np.uint64) * _P1)
    return _ended(_turned(h, 23) * _P2 + _P3)


def tossed(bits: np.ndarray) -> np.ndarray:
    """As ``coin`` of what was hashed."""
    return ((bits >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def fits(level: Level) -> bool:
    return level.links.n_arcs <= WHOLE_ARCS and level.nodes.count() <= WHOLE_ARCS


def _last_of(groups: np.ndarray) -> np.ndarray:
    """Where the last of equal neighbours stand."""
    return np.flatnonzero(np.append(groups[1:] != groups[:-1], True)) if len(groups) else np.array([], int)


def _best(v: np.ndarray, c: np.ndarray, rated: np.ndarray, names: np.ndarray, salt: int) -> np.ndarray:
    """Of options sorted by ``v`` the best of each: rated highest, then by hash and name."""
    starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    top = np.repeat(np.maximum.reduceat(rated, starts), np.diff(np.append(starts, len(v))))
    some = np.flatnonzero(rated == top)
    name = names[c[some]]
    some = some[np.lexsort((name, hash_int(salt, hash_long(name)).view(np.int64), v[some]))]
    return some[_last_of(v[some])]


def _met(v: np.ndarray, c: np.ndarray, w: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(v, c)`` with the sum of ``w``, sorted."""
    key = v * kinds + c
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] // kinds, key[first] % kinds, np.add.reduceat(w[by], first)


def _look(part: tuple, at: np.ndarray, totals: np.ndarray, names: np.ndarray, salt: int, heat: float, rate: float) -> tuple:
    """Where each vertex of the slice wants to be, of the communities it hears of."""
    low, vids, m, dst, src, w = part
    mine, rows = at[low : low + len(vids)], np.arange(len(vids))
    v, c, w = _met(np.concatenate([dst, rows]), np.concatenate([at[src], mine]), np.concatenate([w, np.zeros(len(rows))]), len(names))
    here = c == mine[v]
    rated = w - rate * m[v] * (totals[c] - here * m[v])
    best = _best(v, c, rated, names, salt)
    return _wanted(low, vids, m, mine, c[best], rated[best], rated[here], w[here], totals, salt)


def _wanted(low: int, vids: np.ndarray, m: np.ndarray, mine: np.ndarray, best: np.ndarray, rated: np.ndarray, home: np.ndarray, w: np.ndarray, totals: np.ndarray, salt: int) -> tuple:
    wants = np.flatnonzero((rated > home + EPSILON) & (best != mine))
    free = tossed(hash_int(7, hash_int(salt, hash_long(vids[wants])))) < 0.5
    return low + wants, best[wants], rated[wants] - home[wants], free, w.sum(), (m * totals[mine]).sum()


def _spin_look(part: tuple, at: np.ndarray, totals: np.ndarray, names: np.ndarray, salt: int, heat: float, rate: float) -> tuple:
    """As :func:`_look` with all spins offered, and a noise by the heat."""
    low, vids, m, dst, src, w = part
    mine, spins = at[low : low + len(vids)], len(totals)
    tie = hash_int(salt, hash_long(names)).view(np.int64)
    first = np.lexsort((names, tie))[::-1]  # of spins rated the same the first is taken
    best, rated_best, home, inside = (np.empty(len(vids), kind) for kind in (np.int64, float, float, float))
    for i in range(0, len(vids), ROWS):
        some, own = slice(i, i + ROWS), mine[i : i + ROWS]
        rows = np.arange(len(own))
        a, b = np.searchsorted(dst, (i, i + ROWS))
        ws = np.bincount((dst[a:b] - i) * spins + at[src[a:b]], w[a:b], len(own) * spins).reshape(-1, spins)
        rest = np.repeat(totals[None, :], len(own), axis=0)
        rest[rows, own] -= m[some]
        rated = ws - (rate * m[some])[:, None] * rest
        if heat > 0:
            rated -= heat * np.log(-np.log(tossed(hash_int(salt, hash_long(names[None, :], hash_long(vids[some])[:, None])))))
        best[some] = first[rated[:, first].argmax(axis=1)]
        rated_best[some], home[some], inside[some] = rated[rows, best[some]], rated[rows, own], ws[rows, own]
    return _wanted(low, vids, m, mine, best, rated_best, home, inside, totals, salt)


def _join(part: tuple, community: np.ndarray, group: np.ndarray, totals: np.ndarray, head: np.ndarray, names: np.ndarray, salt: int, rate: float) -> tuple:
    """Which group of its community every tail of the slice joins."""
    low, _, m, dst, src, w = part
    heard = np.flatnonzero(head[src] & ~head[low + dst] & (community[src] == community[low + dst]))
    if not len(heard):
        return heard, heard
    v, c, w = _met(dst[heard], group[src[heard]], w[heard], len(names))
    gain = w - rate * m[v] * totals[c]
    good = np.flatnonzero(gain > EPSILON)
    if not len(good):
        return good, good
    v, c = v[good], c[good]
    best = _best(v, c, gain[good], names, salt)
    return low + v[best], c[best]


class Dealt:
    """A level's vertices ``vids`` (sorted) with their masses ``m``, dealt in slices over the tasks along with the arcs that lead to them."""

    def __init__(self, level: Level, mass: str):
        self.spark = level.nodes.sparkSession
        self.context = self.spark.sparkContext
        vids, m = (c.to_numpy() for c in level.nodes.select("vid", mass).toArrow().columns)
        by = np.argsort(vids)
        self.vids, self.m = vids[by], m[by].astype(float)
        src, dst, w = (c.to_numpy() for c in level.links.arcs.select("src", "dst", "w").toArrow().columns)
        src, dst = np.searchsorted(self.vids, src), np.searchsorted(self.vids, dst)
        by = np.argsort(dst, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(dst, minlength=len(vids))))
        self.tasks = max(1, min(self.context.defaultParallelism, len(vids) // ROWS))
        ends = np.linspace(0, len(vids) + len(dst), self.tasks + 1)
        bounds = np.searchsorted(starts + np.arange(len(vids) + 1), ends)
        self._told = self.context.broadcast((self.vids, self.m, src[by], dst[by], w[by].astype(float), starts, bounds))

    def round(self, run: Callable, *state) -> list[tuple]:
        """``run(slice, *state)`` for every slice, in their order; one job."""
        told, now = self._told, self.context.broadcast(state)

        def each(numbers):
            vids, m, src, dst, w, starts, bounds = told.value
            for k in numbers:
                low, high = bounds[k], bounds[k + 1]
                arcs = slice(starts[low], starts[high])
                yield run((low, vids[low:high], m[low:high], dst[arcs] - low, src[arcs], w[arcs]), *now.value)

        try:
            return self.context.parallelize(range(self.tasks), self.tasks).mapPartitions(each).collect()
        finally:
            now.destroy()

    def aligned(self, member: DataFrame, column: str) -> np.ndarray:
        """The column by vertex."""
        vids, values = (c.to_numpy() for c in member.select("vid", column).toArrow().columns)
        return values[np.argsort(vids)]

    def frame(self, **columns: np.ndarray) -> DataFrame:
        """``(vid, …)``, written out."""
        return cut(self.spark.createDataFrame(pa.table({"vid": self.vids, **columns})))

    def release(self) -> None:
        self._told.destroy()


def _apart(who: np.ndarray, a: np.ndarray, b: np.ndarray, gain: np.ndarray, vids: np.ndarray) -> np.ndarray:
    """Which of the moves are the best of both communities they touch."""
    move = np.tile(np.arange(len(who)), 2)
    touched = np.concatenate([a, b])
    tie = hash_long(vids[who]).view(np.int64)
    by = np.lexsort((vids[who][move], tie[move], gain[move], touched))
    last = by[_last_of(touched[by])]
    return np.flatnonzero(np.bincount(move[last], minlength=len(who)) == 2)


def settle(level: Level, goal, member: DataFrame, seed: int, heats: list[float], spins: int | None, most: int, patience: int) -> tuple[DataFrame, float, bool]:
    """The rounds of ``moves._settle``."""
    dealt = Dealt(level, goal.mass)
    names = np.arange(spins) if spins else None
    at = dealt.aligned(member, "community")
    if names is None:
        names, at = np.unique(at, return_inverse=True)
    best, best_quality, stale, moved, careful = at, -float("inf"), 0, False, False
    try:
        for turn in range(len(heats) + most):
            heat = heats[turn] if turn < len(heats) else 0.0
            totals = np.bincount(at, dealt.m, len(names))
            told = dealt.round(_spin_look if spins else _look, at, totals, names, seed * 1009 + turn, heat, goal.rate)
            who, to, gain, free = (np.concatenate(c) for c in list(zip(*told))[:4])
            quality = float(sum(t[4] for t in told)) + level.inner - goal.rate * float(sum(t[5] for t in told))
            if quality > best_quality + EPSILON:
                best, best_quality, stale = at, quality, 0
                moved = moved or turn > 0
            elif not heat:
                stale += 1
            if not heat:
                if not len(who) and quality >= best_quality - EPSILON:
                    return dealt.frame(community=names[best]), best_quality, moved
                if not careful and (stale >= patience or not len(who)):
                    careful, at = True, best
                    continue
            goes = _apart(who, at[who], to, gain, dealt.vids) if careful else np.flatnonzero(free)
            at = at.copy()
            at[who[goes]] = to[goes]
    finally:
        dealt.release()
    raise RuntimeError(f"moves did not settle in {most} rounds")


def refine(level: Level, goal, member: DataFrame, seed: int, most: int, patience: int) -> DataFrame:
    """The rounds of ``moves._refine``."""
    dealt = Dealt(level, goal.mass)
    community = dealt.aligned(member, "community")
    group, idle = np.arange(len(dealt.vids)), 0
    try:
        for turn in range(most):
            salt = seed * 2003 + turn
            head = (np.bincount(group, minlength=len(group))[group] > 1) | (tossed(hash_int(salt, hash_long(dealt.vids))) < 0.5)
            told = dealt.round(_join, community, group, np.bincount(group, dealt.m, len(group)), head, dealt.vids, salt, goal.rate)
            who, to = (np.concatenate(c) for c in zip(*told))
            group = group.copy()
            group[who] = to
            idle = 0 if len(who) else idle + 1
            if idle == patience:
                return dealt.frame(community=community, part=dealt.vids[group])
    finally:
        dealt.release()
    raise RuntimeError(f"refinement did not settle in {most} rounds")
