"""Breadth-first work: hop distances, path statistics, single shortest paths."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.components import connected_components
from netloom.operators.graph import Graph, simplify
from netloom.operators.links import Links, prepare, walk_arcs, walk_links
from netloom.operators.whole import Net, diameter, hop_sums, net
from netloom.runtime import cut, dense_index, shuffle_width

STATE_ROWS = 200_000_000


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def source_batches(graph: Graph, state_rows: int = STATE_ROWS, sources: DataFrame | None = None) -> Iterator[DataFrame]:
    """Split the sources so that one batch holds about ``state_rows`` (source, vertex) rows; a source reaches its component at most."""
    sources = graph.vertices.select(F.col("vid").alias("s")) if sources is None else sources.select("s")
    rows = sources.count() * graph.vertices.count()
    if rows > state_rows:
        members = connected_components(graph)
        sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        asked = members.join(sources.withColumnRenamed("s", "vid"), "vid").groupBy("component").agg(F.count(F.lit(1)).alias("asked"))
        rows = sizes.join(asked, "component").agg(F.sum(F.col("n") * F.col("asked"))).first()[0] or 0
    batches = max(1, math.ceil(rows / state_rows))
    if batches == 1:
        yield sources
        return
    for i in range(batches):
        yield sources.where(F.pmod(F.xxhash64("s"), F.lit(batches)) == i)


def search_rows(graph: Graph, links: Links, state_rows: int = STATE_ROWS, sources: DataFrame | None = None) -> int:
    """Rows a search shuffles: the arcs, or the (source, vertex) pairs of a batch where those are more."""
    n = (graph.vertices if sources is None else sources).count()
    return max(links.n_arcs, min(n * graph.vertices.count(), state_rows))


def levels(links: Links, sources: DataFrame, symmetric: bool, carry: str | None = None) -> list[DataFrame]:
    """Frontiers ``(s, vid, d)`` of a search from every source at once, one per hop.

    With ``carry`` the number of shortest paths is counted along (as that column). In a
    symmetric graph a neighbour of hop d is at hop d−1, d or d+1, so only the last two
    frontiers can hold it; otherwise all earlier ones are checked.
    """
    start = sources.select("s", F.col("s").alias("vid"), F.lit(0).alias("d"))
    if carry:
        start = start.withColumn(carry, F.lit(1.0))
    found = [cut(start)]
    while True:
        here = found[-1]
        reached = links.send(here)
        if carry:
            reached = reached.groupBy("s", F.col("dst").alias("vid")).agg(F.sum(F.col(carry) * F.col("m")).alias(carry))
        else:
            reached = reached.select("s", F.col("dst").alias("vid")).distinct()
        seen = union_all([f.select("s", "vid") for f in (found[-2:] if symmetric else found)])
        new = reached.join(seen.hint("merge"), ["s", "vid"], "left_anti").withColumn("d", F.lit(len(found)))
        new = cut(new.select(*start.columns))
        if new.isEmpty():
            return found
        found.append(new)


def hop_distances(
    graph: Graph, sources: DataFrame | None = None, mode: str = "out", state_rows: int = STATE_ROWS
) -> Iterator[DataFrame]:
    """Batches of ``(s, vid, d)`` covering every reachable vertex of every source.

    Fold each batch before taking the next: the batches together are quadratic.
    """
    links = walk_links(graph, mode)
    symmetric = not graph.directed or mode == "all"
    spark = graph.edges.sparkSession
    try:
        with shuffle_width(spark, search_rows(graph, links, state_rows, sources)):
            for batch in source_batches(graph, state_rows, sources):
                yield union_all(levels(links, batch, symmetric))
    finally:
        links.release()


def distances_from(graph: Graph, source: int, mode: str = "out") -> DataFrame:
    """``(vid, d)`` from one vertex."""
    spark = graph.edges.sparkSession
    start = spark.createDataFrame([(source,)], "s long")
    return union_all([b for b in hop_distances(graph, start, mode)]).select("vid", "d")


#: Longs of bits a vertex carries in a search: 64 sources each. Twice as many columns, and two more, must stay within what code is generated for.
WORDS = 32


def bit_search(links: Links, start: DataFrame, words: int) -> Iterator[tuple[int, DataFrame]]:
    """Levels of a search from up to ``64 * words`` sources at once: ``(hops, state)`` until no source reaches further.

    ``start(vid, n0 …)`` gives every source a bit. ``state(vid, s0 …, n0 …, far, reached)`` has the sources that reach a vertex, those that first did
    in this level, and the sum of hops and number of sources but the vertex itself. A level unites the new bits across the arcs, so it moves one
    row an arc and keeps one row a vertex, whatever the number of sources.
    """
    new, seen = [f"n{i}" for i in range(words)], [f"s{i}" for i in range(words)]
    zero = F.lit(0).cast("long")
    state = cut(start.select("vid", *[F.col(n).alias(s) for n, s in zip(new, seen)], *new, zero.alias("far"), zero.alias("reached")))
    fresh = " or ".join(f"{n} <> 0" for n in new)
    hops = 0
    while not state.where(fresh).isEmpty():
        yield hops, state
        hops += 1
        heard = links.send(state.where(fresh).select("vid", *new)).select(F.col("dst").alias("vid"), *new)
        silent = [F.lit(None).cast("long").alias(c) for c in (*seen, "far", "reached")]
        both = heard.select("vid", *new, *silent).unionByName(state.select("vid", *[zero.alias(n) for n in new], *seen, "far", "reached"))
        met = both.groupBy("vid").agg(*[F.bit_or(n).alias(n) for n in new], *[F.max(c).alias(c) for c in (*seen, "far", "reached")])
        old = [F.coalesce(s, zero) for s in seen]
        first = [F.col(n).bitwiseAND(F.bitwise_not(o)) for n, o in zip(new, old)]
        united = met.select(
            "vid", *[o.bitwiseOR(F.col(n)).alias(s) for n, o, s in zip(new, old, seen)], *[f.alias(n) for f, n in zip(first, new)],
            F.coalesce("far", zero).alias("far"), F.coalesce("reached", zero).alias("reached"),
        )
        count = _bits(new)
        state = cut(united.select("vid", *seen, *new, (F.col("far") + hops * count).alias("far"), (F.col("reached") + count).alias("reached")))


def _bits(words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(w) for w in words]).cast("long")


def _places(graph: Graph, at_once: int) -> tuple[DataFrame, int]:
    """``(vid, place)`` of every vertex as a source, and the number of places.

    Searches of different components never meet, so they share places: each component counts its own vertices 0, 1, 2 …
    Vertices that fit one batch anyway keep their numbers, which are 0 … n - 1.
    """
    n = graph.vertices.count()
    if n <= at_once:
        return graph.vertices.select("vid", F.col("vid").alias("place")), n
    numbered = cut(dense_index(connected_components(graph), "number", "component", "vid"))
    firsts = numbered.groupBy("component").agg(F.min("number").alias("first"))
    placed = cut(numbered.join(firsts, "component").select("vid", (F.col("number") - F.col("first")).alias("place")))
    return placed, placed.agg(F.max("place")).first()[0] + 1


def _batches(graph: Graph, words: int, state_rows: int | None) -> Iterator[tuple[int, DataFrame]]:
    """Every vertex as a source, by its place: words used and starting bits of a batch."""
    if state_rows is not None:  # rows (source, vertex) that a batch stands for
        words = max(1, min(words, state_rows // max(1, 64 * graph.vertices.count())))
    placed, n = _places(graph, 64 * words)
    for low in range(0, n, 64 * words):
        used = min(words, -(-(n - low) // 64))
        place = F.col("place") - low
        sources = placed.where((place >= 0) & (place < 64 * used))
        bit = F.expr(f"shiftleft(1L, cast((place - {low}) % 64 as int))")
        yield used, sources.select("vid", *[F.when(F.floor(place / 64) == i, bit).otherwise(F.lit(0).cast("long")).alias(f"n{i}") for i in range(used)])


def all_hops(graph: Graph, mode: str = "out", words: int = WORDS, state_rows: int | None = None) -> tuple[list[tuple[int, int]], DataFrame]:
    """``(hops, pairs)`` of every level, and ``(vid, far, reached)`` over all sources.

    Exact and O(V·E) in bits: a batch of ``64 * words`` sources of every component costs as much as one search. A graph that a task
    can hold is searched inside tasks, a batch at a time; a larger one by joins.
    """
    arcs = cut(walk_arcs(graph, mode))
    held = net(arcs) if state_rows is None else None
    if held is not None:
        return _all_hops_whole(graph, held, words)
    links = prepare(arcs, settled=True)
    pairs: dict[int, int] = {}
    parts = []
    try:
        with shuffle_width(graph.edges.sparkSession, links.n_arcs):
            for used, start in _batches(graph, words, state_rows):
                last = None
                for hops, state in bit_search(links, start, used):
                    found = state.agg(F.sum(_bits([f"n{i}" for i in range(used)]))).first()[0]
                    pairs[hops] = pairs.get(hops, 0) + found
                    last = state
                parts.append(last.select("vid", "far", "reached"))
            totals = union_all(parts) if parts else graph.vertices.select("vid", F.lit(0).cast("long").alias("far"), F.lit(0).cast("long").alias("reached"))
            return sorted(pairs.items()), cut(totals.groupBy("vid").agg(F.sum("far").alias("far"), F.sum("reached").alias("reached")))
    finally:
        links.release()


def _all_hops_whole(graph: Graph, held: Net, words: int) -> tuple[list[tuple[int, int]], DataFrame]:
    n = graph.vertices.count()
    own = [(0, n)] if n else []
    zero = F.lit(0).cast("long")
    if not held.n:
        return own, graph.vertices.select("vid", zero.alias("far"), zero.alias("reached"))
    spark = graph.edges.sparkSession
    found = hop_sums(spark, held, words)
    pairs = found.where("hops is not null").groupBy("hops").agg(F.sum("reached").alias("n")).collect()  # one row per hop
    with shuffle_width(spark, n):
        sums = found.where("vid is not null").groupBy("vid").agg(F.sum("far").alias("far"), F.sum("reached").alias("reached"))
        sums = cut(graph.vertices.select("vid").join(sums, "vid", "left").select("vid", F.coalesce("far", zero).alias("far"), F.coalesce("reached", zero).alias("reached")))
    return own + sorted((r["hops"], r["n"]) for r in pairs if r["n"]), sums


def hop_histogram(graph: Graph, **kw) -> DataFrame:
    """``(d, n)``: ordered vertex pairs at each positive finite distance."""
    rows = [(d, n) for d, n in all_hops(graph, **kw)[0] if d > 0]
    return graph.edges.sparkSession.createDataFrame(rows, "d int, n long")  # one row per hop


def _members(graph: Graph) -> DataFrame:
    """``(vid, component, degree)``; a loop or a repeated edge adds nothing to the degree that counts here."""
    pairs = simplify(graph).select("src", "dst")
    ends = pairs.select(F.col("src").alias("vid")).unionByName(pairs.select(F.col("dst").alias("vid")))
    degree = ends.groupBy("vid").agg(F.count(F.lit(1)).alias("degree"))
    return cut(connected_components(graph).join(degree, "vid", "left").na.fill(0, ["degree"]))


def _search_components(links: Links, roots: DataFrame) -> DataFrame:
    """``(vid, component, d)`` from one root ``(vid, component)`` a component, all at once."""
    found = [cut(roots.select("vid", "component", F.lit(0).alias("d")))]
    while not found[-1].isEmpty():
        near = links.send(found[-1].select("vid", "component")).select(F.col("dst").alias("vid"), "component").distinct()
        new = near.join(union_all([f.select("vid") for f in found[-2:]]).hint("merge"), "vid", "left_anti")
        found.append(cut(new.select("vid", "component", F.lit(len(found)).alias("d"))))
    return union_all(found)


def _eccentricities(links: Links, sources: list[int]) -> dict[int, int]:
    """Largest finite distance from each of the ``sources``, at most ``64 * WORDS`` of them."""
    spark = links.arcs.sparkSession
    used = -(-len(sources) // 64)
    rows = []
    for i, vid in enumerate(sources):
        bits = [0] * used
        bits[i // 64] = 1 << (i % 64) if i % 64 < 63 else -(1 << 63)
        rows.append((vid, *bits))
    start = spark.createDataFrame(rows, ", ".join(["vid long", *[f"n{i} long" for i in range(used)]]))
    out = {}
    for hops, state in bit_search(links, start, used):
        still = state.agg(*[F.bit_or(f"n{i}") for i in range(used)]).first()
        for i, vid in enumerate(sources):
            if still[i // 64] >> (i % 64) & 1:
                out[vid] = hops
    return out


def exact_diameter(graph: Graph, words: int = WORDS) -> tuple[int, int]:
    """Largest finite distance of the graph, direction ignored, and the number of vertices searched from.

    Double sweep and fringe (Crescenzi et al. 2013, iFUB), in all components at once: two searches give each component a long
    shortest path, a third starts in its middle. Vertices at level i of that one are at most 2 i apart, so they are searched from
    outermost level first until the longest distance found is 2 (i - 1) or more. A component drops out when it cannot beat the best of any.
    In a graph that a task can hold, searches bound the distances from all vertices instead (see :func:`netloom.operators.whole.diameter`).
    """
    spark = graph.edges.sparkSession
    if not graph.vertices.head(1):
        return 0, 0
    held = net(cut(walk_arcs(graph, "all")))
    if held is not None:
        return diameter(spark, held) if held.n else (0, 0)
    members = _members(graph)
    links = walk_links(graph, "all")
    try:
        with shuffle_width(spark, links.n_arcs):
            order = F.struct("degree", (-F.col("vid")).alias("less"))
            roots = members.groupBy("component").agg(F.max_by("vid", order).alias("vid"))
            farthest = lambda t: t.groupBy("component").agg(F.max_by("vid", F.struct("d", (-F.col("vid")).alias("less"))).alias("vid"), F.max("d").alias("d"))
            one = cut(farthest(_search_components(links, roots)))
            ahead = cut(_search_components(links, one.select("vid", "component")))
            two = cut(farthest(ahead))
            back = _search_components(links, two.select("vid", "component")).withColumnRenamed("d", "e")
            middle = (
                ahead.join(back, ["vid", "component"])
                .join(two.select("component", F.col("d").alias("long")), "component")
                .where("d + e = long and d = long div 2")
                .groupBy("component")
                .agg(F.min("vid").alias("vid"), F.max("long").alias("long"))
            )
            hubs = cut(middle)
            levels_ = cut(_search_components(links, hubs.select("vid", "component")))
            best = hubs.agg(F.max("long")).first()[0] or 0
            searched = 0
            at = levels_.agg(F.max("d")).first()[0] or 0
            while at > 0 and best < 2 * at:
                # a component whose own levels end further in has nothing here; one that could not beat the best has been passed by
                fringe, last = levels_.where(F.col("d") == at), -1
                while best < 2 * at:
                    some = [r["vid"] for r in fringe.where(F.col("vid") > last).orderBy("vid").limit(64 * words).collect()]
                    if not some:
                        break
                    searched, last = searched + len(some), some[-1]
                    best = max(best, *_eccentricities(links, some).values())
                at -= 1
            return int(best), searched
    finally:
        links.release()


def path_measures(histogram: DataFrame) -> DataFrame:
    """One row from a hop histogram: diameter and average path length over reachable pairs."""
    return histogram.agg(
        F.coalesce(F.max("d"), F.lit(0)).alias("diameter"),
        F.round(F.try_divide(F.sum(F.col("d") * F.col("n")).cast("double"), F.sum("n").cast("double")), 4).alias("avg_path"),
    )


def neighbourhood_function(graph: Graph, mode: str = "out", precision: int = 12) -> DataFrame:
    """``(hops, pairs)``: an estimate of the ordered pairs, own pairs included, within so many hops.

    Every vertex keeps a sketch of the vertices it reaches, and a round unites the sketches across the arcs
    (Palmer et al. 2002, Boldi et al. 2011), so the state is one sketch per vertex instead of all pairs.
    With ``precision`` bits a sketch holds 2 ** precision registers and its standard error is about
    0.83 / sqrt(2 ** precision), 1.3 % at 12. Ends when no sketch reaches further.
    """
    links = walk_links(graph, "in" if mode == "out" else "out" if mode == "in" else mode)
    spark = graph.edges.sparkSession
    state = cut(graph.vertices.groupBy("vid").agg(F.hll_sketch_agg(F.col("vid").cast("bigint"), precision).alias("seen")))
    rows = []
    try:
        with shuffle_width(spark, links.n_arcs):
            while True:
                total = state.agg(F.sum(F.hll_sketch_estimate("seen"))).first()[0] or 0
                if rows and total <= rows[-1][1]:
                    break
                rows.append((len(rows), total))
                heard = links.send(state).select(F.col("dst").alias("vid"), "seen")
                state = cut(heard.unionByName(state).groupBy("vid").agg(F.hll_union_agg("seen", True).alias("seen")))
    finally:
        links.release()
    return spark.createDataFrame(rows, "hops int, pairs long")  # one row per hop


def effective_diameter(pairs: DataFrame, share: float = 0.9) -> float:
    """Hops within which ``share`` of the reachable pairs lie, between whole hops by proportion; from a neighbourhood function."""
    rows = sorted((r["hops"], r["pairs"]) for r in pairs.collect())  # one row per hop
    if not rows:
        return 0.0
    goal = share * rows[-1][1]
    before = (0, 0)
    for hops, n in rows:
        if n >= goal:
            return float(hops) if hops == 0 or n == before[1] else before[0] + (goal - before[1]) / (n - before[1]) * (hops - before[0])
        before = (hops, n)
    return float(rows[-1][0])


def sketch_closeness(graph: Graph, precision: int = 12) -> DataFrame:
    """``(vid, reached, far, closeness)`` by sketches, direction ignored: estimates in one pass of the arcs a hop (HyperBall, Boldi and Vigna 2013).

    A vertex's sketch of the vertices within t hops grows by those at t hops, so ``t`` times its growth adds up to the sum of distances.
    The state is one sketch a vertex; the error of ``reached`` is that of the sketch, see :func:`neighbourhood_function`. Isolated → −1.
    """
    links = walk_links(graph, "all")
    zero, one = (F.lit(n).cast("long") for n in (0, 1))
    start = graph.vertices.groupBy("vid").agg(F.hll_sketch_agg(F.col("vid").cast("bigint"), precision).alias("seen"))
    state = cut(start.select("vid", "seen", one.alias("size"), zero.alias("far")))
    hops, total = 0, -1
    try:
        with shuffle_width(graph.edges.sparkSession, links.n_arcs):
            while True:
                now = state.agg(F.sum("size")).first()[0] or 0
                if now <= total:
                    break
                total, hops = now, hops + 1
                unknown = F.lit(None).cast("long")
                heard = links.send(state.select("vid", "seen")).select(F.col("dst").alias("vid"), "seen", unknown.alias("size"), unknown.alias("far"))
                met = heard.unionByName(state).groupBy("vid").agg(F.hll_union_agg("seen", True).alias("seen"), F.max("size").alias("size"), F.max("far").alias("far"))
                grown = met.withColumn("now", F.greatest(F.hll_sketch_estimate("seen"), F.col("size")))
                state = cut(grown.select("vid", "seen", F.col("now").alias("size"), (F.col("far") + hops * (F.col("now") - F.col("size"))).alias("far")))
    finally:
        links.release()
    value = F.try_divide((F.col("size") - 1).cast("double"), F.col("far").cast("double"))
    return state.select("vid", (F.col("size") - 1).alias("reached"), "far", F.coalesce(F.round(value, 5), F.lit(-1.0)).alias("closeness"))


def closeness(graph: Graph, per_component: bool = True, **kw) -> DataFrame:
    """``(vid, closeness)`` ignoring direction: reached / total distance; isolated → −1.

    With ``per_component=False`` unreachable vertices count as V hops away. Distances are the same both ways, so what
    reaches a vertex stands for what it reaches.
    """
    sums = all_hops(graph, mode="all", **kw)[1]
    if per_component:
        value = F.try_divide(F.col("reached"), F.col("far"))
    else:
        v = graph.vertices.count()
        value = F.try_divide(F.lit(v - 1), F.col("far") + (v - 1 - F.col("reached")) * F.lit(v))
    return sums.select("vid", F.coalesce(F.round(value, 5), F.lit(-1.0)).alias("closeness"))


def shortest_path(graph: Graph, start: int, end: int, label: str = "name") -> DataFrame:
    """``(step, vid, label)`` along one shortest path; empty if ``end`` cannot be reached.

    Two searches, forward from the start and backward from the end, advance in turn until
    they touch, so neither walks the whole graph. Among equal paths the one through the
    smallest vertex ids is taken, step by step from the start.
    """
    spark = graph.edges.sparkSession
    if label not in graph.vertices.columns:
        label = "name"
    ids = _meet(graph, start, end)
    steps = spark.createDataFrame(list(enumerate(ids)), "step int, vid long")
    names = graph.vertices.select("vid", F.col(f"`{label}`").cast("string").alias("label"))
    return names.join(F.broadcast(steps), "vid").select("step", "vid", "label").orderBy("step")


def _meet(graph: Graph, start: int, end: int) -> list[int]:
    spark = graph.edges.sparkSession
    if graph.vertices.where(F.col("vid").isin(start, end)).count() < len({start, end}):
        raise ValueError(f"vertex {start} or {end} is not in the graph")
    if start == end:
        return [start]
    out = walk_links(graph, "out")
    back = walk_links(graph, "in") if graph.directed else out
    one = "vid long"
    ahead, behind = ([cut(spark.createDataFrame([(v,)], one))] for v in (start, end))
    sizes = [1, 1]
    try:
        with shuffle_width(spark, out.n_arcs):
            while not ahead[-1].join(behind[-1], "vid", "left_semi").take(1):
                side = 0 if sizes[0] <= sizes[1] else 1
                found, links = ((ahead, out), (behind, back))[side]
                new = links.send(found[-1]).select(F.col("dst").alias("vid")).distinct()
                new = cut(new.join(union_all(found), "vid", "left_anti"))
                sizes[side] = new.count()
                if not sizes[side]:
                    return []
                found.append(new)
            return _walk(out, back, ahead, behind)
    finally:
        out.release()
        back.release()


def _walk(out: Links, back: Links, ahead: list[DataFrame], behind: list[DataFrame]) -> list[int]:
    """Smallest-id path through the touching searches, one vertex per hop.

    ``on_path[i]`` are the vertices at hop i that lie on some shortest path: the touching
    set first, then back towards the start and on towards the end.
    """
    middle = cut(ahead[-1].join(behind[-1], "vid", "left_semi"))
    on_path = [middle]
    for frontier in reversed(ahead[:-1]):
        near = back.send(on_path[0]).select(F.col("dst").alias("vid"))
        on_path.insert(0, cut(frontier.join(near, "vid", "left_semi")))
    for frontier in reversed(behind[:-1]):
        near = out.send(on_path[-1]).select(F.col("dst").alias("vid"))
        on_path.append(cut(frontier.join(near, "vid", "left_semi")))
    path = [on_path[0].first()["vid"]]
    for hop in on_path[1:]:
        here = hop.sparkSession.createDataFrame([(path[-1],)], "vid long")
        near = out.send(here).select(F.col("dst").alias("vid"))
        path.append(near.join(hop, "vid", "left_semi").agg(F.min("vid")).first()[0])
    return path
