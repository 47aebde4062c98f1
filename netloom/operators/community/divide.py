"""Top-down splitting: leading eigenvectors and edge betweenness."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.centrality import edge_betweenness
from netloom.operators.community.levels import base_level, coin, own
from netloom.operators.community.quality import modularity
from netloom.operators.components import connected_components, relabel
from netloom.operators.graph import Graph, simplify
from netloom.operators.links import both_ways, prepare
from netloom.runtime import cut, dense_index, running_total, scratch_path, shuffle_width

EPSILON = 1e-9
STEPS = 6
MAX_CYCLES = 500
SETTLED = 1e-4
#: Communities of up to this many arcs and vertices are split to the end in one task.
COMMUNITY_ARCS = 50_000
#: Components of up to this many vertices and edges lose their edges in one task, which holds a few tables of vertices by vertices.
WHOLE_VERTICES = 256
WHOLE_EDGES = 16_384
#: Removals that one task makes.
REMOVALS_A_TASK = 2_000


def _ritz(products: pd.DataFrame) -> pd.DataFrame:
    """Weights of the basis vectors in the leading vector of one community's modularity matrix.

    Gets one row of inner products per community: basis · basis, basis · A basis, basis · degree.
    """
    row = products.iloc[0]
    size = int(row["size"])
    gram = np.array(row["gram"]).reshape(size, size)
    action = np.array(row["action"]).reshape(size, size)
    value, weights = _leading(gram, action, np.array(row["pull"]), row["total"])
    return pd.DataFrame({"community": [row["community"]], "value": [value], "weights": [list(map(float, weights))]})


def _leading(gram: np.ndarray, action: np.ndarray, pull: np.ndarray, total: float) -> tuple[float, np.ndarray]:
    """The largest value and its vector's weights, of a basis given by its inner products."""
    matrix = (action + action.T) / 2 - np.outer(pull, pull) / total
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    gram, matrix = gram / np.outer(scale, scale), matrix / np.outer(scale, scale)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-10 * values.max()
    frame = vectors[:, keep] / np.sqrt(values[keep])
    inner, turn = np.linalg.eigh(frame.T @ matrix @ frame)
    return inner[-1], frame @ turn[:, -1] / scale


def _inside(level, state: DataFrame) -> DataFrame:
    """``(src, dst, w, community)``: the arcs that stay in a community."""
    here = state.select("vid", "community")
    theirs = here.select(F.col("vid").alias("dst"), F.col("community").alias("_c"))
    return cut(level.links.send(here).join(theirs, "dst").where("community = _c").select(F.col("vid").alias("src"), "dst", "w", "community"))


def _leading_vectors(level, state: DataFrame, inside: DataFrame, seed: int) -> DataFrame:
    """``(vid, community, mass, x)`` with x the leading vector of each community's matrix.

    The basis is A-powers of the current guess and of the degrees, both carried along the
    community's own arcs; the rank-one degree term then only enters the small inner products,
    so no community-wide sum is needed between steps.
    """
    degree_in = inside.groupBy("src").agg(F.sum("w").alias("within")).withColumnRenamed("src", "vid")
    masses = state.groupBy("community").agg(F.sum("mass").alias("group_mass"))
    # diagonal of the community's matrix: within-degree minus what chance would give
    drag = cut(
        state.join(degree_in, "vid", "left").join(masses, "community").select(
            "vid", "community", "mass",
            (F.coalesce("within", F.lit(0.0)) - F.col("mass") * F.col("group_mass") / level.total).alias("drag"),
        )
    )
    self_arcs = drag.select(F.col("vid").alias("src"), F.col("vid").alias("dst"), (-F.col("drag")).alias("w"), F.lit(True).alias("own"))
    links = prepare(inside.select("src", "dst", "w", F.lit(False).alias("own")).unionByName(self_arcs))
    reach = drag.agg(F.max(F.col("mass") + F.abs("drag"))).first()[0] or 1.0
    current = drag.select("vid", "community", "mass", (coin("vid", F.lit(seed)) - 0.5).alias("x"))
    width = 2 * STEPS
    last = None
    for _ in range(MAX_CYCLES):
        walk = current.select("vid", "community", "mass", F.col("x").alias("v0"), (F.col("mass") / reach).alias("u0"))
        for i in range(STEPS):
            keep = [F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in ["community", "mass"] + [f"{t}{j}" for t in "vu" for j in range(i + 1)]]
            new = [F.sum(F.col(f"{t}{i}") * F.col("w") / reach).alias(f"{t}{i + 1}") for t in "vu"]
            walk = links.send(walk).groupBy(F.col("dst").alias("vid")).agg(*keep, *new)
        walk = cut(walk)
        basis = [f"{t}{i}" for t in "vu" for i in range(STEPS)]
        image = [f"{t}{i + 1}" for t in "vu" for i in range(STEPS)]
        sums = [F.sum(F.col(a) * F.col(b)) for a in basis for b in basis]
        acts = [F.sum(F.col(a) * F.col(b)) * reach for a in basis for b in image]
        pulls = [F.sum(F.col(a) * F.col("mass")) for a in basis]
        products = walk.groupBy("community").agg(
            F.array(*sums).alias("gram"), F.array(*acts).alias("action"), F.array(*pulls).alias("pull")
        ).select("*", F.lit(width).alias("size"), F.lit(level.total).alias("total"))
        solved = cut(
            products.groupBy("community").applyInPandas(_ritz, "community long, value double, weights array<double>")
        )
        mixed = sum((F.col(c) * F.col("weights")[i] for i, c in enumerate(basis)), F.lit(0.0))
        current = walk.join(solved, "community").select("vid", "community", "mass", mixed.alias("x"))
        # every community must have settled, however small its share of the total is
        if last is not None:
            was = last.select("community", F.col("value").alias("was"))
            moving = F.abs(F.col("value") - F.col("was")) > SETTLED * F.greatest(F.lit(1.0), F.abs("value"))
            if solved.join(was, "community").where(moving).isEmpty():
                links.release()
                return current
        last = solved
    raise RuntimeError(f"leading vectors did not settle in {MAX_CYCLES} cycles")


def leading_eigenvector(graph: Graph, seed: int = 0, weight: str | None = None) -> DataFrame:
    """Split communities by the sign of their leading modularity vector (Newman 2006).

    All communities that may still split are worked on together, keyed by community; one stops
    when its split would not raise modularity. Small ones are split to the end by one task each.
    """
    level = base_level(graph, weight)
    member = cut(own(level.nodes).withColumn("community", F.lit(0).cast("bigint")))
    if not level.total:
        return relabel(own(level.nodes))
    with shuffle_width(graph.edges.sparkSession, level.links.n_arcs):
        open_part = cut(level.nodes.where("mass > 0").select("vid", "mass", F.lit(0).cast("bigint").alias("community")))
        # isolated vertices belong to nobody
        alone = level.nodes.where("mass = 0").select("vid", (-1 - F.col("vid")).alias("community"))
        closed = [alone]
        turn, following = 0, 1
        while True:
            inside = _inside(level, open_part)
            open_part, inside, done = _split_small(open_part, inside, level.total, seed + turn)
            closed.append(done)
            if open_part.isEmpty():
                break
            sides = _leading_vectors(level, open_part, inside, seed + turn)
            sided = cut(sides.withColumn("side", F.when(F.col("x") > 0, 1).otherwise(0)))
            gains = _split_gain(level, sided)
            good = cut(gains.where(F.col("gain") > EPSILON).select("community"))
            closed.append(cut(sided.join(good, "community", "left_anti").select("vid", "community")))
            if good.isEmpty():
                break
            # halves get numbers not used before
            numbers = cut(dense_index(good, "_n", "community"))
            open_part = cut(
                sided.join(numbers, "community").select(
                    "vid", "mass", (F.col("_n") * 2 + following + F.col("side")).alias("community")
                )
            )
            turn, following = turn + 1, following + 2 * numbers.count()
    level.links.release()
    member = closed[0]
    for part in closed[1:]:
        member = member.unionByName(part)
    return relabel(cut(member))


def _split_small(state: DataFrame, inside: DataFrame, total: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices and arcs of communities that are large still, and ``(vid, community)`` of what the others came to."""
    arcs = inside.groupBy("community").agg(F.count(F.lit(1)).alias("arcs"))
    sizes = state.groupBy("community").agg(F.count(F.lit(1)).alias("n")).join(arcs, "community", "left")
    large = cut(sizes.where(F.greatest("n", F.coalesce("arcs", F.lit(0))) > COMMUNITY_ARCS).select("community"))
    schema = "vid bigint, community bigint"

    def split(people: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        people = people.sort_values("vid")
        vids = people["vid"].to_numpy()
        src, dst = np.searchsorted(vids, links["src"]), np.searchsorted(vids, links["dst"])
        parts = _split_whole(vids, people["mass"].to_numpy(), src, dst, links["w"].to_numpy(), total, seed)
        names = [np.full(len(p), -1 - vids[p].min()) for p in parts]  # distributed communities are numbered from 0 on
        return pd.DataFrame({"vid": vids[np.concatenate(parts)], "community": np.concatenate(names)})

    few, near = (x.join(large, "community", "left_anti") for x in (state, inside))
    done = cut(few.groupBy("community").cogroup(near.groupBy("community")).applyInPandas(split, schema))
    return cut(state.join(large, "community", "left_semi")), inside.join(large, "community", "left_semi"), done


def _coins(vids: np.ndarray, seed: int) -> np.ndarray:
    """As :func:`coin` of the vertex and the seed."""
    bits = [xxhash.xxh64_intdigest(int(seed).to_bytes(4, "little", signed=True), xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), 42)) for v in vids]
    return ((np.array(bits, np.uint64) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _split_whole(vids: np.ndarray, mass: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, total: float, seed: int) -> list[np.ndarray]:
    """Positions of the vertices of every community that this one is split into; those open at a time settle together."""
    done, open_ = [], [np.arange(len(vids))]
    while open_:
        arcs = []
        for part in open_:
            place = np.full(len(vids), -1)
            place[part] = np.arange(len(part))
            held = (place[src] >= 0) & (place[dst] >= 0)
            arcs.append((place[src[held]], place[dst[held]], w[held]))
        runs = [_cycles(_coins(vids[p], seed) - 0.5, mass[p], *near, total) for p, near in zip(open_, arcs, strict=True)]
        last = None
        for _ in range(MAX_CYCLES):
            values, vectors = zip(*map(next, runs), strict=True)
            if last and all(abs(v - was) <= SETTLED * max(1.0, abs(v)) for v, was in zip(values, last, strict=True)):
                break
            last = values
        else:
            raise RuntimeError(f"leading vectors did not settle in {MAX_CYCLES} cycles")
        halves = []
        for part, (a, b, weight), x in zip(open_, arcs, vectors, strict=True):
            up = x > 0
            gain = mass[part][up].sum() * mass[part][~up].sum() / total - weight[up[a] != up[b]].sum() / 2
            if gain > EPSILON:
                halves += [part[up], part[~up]]
            else:
                done.append(part)
        open_, seed = halves, seed + 1
    return done


def _cycles(x: np.ndarray, mass: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, total: float) -> Iterator[tuple[float, np.ndarray]]:
    """The leading value and vector of one community's matrix after each cycle, by the steps of :func:`_leading_vectors`."""
    n = len(mass)
    drag = np.bincount(src, w, n) - mass * mass.sum() / total
    reach = (mass + np.abs(drag)).max() or 1.0
    while True:
        walks = []
        for start in (x, mass / reach):
            walk = [start]
            for _ in range(STEPS):
                walk.append((np.bincount(dst, walk[-1][src] * w, n) - drag * walk[-1]) / reach)
            walks.append(walk)
        basis = np.array([v for walk in walks for v in walk[:-1]])
        image = np.array([v for walk in walks for v in walk[1:]])
        value, weights = _leading(basis @ basis.T, basis @ image.T * reach, basis @ mass, total)
        x = weights @ basis
        yield value, x


def _split_gain(level, sided: DataFrame) -> DataFrame:
    """``(community, gain)``: weight the split cuts against what chance would have joined."""
    theirs = sided.select(F.col("vid").alias("dst"), F.col("community").alias("_c"), F.col("side").alias("_s"))
    crossing = (
        level.links.send(sided.select("vid", "community", "side"))
        .join(theirs, "dst")
        .where("community = _c and side <> _s")
        .groupBy("community")
        .agg((F.sum("w") / 2).alias("crossing"))
    )
    masses = sided.groupBy("community").agg(
        F.sum(F.when(F.col("side") == 1, F.col("mass")).otherwise(0.0)).alias("a"),
        F.sum(F.when(F.col("side") == 0, F.col("mass")).otherwise(0.0)).alias("b"),
    )
    chance = F.col("a") * F.col("b") / level.total
    return masses.join(crossing, "community", "left").select(
        "community", (chance - F.coalesce("crossing", F.lit(0.0))).alias("gain")
    )


def edge_removal(
    graph: Graph, batch: int = 1, pivots: int | None = None
) -> DataFrame:
    """Remove the edges most shortest paths use and keep the best components (Girvan and Newman 2002).

    ``batch`` edges go per round (1 is the original), down to the last edge; only components that lost an
    edge are measured again.
    """
    if batch == 1:
        return _one_by_one(graph, pivots)
    pairs = cut(simplify(graph))
    member = cut(connected_components(graph).withColumnRenamed("component", "community"))
    best, best_quality = member, modularity(graph, member).first()[0]
    scores = None
    while not pairs.isEmpty():
        if scores is None:
            scores = cut(_scores(graph, pairs, pivots))
        top = cut(scores.orderBy(F.desc("betweenness"), "src", "dst").limit(batch))
        touched = top.select(F.col("src").alias("vid")).distinct().join(member, "vid").select("community").distinct()
        pairs = cut(pairs.join(top, ["src", "dst"], "left_anti"))
        rest = scores.join(top, ["src", "dst"], "left_anti")
        hit = cut(member.join(touched, "community", "left_semi"))
        part = pairs.join(hit.select(F.col("vid").alias("src")), "src", "left_semi")
        piece = Graph(hit.select("vid"), cut(part), False)
        split = connected_components(piece).withColumnRenamed("component", "community")
        member = cut(member.join(hit.select("vid"), "vid", "left_anti").unionByName(split.select("vid", "community").select(*member.columns)))
        scores = cut(
            rest.join(hit.select(F.col("vid").alias("src")), "src", "left_anti")
            .select("src", "dst", "betweenness")
            .unionByName(_scores(graph, piece.edges, pivots, piece.vertices))
        )
        quality = modularity(graph, member).first()[0]
        if quality > best_quality + EPSILON:
            best, best_quality = member, quality
    return relabel(best)


def _one_by_one(graph: Graph, pivots: int | None) -> DataFrame:
    """One edge after the other, with every component's next removal made in the same round.

    Components do not touch each other, so each loses its edges in the same order whatever the others do. When
    the removal of all edges by turns would get to one follows from its ``path``: the
    removals before it in its component that were held back longest (the later ones of lower betweenness), up to itself. Removals
    happen in the order of their paths. Modularity only changes where a component splits, and is
    summed up over the splits in that order; the best moment decides which components are returned.
    """
    spark = graph.edges.sparkSession
    pairs = cut(simplify(graph))
    m = pairs.count()
    step = F.struct((-F.col("betweenness")).alias("held"), "src", "dst")
    none = F.array().cast("array<struct<held:double,src:bigint,dst:bigint>>")
    member = cut(connected_components(graph).select("vid", F.col("component").alias("community"), none.alias("path")))
    if not m:
        return relabel(member.select("vid", "community"))
    # every vertex's communities and the removals that made them
    history = scratch_path(spark, "history")
    member.select(F.array("vid").alias("vids"), "community", "path").write.parquet(history)
    degree = cut(both_ways(pairs).groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("d")))

    def shares(members: DataFrame, by: str) -> DataFrame:
        """``(community, by, q)``: what communities add to modularity; edges between two of them count for none."""
        ends = all_pairs.join(members.select(F.col("vid").alias("src"), F.col("community").alias("_a")), "src").join(
            members.select(F.col("vid").alias("dst"), F.col("community").alias("_b")), "dst"
        )
        inner = ends.where("_a = _b").groupBy(F.col("_a").alias("community")).agg(F.count(F.lit(1)).alias("inner"))
        mass = members.join(degree, "vid").groupBy("community", by).agg(F.sum("d").alias("d"))
        return mass.join(inner, "community", "left").select(
            "community", by, (F.coalesce("inner", F.lit(0)) / F.lit(float(m)) - (F.col("d") / F.lit(2.0 * m)) ** 2).alias("q")
        )

    all_pairs, splits, any_split = pairs, scratch_path(spark, "splits"), False
    people = graph.vertices
    fresh = pivots is None
    while not pairs.isEmpty():
        if fresh:  # components that came into being and are small need no further rounds
            pairs, member, told = _hand_over(all_pairs, pairs, member, degree, m)
            if told is not None:
                told.where("gain is null").select("vids", "community", "path").write.mode("append").parquet(history)
                told.where("gain is not null").select("path", "gain").write.mode("append").parquet(splits)
                any_split, people, fresh = True, member, False
                continue
        fresh = False
        scores = cut(_scores(graph, pairs, pivots, people))
        placed = scores.join(member.select(F.col("vid").alias("src"), "community"), "src")
        top = cut(placed.groupBy("community").agg(F.min(step).alias("top")))
        gone = top.select("top.src", "top.dst")
        pairs = cut(pairs.join(gone, ["src", "dst"], "left_anti"))
        # components without edges are done
        hit = cut(
            member.join(top, "community").select(
                "vid", "community", F.expr("concat(filter(path, x -> x > top), array(top))").alias("path")
            )
        )
        piece = Graph(hit.select("vid"), pairs, False)
        found = connected_components(piece)
        member = cut(hit.withColumnRenamed("community", "was").join(found, "vid").withColumnRenamed("component", "community"))
        parts = member.groupBy("was").agg(F.count_distinct("community").alias("n")).where("n > 1").select("was")
        changed = cut(member.join(parts, "was"))
        if not changed.isEmpty():
            changed.select(F.array("vid").alias("vids"), "community", "path").write.mode("append").parquet(history)
            before = shares(changed.select("vid", F.col("was").alias("community"), "path"), "path").select("path", (-F.col("q")).alias("q"))
            after = shares(changed, "path").select("path", "q")
            before.unionByName(after).groupBy("path").agg(F.sum("q").alias("gain")).write.mode("append").parquet(splits)
            any_split, fresh = True, pivots is None
        member = people = member.select("vid", "community", "path")
    told = spark.read.parquet(history)
    best = None
    if any_split:
        gains = spark.read.parquet(splits)
        summed = running_total(gains, "path", "gain").select("path", F.round("upto", 9).alias("upto"))
        # of equal moments the first
        top = summed.groupBy("upto").agg(F.min("path").alias("path")).orderBy(F.desc("upto")).first()
        best = top["path"] if top["upto"] > EPSILON else None
    if best is None:
        told = told.where(F.size("path") == 0)
    else:
        moment = spark.createDataFrame([(best,)], "moment array<struct<held:double,src:bigint,dst:bigint>>")
        told = told.crossJoin(F.broadcast(moment)).where("path <= moment")
    told = told.select(F.explode("vids").alias("vid"), "community", "path")
    return relabel(told.groupBy("vid").agg(F.max_by("community", "path").alias("community")))


_PATH = "array<struct<held:double,src:bigint,dst:bigint>>"
_TOLD = f"vids array<bigint>, community bigint, path {_PATH}, gain double"
_TOLD_PATH = pa.list_(pa.struct([("held", pa.float64()), ("src", pa.int64()), ("dst", pa.int64())]))


def _hand_over(all_pairs: DataFrame, pairs: DataFrame, member: DataFrame, degree: DataFrame, m: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The edges and members of components that are large still, and what became of the others.

    That is a row (vids, community, path) for every part that split off, and one (path, gain) for every split. A component's
    edges, those removed before included, stand in one row: the bound on its size is one on the row.
    """
    homes = member.select(F.col("vid").alias("src"), "community")
    ends = all_pairs.join(homes, "src").join(homes.toDF("dst", "_c"), "dst").where("community = _c").select("src", "dst", "community")
    inner = cut(ends.join(pairs.select("src", "dst", F.lit(True).alias("left")), ["src", "dst"], "left").select("src", "dst", "community", F.coalesce("left", F.lit(False)).alias("left")))
    edges = inner.groupBy("community").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("left").alias("n_left")).where("n_left > 0")
    sizes = cut(member.groupBy("community").agg(F.count(F.lit(1)).alias("n")).join(edges, "community"))
    small = sizes.where((F.col("n") <= WHOLE_VERTICES) & (F.col("n_edges") <= WHOLE_EDGES))
    removals = small.agg(F.sum("n_left")).first()[0]
    if not removals:
        return pairs, member, None
    small = small.select("community")
    links = inner.join(small, "community", "left_semi").groupBy("community").agg(F.collect_list(F.struct("src", "dst", "left")).alias("edges"))
    people = member.join(small, "community", "left_semi").join(degree, "vid").groupBy("community").agg(
        F.first("path").alias("path"), F.collect_list(F.struct("vid", "d")).alias("people")
    )
    # few bytes stand for much work, so the number of tasks is given
    tasks = max(all_pairs.sparkSession.sparkContext.defaultParallelism, -(-removals // REMOVALS_A_TASK))
    rows = links.join(people, "community").repartition(tasks, "community")
    told = cut(rows.select("path", "people", "edges").mapInArrow(_removals(m), _TOLD))
    rest = cut(pairs.join(inner.join(small, "community", "left_semi").select("src", "dst"), ["src", "dst"], "left_anti"))
    return rest, cut(member.join(small, "community", "left_anti")), told


def _removals(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                path = [(p["held"], p["src"], p["dst"]) for p in row["path"]]
                people = sorted((p["vid"], p["d"]) for p in row["people"])
                edges = sorted((e["src"], e["dst"], e["left"]) for e in row["edges"])
                for parts, way, gain in _take_apart(people, edges, path, m):
                    way = [dict(zip(("held", "src", "dst"), p, strict=True)) for p in way]
                    columns = [*parts, None], [*(p[0] for p in parts), None], [way] * 3, [None, None, gain]
                    kinds = pa.list_(pa.int64()), pa.int64(), _TOLD_PATH, pa.float64()
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["vids", "community", "path", "gain"])

    return run


def _take_apart(people: list, edges: list, path: list, m: int) -> Iterator[tuple[list, list, float]]:
    """``(vids of both parts, path, gain)`` of every split of one component while its edges go, the most used first."""
    vids, degree = (np.array(c) for c in zip(*people, strict=True))
    src, dst = (np.searchsorted(vids, [e[i] for e in edges]) for i in (0, 1))
    near = np.zeros((len(vids), len(vids)))
    left = np.array([e[2] for e in edges])
    near[src[left], dst[left]] = near[dst[left], src[left]] = 1.0

    def share(part: np.ndarray) -> float:
        inside = np.zeros(len(vids), bool)
        inside[part] = True
        return (inside[src] & inside[dst]).sum() / m - (degree[part].sum() / (2 * m)) ** 2

    open_ = [(np.arange(len(vids)), path)]
    while open_:
        part, path = open_.pop()
        here = near[np.ix_(part, part)]
        while here.any():
            flow = _flows(here)
            a, b = np.nonzero(np.triu(here))  # in order of src, then dst
            held = -np.round(flow[a, b], 9)
            top = held.argmin()
            a, b, step = a[top], b[top], (float(held[top]), int(vids[part[a[top]]]), int(vids[part[b[top]]]))
            here[a, b] = here[b, a] = 0.0
            path = [p for p in path if p > step] + [step]
            side = _reached(here, a)
            if side[b]:
                continue
            parts = part[side], part[~side]
            gain = sum(map(share, parts)) - share(part)
            yield [vids[p].tolist() for p in parts], path, float(gain)
            near[np.ix_(part, part)] = here
            open_ += [(p, path) for p in parts]
            break


def _reached(near: np.ndarray, start: int) -> np.ndarray:
    seen = np.zeros(len(near), bool)
    front = np.array([start])
    while len(front):
        seen[front] = True
        front = np.flatnonzero(near[front].any(axis=0) & ~seen)
    return seen


def _flows(near: np.ndarray) -> np.ndarray:
    """Shortest paths through every edge, over all pairs of vertices: searches from all vertices at once, level by level and back."""
    found = [np.eye(len(near))]
    seen = found[0] > 0
    while True:
        step = np.where(seen, 0.0, found[-1] @ near)
        if not step.any():
            break
        seen |= step > 0
        found.append(step)
    flow, below = np.zeros_like(near), np.zeros_like(near)
    for above, here in zip(reversed(found[:-1]), reversed(found[1:]), strict=True):
        share = np.divide(1 + below, here, out=np.zeros_like(near), where=here > 0)
        flow += above.T @ share
        below = above * (share @ near)
    flow *= near
    return (flow + flow.T) / 2


def _scores(graph: Graph, pairs: DataFrame, pivots: int | None, vertices: DataFrame | None = None) -> DataFrame:
    people = (vertices if vertices is not None else graph.vertices).select("vid")
    return edge_betweenness(Graph(people, pairs, False), pivots).select(
        "src", "dst", F.round("betweenness", 9).alias("betweenness")
    )
