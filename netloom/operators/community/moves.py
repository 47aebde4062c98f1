"""Parallel local moves: Louvain, Leiden, Potts-model annealing and the map equation.

In every round each vertex looks at the communities across its arcs; a hash lets half of them
move at once, which keeps neighbours from trading places. Quality is a by-product of the
next round's look, so a round is one job, and the best state seen is what counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from netloom.operators.community import dealt
from netloom.operators.community.levels import Level, at_size, base_level, coin, contract, follow, own, steady
from netloom.operators.community.quality import split_disconnected
from netloom.operators.components import relabel
from netloom.operators.graph import Graph
from netloom.runtime import cut, setting, shuffle_width

# far beyond what settling takes; reaching it is an error
MAX_ROUNDS = 10_000
PATIENCE = 3
IDLE = 3
EPSILON = 1e-9


@dataclass(frozen=True)
class Objective:
    """Quality = inner weight − rate · Σ (community mass)², with mass the degree or the size."""

    mass: str
    rate: float

    @property
    def received(self) -> str:
        return "m_dst" if self.mass == "mass" else "s_dst"


def objective(level: Level, name: str, resolution: float) -> Objective:
    if name == "modularity":
        return Objective("mass", resolution / level.total if level.total else 0.0)
    if name == "CPM":
        return Objective("size", resolution)
    raise ValueError("objective is modularity or CPM")


def _look(level: Level, goal: Objective, member: DataFrame, salt: int) -> DataFrame:
    """Per vertex: its community, its weight inside, and the best community to be in.

    The receiver's mass travels on the arc and the community's total with the sender, so a
    vertex's options meet in two groupings that combine map-side, without further joins.
    """
    mine = level.nodes.select("vid", F.col(goal.mass).cast("double").alias("m")).join(member, "vid")
    # written out, so that the join can split a community that holds most vertices
    totals = at_size(level, mine.groupBy("community").agg(F.sum("m").alias("tot"))).withColumn("salt", F.lit(salt))
    state = mine.join(totals, "community")
    heard = level.links.send(state.select("vid", "community", "tot", "salt")).select(
        F.col("dst").alias("vid"),
        "community",
        "w",
        F.col(goal.received).cast("double").alias("m"),
        "tot",
        "salt",
        F.lit(0).alias("here"),
    )
    stay = state.select("vid", "community", F.lit(0.0).alias("w"), "m", "tot", "salt", F.lit(1).alias("here"))
    options = heard.unionByName(stay).groupBy("vid", "community").agg(
        F.sum("w").alias("w"), *(F.max(c).alias(c) for c in ("m", "tot", "salt", "here"))
    )
    return _rated(options, goal, F.lit(0.0))


def _rated(options: DataFrame, goal: Objective, noise: Column) -> DataFrame:
    """The best of every vertex's options, its home, and whether the coin lets it go."""
    rest = F.col("tot") - F.col("here") * F.col("m")
    gain = F.col("w") - goal.rate * F.col("m") * rest
    at_home = F.col("here") == 1
    return options.withColumn("rated", gain - noise).groupBy("vid").agg(
        F.max(F.struct("rated", F.xxhash64("community", "salt").alias("tie"), "community", "tot")).alias("best"),
        F.max(F.when(at_home, F.struct("rated", "community", "w", "m", "tot"))).alias("home"),
        F.max(coin("vid", "salt", F.lit(7)) < 0.5).alias("free"),
    )


def _spin_look(level: Level, goal: Objective, state: DataFrame, totals: list[float], salt: int, heat: float) -> DataFrame:
    """As :func:`_look` for ``state(vid, m, community)``, with all spins offered, whether a neighbour or anybody is in them or not.

    What a vertex hears of every spin is one row, so its options are rated where they meet. Totals, salt and heat come
    as one array, which generated code only refers to: it is compiled once for all rounds.
    """
    heard = level.links.send(state.select("vid", "community")).select(
        F.col("dst").alias("vid"), "community", "w", F.lit(None).cast("double").alias("m"), F.lit(False).alias("own")
    )
    stay = state.select("vid", "community", F.lit(0.0).alias("w"), "m", F.lit(True).alias("own"))
    told = ", ".join(f"sum(if(community = {spin}, w, 0D))" for spin in range(len(totals)))
    met = heard.unionByName(stay).groupBy("vid").agg(
        F.expr(f"array({told})").alias("ws"), F.max("m").alias("m"), F.max(F.when(F.col("own"), F.col("community"))).alias("at")
    )
    rows = ", ".join(f"({spin}L, double('{tot!r}'), {salt}, double('{heat!r}'))" for spin, tot in enumerate(totals))
    offers = F.expr(f"cast(array({rows}) AS array<struct<community:bigint, tot:double, salt:int, heat:double>>)")
    options = met.select("vid", "m", "at", "ws", F.explode(offers).alias("o")).select(
        "vid", "m", "o.*", F.col("ws")[F.col("o.community").cast("int")].alias("w"), (F.col("o.community") == F.col("at")).cast("int").alias("here")
    )
    noise = F.when(F.col("heat") > 0, F.col("heat") * F.ln(-F.ln(coin("vid", "community", "salt")))).otherwise(0.0)
    return _rated(options, goal, noise)


def _observed(df: DataFrame, sums: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``df`` written out, and the sums over it taken on the way."""
    seen = Observation()
    return cut(df.observe(seen, *(column.alias(name) for name, column in sums.items()))), seen.get


def _mass_in(spins: int, community: Column, mass: Column) -> Column:
    """The mass in every spin."""
    return F.array(*(F.sum(F.when(community == spin, mass).otherwise(0.0)) for spin in range(spins)))


def _apart(moves: DataFrame, level: Level | None = None) -> DataFrame:
    """Of ``(vid, a, b, gain)`` the moves that are the best of both communities they touch.

    No two of them share a community, so their gains add up and quality is sure to rise.
    """
    touched = moves.select("vid", "gain", F.explode(F.array("a", "b")).alias("c"))
    best = touched.groupBy("c").agg(F.max(F.struct("gain", F.xxhash64("vid").alias("tie"), "vid")).alias("w"))
    best = at_size(level, best) if level else cut(best)
    winner = best.select("c", F.col("w.vid").alias("winner"))
    return (
        moves.join(winner.toDF("a", "_wa"), "a").join(winner.toDF("b", "_wb"), "b")
        .where("_wa = vid and _wb = vid").select("vid", "b")
    )


def _moved(looked: DataFrame, moves: DataFrame) -> DataFrame:
    """Membership after ``moves(vid, b)``."""
    return looked.join(moves, "vid", "left").select("vid", F.coalesce("b", F.col("home.community")).alias("community"))


def _settle(
    level: Level, goal: Objective, member: DataFrame, seed: int, heats: list[float] | None = None, spins: int | None = None
) -> tuple[DataFrame, float, bool]:
    """Move vertices until nothing improves; returns membership, quality and whether anything moved.

    Half of the vertices move at once until that stops to pay; from the best state on, only moves
    that cannot disturb each other are made, so quality rises each round and the loop ends by itself.
    """
    heats = heats or []
    if dealt.fits(level):
        return dealt.settle(level, goal, member, seed, heats, spins, MAX_ROUNDS, PATIENCE)
    best, best_quality, stale, moved, careful = None, -float("inf"), 0, False, False
    wants = (F.col("best.rated") > F.col("home.rated") + EPSILON) & (F.col("best.community") != F.col("home.community"))
    half = F.when(wants & F.col("free"), F.col("best.community")).otherwise(F.col("home.community"))
    sums = {
        "inside": F.sum("home.w"),
        "squares": F.sum(F.col("home.m") * F.col("home.tot")),
        "wanting": F.count_if(wants),
    }
    if spins:
        sums["masses"] = _mass_in(spins, half, F.col("home.m"))
    masses, totals = level.nodes.select("vid", F.col(goal.mass).cast("double").alias("m")), None
    for turn in range(len(heats) + MAX_ROUNDS):
        heat = heats[turn] if turn < len(heats) else 0.0
        salt = seed * 1009 + turn
        if spins:
            state = member if "m" in member.columns else cut(masses.join(member, "vid"))
            if totals is None:
                totals = state.agg(_mass_in(spins, F.col("community"), F.col("m"))).first()[0]
            looked, seen = _observed(_spin_look(level, goal, state, [t or 0.0 for t in totals], salt, heat), sums)
            totals = None
        else:
            looked, seen = _observed(_look(level, goal, member, salt), sums)
        quality = (seen["inside"] or 0.0) + level.inner - goal.rate * (seen["squares"] or 0.0)
        if quality > best_quality + EPSILON:
            best = looked.select("vid", F.col("home.community").alias("community"))
            best_quality, stale = quality, 0
            moved = moved or turn > 0
        elif not heat:
            stale += 1
        if not heat:
            if not seen["wanting"] and quality >= best_quality - EPSILON:
                return best, best_quality, moved
            if not careful and (stale >= PATIENCE or not seen["wanting"]):
                careful, member = True, best
                continue
        if careful:
            asked = looked.where(wants).select(
                "vid", F.col("home.community").alias("a"), F.col("best.community").alias("b"),
                (F.col("best.rated") - F.col("home.rated")).alias("gain"),
            )
            member = _moved(looked, _apart(asked, level))
        elif spins:
            member = looked.select("vid", "home.m", half.alias("community"))
            totals = seen["masses"]
        else:
            member = looked.select("vid", half.alias("community"))
    raise RuntimeError(f"moves did not settle in {MAX_ROUNDS} rounds")


def _refine(level: Level, goal: Objective, member: DataFrame, seed: int) -> DataFrame:
    """Regroup single vertices inside their community; every group stays connected.

    Tails (by hash) that are still alone join the best group of their community across an arc;
    groups of more than one, and lone heads, hold still meanwhile.
    """
    if dealt.fits(level):
        return dealt.refine(level, goal, member, seed, MAX_ROUNDS, IDLE)
    nodes = level.nodes.select("vid", F.col(goal.mass).cast("double").alias("m"))
    state = cut(nodes.join(member, "vid").withColumn("part", F.col("vid")))
    idle = 0
    for turn in range(MAX_ROUNDS):
        salt = seed * 2003 + turn
        totals = at_size(level, state.groupBy("part").agg(F.sum("m").alias("tot"), F.count(F.lit(1)).alias("n")))
        placed = at_size(level, state.join(totals, "part").withColumn("head", (F.col("n") > 1) | (coin("vid", F.lit(salt)) < 0.5)))
        offers = (
            level.links.send(placed.where("head").select("vid", "community", "part", "tot"))
            .groupBy(F.col("dst").alias("vid"), "part", "community", "tot")
            .agg(F.sum("w").alias("w"))
        )
        tails = placed.where("not head").select("vid", "community", "m")
        chosen = (
            offers.join(tails, ["vid", "community"])
            .withColumn("gain", F.col("w") - goal.rate * F.col("m") * F.col("tot"))
            .where(F.col("gain") > EPSILON)
            .groupBy("vid")
            .agg(F.max(F.struct("gain", F.xxhash64("part", F.lit(salt)).alias("tie"), "part")).alias("to"))
        )
        new = cut(
            placed.join(chosen, "vid", "left").select(
                "vid", "m", "community", F.coalesce("to.part", "part").alias("part"), F.col("to").isNotNull().alias("went")
            )
        )
        state = new.drop("went")
        # heads and tails change by hash, so a few rounds in a row must be idle
        idle = idle + 1 if new.where("went").isEmpty() else 0
        if idle == IDLE:
            return state.select("vid", "community", "part")
    raise RuntimeError(f"refinement did not settle in {MAX_ROUNDS} rounds")


def louvain(graph: Graph, resolution: float = 1.0, seed: int = 0, weight: str | None = None) -> DataFrame:
    """Move vertices, contract communities, repeat while quality rises (Blondel et al. 2008)."""
    level = base_level(graph, weight)
    goal = objective(level, "modularity", resolution)
    member, last = cut(own(level.nodes)), -float("inf")
    with shuffle_width(graph.edges.sparkSession, level.links.n_arcs):
        while True:
            with steady(level):
                found, quality, moved = _settle(level, goal, own(level.nodes), seed)
            if not moved or quality <= last + EPSILON:
                break
            last = quality
            found = cut(found)
            member = follow(member, found)
            level = contract(level, found)
    level.links.release()
    return relabel(member)


def leiden(
    graph: Graph,
    objective_name: str = "modularity",
    resolution: float = 1.0,
    seed: int = 0,
    weight: str | None = None,
) -> DataFrame:
    """Louvain with refinement before each contraction (Traag et al. 2019); communities are connected."""
    level = base_level(graph, weight)
    goal = objective(level, objective_name, resolution)
    member = cut(own(level.nodes))
    start, last, best = own(level.nodes), -float("inf"), member
    with shuffle_width(graph.edges.sparkSession, level.links.n_arcs):
        while True:
            with steady(level):
                found, quality, _ = _settle(level, goal, start, seed)
            if quality <= last + EPSILON:
                break
            last = quality
            best = follow(member, found)
            with steady(level):
                parts = cut(_refine(level, goal, found, seed))
            before, after = parts.agg(F.count(F.lit(1)), F.count_distinct("part")).first()
            if before == after:
                break
            groups = parts.select("vid", F.col("part").alias("community"))
            start = cut(parts.select(F.col("part").alias("vid"), "community").distinct())
            member = follow(member, groups)
            level = contract(level, groups)
    level.links.release()
    return relabel(split_disconnected(graph, best))


def spin_glass(
    graph: Graph,
    spins: int = 25,
    gamma: float = 1.0,
    start: float = 1.0,
    stop: float = 0.01,
    cooling: float = 0.99,
    seed: int = 0,
    weight: str | None = None,
) -> DataFrame:
    """Potts-model annealing (Reichardt and Bornholdt 2006) with all components at once.

    Spins start at random; a vertex takes any of the spins with the heat-bath probability of
    the energy it saves, half the vertices per step, as the temperature falls. Each
    connected piece of a final spin is a community, so disconnected graphs work.
    """
    level = base_level(graph, weight)
    goal = objective(level, "modularity", gamma)
    heats, t = [], start
    while t > stop:
        heats.append(t)
        t *= cooling
    spun = level.nodes.select(
        "vid", F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(spins)).alias("community")
    )
    spark = graph.edges.sparkSession
    # hundreds of short rounds whose shuffles are sized beforehand: planning each of them anew as it runs only costs time
    with shuffle_width(spark, level.links.n_arcs), setting(spark, "spark.sql.adaptive.enabled", "false"):
        found, _, _ = _settle(level, goal, spun, seed, heats, spins)
        found = cut(found)
    level.links.release()
    return relabel(split_disconnected(graph, found))


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def _map_look(level: Level, member: DataFrame, salt: int) -> tuple[DataFrame, float]:
    """Per vertex the move that shortens the map equation most; also the current code length.

    Lengths leave out the vertex term, which no move changes.
    """
    two_m = F.lit(level.total)
    mine = level.nodes.select("vid", F.col("mass").alias("m")).join(member, "vid")
    told = (
        level.links.send(mine.select("vid", "community"))
        .groupBy(F.col("dst").alias("vid"), "community")
        .agg(F.sum("w").alias("w"))
    )
    home = mine.select("vid", "m", F.col("community").alias("here"))
    # a row per vertex and adjacent community; isolated vertices have none and never move
    options = cut(told.join(home, "vid"))
    reach = options.groupBy("vid").agg(
        F.sum(F.when(F.col("community") == F.col("here"), F.col("w")).otherwise(0.0)).alias("w_here"),
        F.sum("w").alias("out"),  # inner weight of a contracted vertex never leaves it
    )
    # vertices without arcs are modules too, or lengths of two levels could not be compared
    people = home.join(reach, "vid", "left").na.fill(0.0, ["w_here", "out"])
    modules = cut(
        people.groupBy("here").agg(
            (F.sum("m") / two_m).alias("p"), (F.sum(F.col("out") - F.col("w_here")) / two_m).alias("q")
        )
    )
    sums = modules.agg(
        F.sum("q").alias("q"), F.sum(_plogp(F.col("q"))).alias("a"), F.sum(_plogp(F.col("q") + F.col("p"))).alias("b")
    ).first()
    total_q = sums["q"] or 0.0
    length = (total_q * math.log2(total_q) if total_q > 0 else 0.0) - 2 * (sums["a"] or 0) + (sums["b"] or 0)
    leave = modules.select("here", F.col("p").alias("p_a"), F.col("q").alias("q_a"))
    join = modules.select(F.col("here").alias("community"), F.col("p").alias("p_b"), F.col("q").alias("q_b"))
    moves = (
        options.where("community <> here")
        .join(people.select("vid", "w_here", "out"), "vid")
        .join(leave, "here")
        .join(join, "community")
    )
    p = F.col("m") / two_m
    # leaving a: its arcs into a become exits, its other arcs stop being exits; joining b the reverse
    qa = F.col("q_a") - (F.col("out") - 2 * F.col("w_here")) / two_m
    qb = F.col("q_b") + (F.col("out") - 2 * F.col("w")) / two_m
    qa = F.when(F.abs(qa) < 1e-15, 0.0).otherwise(qa)
    qb = F.when(F.abs(qb) < 1e-15, 0.0).otherwise(qb)
    total = F.lit(total_q) + qa + qb - F.col("q_a") - F.col("q_b")
    change = (
        _plogp(total) - _plogp(F.lit(total_q))
        - 2 * (_plogp(qa) + _plogp(qb) - _plogp(F.col("q_a")) - _plogp(F.col("q_b")))
        + _plogp(qa + F.col("p_a") - p) + _plogp(qb + F.col("p_b") + p)
        - _plogp(F.col("q_a") + F.col("p_a")) - _plogp(F.col("q_b") + F.col("p_b"))
    )
    best = (
        moves.withColumn("saves", -change)
        .where(F.col("saves") > EPSILON)
        .groupBy("vid")
        .agg(F.max(F.struct("saves", F.xxhash64("community", F.lit(salt)).alias("tie"), "community")).alias("best"))
    )
    return cut(member.join(best, "vid", "left")), length


def infomap(graph: Graph, seed: int = 0, weight: str | None = None) -> DataFrame:
    """Two-level map equation (Rosvall and Bergstrom 2008) by parallel moves and contraction.

    Flow on the undirected view is proportional to degree, so no rank has to be iterated.
    """
    level = base_level(graph, weight)
    member, last = cut(own(level.nodes)), float("inf")
    with shuffle_width(graph.edges.sparkSession, level.links.n_arcs):
        while level.total:
            found, shortest = _shorten(level, seed)
            if shortest >= last - EPSILON:
                break
            last = shortest
            member = follow(member, found)
            level = contract(level, found)
    level.links.release()
    return relabel(member)


def _shorten(level: Level, seed: int) -> tuple[DataFrame, float]:
    """Parallel moves as in ``_settle``.

    Moves that share no module still meet in the total of exits, so should a set of them lengthen the code, the
    single best move is made instead, which is sure to shorten it.
    """
    current, best, shortest, stale, careful, single = own(level.nodes), None, float("inf"), 0, False, False
    for turn in range(MAX_ROUNDS):
        salt = seed * 1009 + turn
        looked, length = _map_look(level, current, salt)
        if length < shortest - EPSILON:
            best, shortest, stale, single = looked.select("vid", "community"), length, 0, False
        else:
            stale += 1
        wanting = not looked.where("best is not null").isEmpty()
        if not wanting and length <= shortest + EPSILON:
            return best, shortest
        if careful and length > shortest + EPSILON:
            current, single = best, True
            continue
        if not careful and (stale >= PATIENCE or not wanting):
            careful, current = True, best
            continue
        if careful:
            asked = looked.where("best is not null").select(
                "vid", F.col("community").alias("a"), F.col("best.community").alias("b"), F.col("best.saves").alias("gain")
            )
            goes = asked.orderBy(F.desc("gain"), "vid").limit(1).select("vid", "b") if single else _apart(asked)
            current = looked.join(goes, "vid", "left").select("vid", F.coalesce("b", "community").alias("community"))
        else:
            goes = F.col("best").isNotNull() & (coin("vid", F.lit(salt), F.lit(7)) < 0.5)
            current = looked.select("vid", F.when(goes, F.col("best.community")).otherwise(F.col("community")).alias("community"))
    raise RuntimeError(f"moves did not settle in {MAX_ROUNDS} rounds")
