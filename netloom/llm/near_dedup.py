"""Near copies by a chosen-path set similarity join (after Christiani and Pagh, 2017; CPSJoin, 2018).

Documents are sets of word shingles. A tree starts with all sets; at each node a set goes on to the
child named by its smallest token under that tree's and level's own hash order, so similar sets tend
to stay together. A node of few sets is compared exhaustively, larger ones branch on. Independent
trees are repeated until the chance that a similar pair never meets is negligible: a pair at the
threshold s shares the first child of a tree with chance s, so ``TREES`` trees miss it with
chance (1 - s) ** TREES, about 7e-12. Where that child is large, the pair must share the children of
further levels too, with chance s ** (level + 1); members of large nodes therefore get as many more
trees at every level as keep the chance of a miss at ``MISS`` (``trees_at``: 16, 21, 29 and 40 at s = 0.8).

Groups of near copies never get small by branching. Before pairs are formed, members of a node are held
against one leader of the node and joined with it where they are similar; afterwards only pairs that
are not yet in one component, and were not compared before, are formed. Candidates pass a sketch by one-permutation
hashing, those of the last large nodes a finer one too, and the pairs left are confirmed on their full sets.

The sketch keeps the smallest hash of each of ``SKETCH`` equal ranges of hash values. Of a pair, the ranges that either set
reaches hold a sample, without replacement, of the union, and those with equal hashes are its members in both sets; so a pair at
the threshold has too few equal ranges with a chance of ``exp(-DOUBT)`` at most, by the bounds of Hoeffding (1963) and Serfling (1974).
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut_in_small_batches as cut
from netloom.llm.common import spread_join

SHINGLE = 5
SIMILARITY = 80
#: Trees of every set; members of large nodes get more of them.
TREES = 16
LEVELS = 4
#: The chance with which a pair at the threshold may fail to meet in the nodes of one level.
MISS = 1e-9
#: Nodes of up to this many sets are compared exhaustively.
LEAF = 32
#: Larger nodes of the last level are compared in blocks of about this many sets.
NODE_ROWS = 512
#: Bytes of the sketch of every set, and of the finer one of members of large nodes of the last level.
SKETCH = 256
FINE = 2048
#: A sketch rules out a pair at the threshold with a chance of exp(-DOUBT), 1e-11.
DOUBT = 11 * math.log(10)
#: Pairs of a block that are looked at at a time, and bytes of sketches compared at a time.
PAIRS_AT_ONCE = 8192
SKETCHES_AT_ONCE = 1 << 20
#: This many row numbers, 8 bytes each, may be broadcast; beyond that a shuffled join takes over.
BROADCAST_ROWS = 500_000
#: Hashes that are permuted at once, which bounds memory for long texts.
BLOCK = 32_768

_STEP = np.random.default_rng(97).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words.

    A-Z are lowered; words are split at ASCII white space. Fewer words than ``size`` make one shingle; no
    word makes an empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    take = min(size, len(words))
    n = len(words) - take + 1
    total = np.full(n, len(words) if take < size else size, np.uint64)
    for at in range(take):
        total += hashed[at : at + n] * _STEP[at]
    return np.unique(_mix(total))


def trees_at(level: int, similarity: int) -> int:
    """Trees whose nodes of ``level`` all miss a pair at the threshold with a chance of ``MISS`` at most."""
    apart = 1 - (similarity / 100) ** (level + 1)
    return max(TREES, math.ceil(math.log(MISS) / math.log(apart))) if apart else TREES


@lru_cache(maxsize=8)
def _orders(trees: int, levels: int) -> np.ndarray:
    """Hash orders of a tree's levels, those of all ``trees`` for one level after another; an order is the same in any selection."""
    made = [np.random.default_rng([20_170_701, level]).integers(0, 2**63, (trees, 2), dtype=np.uint64) for level in range(levels)]
    return np.concatenate(made) * np.uint64(2) + np.uint64(1)


def _minima(tokens: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The smallest of the tokens under each of the hash orders."""
    out = np.full(len(orders), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, BLOCK // len(orders))
    for start in range(0, len(tokens), step):
        x = tokens[None, start : start + step] * orders[:, :1]
        x ^= x >> np.uint64(32)
        x *= orders[:, 1:]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def _sketch(tokens: np.ndarray, bins: int) -> bytes:
    """A byte for each of ``bins`` ranges of hash values: of its smallest token, or zero where there is none."""
    out = np.zeros(bins, np.uint8)
    at = (tokens >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))  # the tokens are sorted
    out[at[first]] = tokens[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


@lru_cache(maxsize=8)
def _least_equal(bins: int, similarity: int) -> np.ndarray:
    """For every number of ranges that a pair reaches, the equal ones below which Hoeffding's bound rules it out."""
    s = similarity / 100
    n, x = np.arange(1, bins + 1)[:, None], np.linspace(0, s, 1001)[None, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where(x > 0, x * np.log(x / s), 0) + ((1 - x) * np.log((1 - x) / (1 - s)) if s < 1 else np.inf)
    # the bound falls as x nears s; the last x that it rules out counts
    return np.concatenate([[0], np.maximum((n * apart >= DOUBT).sum(axis=1) - 1, 0) / 1000 * s * n[:, 0]])


def _not_ruled_out(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the sketches ``a`` and ``b`` (one row a pair) of sets of ``na`` and ``nb`` tokens allow the similarity, and their equal bytes."""
    s = similarity / 100
    reached = ((a | b) != 0).sum(axis=1, dtype=np.int64)
    equal = ((a == b) & (a != 0)).sum(axis=1, dtype=np.int64)
    unseen = 1 - np.maximum(reached - 1, 0) / np.maximum((na + nb) / (1 + s), reached)
    least = np.maximum(_least_equal(a.shape[1], similarity)[reached], reached * s - np.sqrt(DOUBT / 2 * reached * unseen))
    return equal >= np.floor(least - 1e-6), equal


def _more_keys(size: int, trees: int, levels: int):
    def run(batches):
        orders = _orders(trees, levels)
        for batch in batches:
            keys = [(_minima(shingle_set(text, size), orders) >> np.uint64(1)).astype(np.int64) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "keys"])

    return run


def _texts(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """``(rep, text)`` of the reps in ``wanted``, a written table."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return sets.select(F.col("_row").alias("rep"), "text").join(wanted, "rep", "left_semi")


def more_keys(crowd: DataFrame, sets: DataFrame, size: int, trees: int, levels: int) -> DataFrame:
    """``(rep, keys)``: the tokens that the reps of ``crowd`` select in ``trees`` trees, those of one level after another."""
    return cut(_texts(crowd, sets).mapInArrow(_more_keys(size, trees, levels), "rep long, keys array<long>"))


def _fine(size: int):
    def run(batches):
        for batch in batches:
            found = [_sketch(shingle_set(text, size), FINE) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(found, pa.binary())], names=["rep", "fine"])

    return run


def _profile(size: int):
    def run(batches):
        orders = _orders(TREES, 1)
        for batch in batches:
            sizes, digests, keys, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingle_set(text, size)
                sizes.append(len(tokens))
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                keys.append((_minima(tokens, orders) >> np.uint64(1)).astype(np.int64))
                sketches.append(_sketch(tokens, SKETCH))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"), batch.column("doc_id"), batch.column("text"),
                    pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                ],
                names=["_row", "doc_id", "text", "n_shingles", "digest", "keys", "sketch"],
            )

    return run


def profile(rows: DataFrame, size: int) -> DataFrame:
    """Written once: every row (_row, doc_id, text) with its set's size and digest, the tokens it selects first, and its sketch."""
    schema = "_row long, doc_id long, text string, n_shingles long, digest binary, keys array<long>, sketch binary"
    return cut(rows.mapInArrow(_profile(size), schema))


def _bytes_of(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _likely(similarity: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = (_bytes_of(batch.column(c), SKETCH) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            fits, equal = _not_ruled_out(a, b, na, nb, similarity)
            yield batch.select(["a", "b"]).append_column("equal", pa.array(equal, pa.int32())).filter(pa.array(fits))

    return run


def likely_pairs(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``(a, b, equal)``: the pairs that neither the sizes of their sets nor their sketches rule out."""
    sketches = sets.select("rep", "sketch", "n_shingles")
    both = pairs.join(sketches.toDF("a", "sa", "na"), "a").join(sketches.toDF("b", "sb", "nb"), "b")
    alike = both.where(100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb")).select("a", "b", "sa", "sb", "na", "nb")
    return cut(alike.mapInArrow(_likely(similarity), "a long, b long, equal int"))


def _block_pairs(similarity: int):
    def run(table: pa.Table) -> pa.Table:
        rep, comp, n, block, i, j = (table[c].to_numpy() for c in ("rep", "comp", "n_shingles", "block", "i", "j"))
        sketch, fine = _bytes_of(table["sketch"], SKETCH), _bytes_of(table["fine"], FINE)
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        found = [np.empty((2, 0), np.int64)]
        step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
        for start in range(0, len(left), step):
            some = left[start : start + step, None]
            open_ = (comp[some] != comp[right]) & (100 * np.minimum(n[some], n[right]) >= similarity * np.maximum(n[some], n[right]))
            if i[0] == j[0]:
                open_ &= rep[some] < rep[right]
            x, y = np.nonzero(open_)
            a, b = some[x, 0], right[y]
            for kind in (sketch, fine):
                many = SKETCHES_AT_ONCE // kind.shape[1]
                parts = [(a[k : k + many], b[k : k + many]) for k in range(0, len(a), many)]
                fits = [_not_ruled_out(kind[u], kind[v], n[u], n[v], similarity)[0] for u, v in parts]
                fits = np.concatenate([np.empty(0, bool), *fits])
                a, b = a[fits], b[fits]
            found.append(np.stack([rep[a], rep[b]]))
        a, b = np.concatenate(found, axis=1)
        return pa.table([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return run


def likely_in_large(members: DataFrame, reps: DataFrame, fine: DataFrame, similarity: int) -> DataFrame:
    """``(a, b)`` as :func:`likely_pairs`, for all pairs of two components in the nodes of ``members`` (node, n, rep, comp).

    A node's sketches meet block against block, so a member travels once for each block of its node and only likely pairs become rows.
    """
    blocks = F.ceil(F.col("n") / NODE_ROWS)
    placed = members.join(reps.select("rep", "sketch", "n_shingles"), "rep").join(fine, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), blocks))
    met = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    rows = placed.select("node", F.explode(met).alias("m"), "block", "rep", "comp", "n_shingles", "sketch", "fine").select(
        "node", "m.i", "m.j", "block", "rep", "comp", "n_shingles", "sketch", "fine"
    )
    return rows.groupBy("node", "i", "j").applyInArrow(_block_pairs(similarity), "a long, b long")


def _confirmed(size: int, similarity: int):
    def run(batches):
        last, held = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if a != last:  # rows come sorted by a wherever the join sorts
                    last, held = a, shingle_set(ta, size)
                other = shingle_set(tb, size)
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * common >= similarity * (len(held) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirm(pairs: DataFrame, sets: DataFrame, size: int, similarity: int) -> DataFrame:
    """``(a, b)``: the pairs of a written table that are similar on their full sets."""
    texts = _texts(cut(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()), sets)
    both = pairs.select("a", "b").join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return cut(both.mapInArrow(_confirmed(size, similarity), "a long, b long"))


def _roots(parents: DataFrame) -> DataFrame:
    """``(rep, comp)`` from pointers to smaller reps, by halving the way to the root."""
    state = parents
    while True:
        above = state.where("comp <> rep").select(F.col("rep").alias("comp"), F.col("comp").alias("_up"))
        moved = cut(
            state.join(above, "comp", "left").select(
                "rep", F.coalesce("_up", "comp").alias("comp"), F.col("_up").isNotNull().alias("_moved")
            )
        )
        state = moved.drop("_moved")
        if not moved.where("_moved").head(1):
            return state


def merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after adding ``links``; a component is named by its smallest rep.

    Each round hooks every component that has a smaller neighbour onto its smallest one, then follows the
    pointers to the roots; a link within one component is dropped. At least half of the
    components with a link to another one lose their root each round.
    """
    if links.isEmpty():
        return comps
    while True:
        across = _across(links, comps).select("ca", "cb")
        across = cut(across.select(F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high")).distinct())
        if not across.head(1):
            return comps
        hooks = across.groupBy(F.col("high").alias("rep")).agg(F.min("low").alias("_to"))
        tops = comps.where("rep = comp").join(hooks, "rep", "left").select("rep", F.coalesce("_to", "rep").alias("comp"))
        roots = _roots(cut(tops)).toDF("comp", "_root")
        comps = cut(comps.join(roots, "comp").select("rep", F.col("_root").alias("comp")))


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in two components, with ``ca`` and ``cb``."""
    ends = pairs.join(comps.toDF("a", "ca"), "a").join(comps.toDF("b", "cb"), "b")
    return ends.where("ca <> cb")


def near_classes(sets: DataFrame, size: int, similarity: int) -> DataFrame:
    """``(rep, comp)`` for one representative row of every distinct non-empty set of a profile."""
    first = sets.where("n_shingles > 0").groupBy("digest").agg(F.min("_row").alias("rep"))
    reps = cut(sets.join(first.select(F.col("rep").alias("_row")), "_row").select(F.col("_row").alias("rep"), "keys", "sketch", "n_shingles"))
    comps = cut(reps.select("rep", F.col("rep").alias("comp")))

    def branch(members: DataFrame, level: int, trees: int) -> DataFrame:
        """Children of the nodes in ``members`` (tree, node, rep, keys) by the tokens selected at ``level``."""
        token = F.get("keys", F.col("tree") + level * trees)
        return members.select("tree", F.xxhash64("node", "tree", token).alias("node"), "rep", "keys")

    def planted(rows: DataFrame, start: int, end: int, level: int) -> DataFrame:
        """The nodes of ``level`` in which ``rows`` (rep, keys of ``end`` trees) stand in the trees from ``start`` on."""
        out = rows.withColumn("tree", F.explode(F.sequence(F.lit(start), F.lit(end - 1)))).withColumn("node", F.lit(0).cast("long"))
        for above in range(level + 1):
            out = branch(out, above, end)
        return out

    tested: list[DataFrame] = []

    def untested(pairs: DataFrame) -> DataFrame:
        """``pairs``, each once and in order of its ends, without those that were confirmed or refuted before."""
        ends = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for done in tested:
            ends = ends.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        return ends

    n_trees = TREES
    members = planted(reps.select("rep", "keys"), 0, TREES, 0)
    for level in range(LEVELS):
        if level:
            # whatever pair is still open lies in the crowd; its deeper nodes are shared more rarely
            crowd = cut(large.select("rep").distinct())
            needed = max(n_trees, trees_at(level, similarity))
            keyed = more_keys(crowd, sets, size, needed, level + 1)
            members = branch(large.select("tree", "node", "rep").join(keyed, "rep"), level, needed)
            if needed > n_trees:
                members = members.unionByName(planted(keyed, n_trees, needed, level))
                n_trees = needed
        # sets that share a child with no other are done
        members = cut(members.drop("keys"))
        counted = cut(members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
        held = cut(spread_join(members, counted, "node", "n"))
        # the leader of a node is the member that stands in the fullest nodes: the text that the others vary
        full = held.groupBy("rep").agg(F.sum("n").alias("score"))
        ranked = held.join(full, "rep").groupBy("node").agg(F.max(F.struct("score", (-F.col("rep")).alias("rest"))).alias("_l"), F.max("n").alias("n"))
        leaders = cut(ranked.select("node", "n", (-F.col("_l.rest")).alias("leader")))
        stars = spread_join(held.drop("n"), leaders, "node", "n").where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
        # with leaders: first the likeliest one of each set, then those that still join components
        stars = likely_pairs(untested(_across(stars.distinct(), comps)), reps, similarity)
        if level == 0 and not stars.isEmpty():
            both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
            ends = stars.select("equal", both.alias("e")).select("equal", "e.*").groupBy("x").agg(F.max_by("y", F.struct("equal", -F.col("y"))).alias("y"))
            best = cut(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
            comps = merge(comps, confirm(best, sets, size, similarity))
            tested.append(best)
            stars = cut(untested(_across(stars.select("a", "b"), comps)))
        if not stars.isEmpty():
            comps = merge(comps, confirm(stars.select("a", "b"), sets, size, similarity))
            tested.append(stars.select("a", "b"))
        # nodes that still hold several components
        placed = cut(held.join(comps, "rep"))
        mixed = placed.groupBy("node").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.count("*").alias("n")).where("_a <> _b")
        mixed = cut(mixed.select("node", "n"))
        if mixed.isEmpty():
            break
        placed = cut(spread_join(placed.drop("n"), mixed, "node", "n"))
        last = level + 1 == LEVELS
        few = placed.where(F.col("n") <= LEAF).select("node", "rep", "comp")
        other = few.toDF("node", "b", "cb")
        pairs = few.toDF("node", "a", "ca").join(other, "node").where("a < b and ca <> cb").select("a", "b").distinct()
        likely = likely_pairs(untested(pairs), reps, similarity)
        if last:  # what never got small is compared whole
            held = cut(placed.where(F.col("n") > LEAF))
            fine = cut(_texts(cut(held.select("rep").distinct()), sets).mapInArrow(_fine(size), "rep long, fine binary"))
            rest = cut(likely_in_large(held, reps, fine, similarity).distinct())
            likely = cut(likely.select("a", "b").unionByName(untested(rest.select("a", "b"))).distinct())
        if not likely.isEmpty():
            comps = merge(comps, confirm(likely, sets, size, similarity))
            tested.append(likely.select("a", "b"))
        large = placed.where(F.col("n") > LEAF)
        if last or not large.head(1):
            break
    return comps


def _decide(sets: DataFrame, size: int, similarity: int) -> DataFrame:
    """Every row of a profile with ``component_id``, ``_keeper`` (the row that stays) and ``component_size``."""
    comps = near_classes(sets, size, similarity)
    first = sets.where("n_shingles > 0").groupBy("digest").agg(F.min("_row").alias("rep"))
    named = first.join(comps, "rep").select("digest", "comp")
    by_digest = cut(
        sets.where("n_shingles > 0").groupBy("digest").agg(F.count("*").alias("n")).join(named, "digest")
    )
    rows = cut(sets.select("_row", "doc_id", "n_shingles", "digest"))
    full, empty = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
    placed = cut(spread_join(full, by_digest, "digest", "n").drop("n", "digest"))
    # the row that stays: smallest id, a null id after all others, then the first row
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    heads = cut(placed.groupBy("comp").agg(F.min(order).alias("_head"), F.count("*").alias("component_size")))
    heads = heads.select("comp", "component_size", F.col("_head.doc_id").alias("component_id"), F.col("_head._row").alias("_keeper"))
    linked = spread_join(placed, heads, "comp", "component_size")
    alone = empty.select(
        "_row", "doc_id", "n_shingles", F.col("_row").alias("comp"), F.lit(1).cast("long").alias("component_size"),
        F.col("doc_id").alias("component_id"), F.col("_row").alias("_keeper"),
    )
    return linked.unionByName(alone)


def near_dedup(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, component_size, class_row)`` for every row of ``docs``.

    Rows whose sets have at least ``similarity`` per cent of their union in common are linked, and
    ``component_id`` is the smallest doc_id that can be reached. Null and empty texts have no
    shingles and link with nothing. Of repeated rows (equal in id and text) one is kept. An empty table
    gives no rows; null ids count as larger than all others; other columns are not looked at.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    rows = _decide(profile(numbered, size), size, similarity)
    return rows.select(
        "doc_id", "n_shingles", "component_id", F.expr("_row = _keeper").alias("kept"), "component_size",
        F.col("comp").alias("class_row"),
    )


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with their columns unchanged."""
    numbered = cut(docs.select(F.struct(*docs.columns).alias("_all"), F.monotonically_increasing_id().alias("_row")))
    sets = profile(numbered.select("_row", "_all.doc_id", "_all.text"), size)
    gone = _decide(sets, size, similarity).where("_row <> _keeper").select("_row")
    return numbered.join(gone, "_row", "left_anti").select("_all.*")
