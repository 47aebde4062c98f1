import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import components, documents, lower, nothing, rows, shingles
from netloom.llm import exact_dedup as ed
from netloom.llm import near_dedup as nd
from netloom.llm.common import BATCH_BYTES, cut_in_small_batches
from netloom.runtime import cut


def key(n: int) -> bytes:
    return hashlib.sha256(str(n).encode()).digest()


def test_cuckoo_filter_inserts_and_deletes():
    f = ed.CuckooFilter(256)
    held = [k for k in map(key, range(800)) if f.add(k)]
    assert len(held) > 700 and all(map(f.has, held))
    for k in held[::2]:
        assert f.remove(k)
    assert all(map(f.has, held[1::2]))
    assert sum(map(f.has, map(key, range(10_000, 30_000)))) < 40


def test_shard_grows_on_overflow_and_verifies_hits():
    shard = ed.Shard()
    for n in range(5000):
        shard.insert(key(n), [n])
    assert shard.filter.mask + 1 > 64 and shard.n_keys == 5000
    assert all(shard.find(key(n)) == [n] for n in range(5000))
    alike = key(7)[:10] + b"x" * 22  # same fingerprint and bucket, another digest
    assert shard.filter.has(alike) and shard.find(alike) is None
    assert shard.delete(key(7)) and not shard.delete(key(7)) and shard.find(key(8)) == [8]


def test_index_keeps_live_digests_over_batches(spark):
    docs = documents(spark).where("doc_id is not null").select("doc_id", "text")
    keyed = lambda df: ed.digests(df).drop("text").selectExpr("*", "doc_id as _row")
    one, two = docs.where("doc_id < 10"), docs.where("doc_id >= 10")
    index = cut(ed.apply_changes(ed.empty_index(spark), ed.insertions(keyed(one), 3)))
    index = cut(ed.apply_changes(index, ed.insertions(keyed(two), 3)))
    index = cut(ed.apply_changes(index, ed.deletions(keyed(docs.where("doc_id in (3, 6)")), 3)))
    live = {r["digest"]: (r["keep_id"], r["group_size"]) for r in index.where("digest is not null").collect()}
    groups = defaultdict(list)
    for i, t, *_ in rows():
        if i is not None:
            groups[hashlib.sha256(lower(t)).digest()].append(i)
    gone = {hashlib.sha256(lower(t)).digest() for i, t, *_ in rows() if i in (3, 6)}
    assert {bytes(k): v for k, v in live.items()} == {k: (max(v), len(v)) for k, v in groups.items() if k not in gone}


def test_exact_dedup_awkward_rows(spark):
    got = ed.exact_dedup(documents(spark)).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[hashlib.sha256(lower(t)).hexdigest()].append(i)
    assert len(got) == len(rows())
    kept = defaultdict(int)
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((x for x in ids if x is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    assert ed.exact_dedup(nothing(spark)).count() == 0
    stays = ed.drop_copies(documents(spark))
    assert stays.columns == documents(spark).columns and stays.count() == len(groups)


@pytest.mark.parametrize("size", [4, 5])
def test_near_dedup_awkward_rows(spark, size):
    got = nd.near_dedup(documents(spark), size).collect()
    named = {i: t for i, t, *_ in rows() if i is not None}
    expected = components(named, size, 80)
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == expected[r["doc_id"]]
            assert r["n_shingles"] == len(shingles(named[r["doc_id"]], size))
    orphan = next(r for r in got if r["doc_id"] is None and r["n_shingles"])
    assert orphan["component_id"] == expected[14] and not orphan["kept"]
    heads = [r["component_id"] for r in got if r["kept"] and r["n_shingles"]]
    assert sorted(heads) == sorted({c for i, c in expected.items() if shingles(named[i], size)})
    assert nd.near_dedup(nothing(spark), size).count() == 0


def test_near_dedup_finds_chains_and_crowds(spark):
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(5000)}"
    texts = {}
    shared = [word() for _ in range(30)]
    for group in range(6):  # drifting chains that share a passage
        words = [word() for _ in range(120)] + shared
        for step in range(25):
            texts[group * 100 + step] = " ".join(words)
            words[draw.randrange(120)] = word()
            if step % 3 == 0:
                words[draw.randrange(120)] = word()
    base = [word() for _ in range(100)]  # a crowd around one text, larger than a leaf
    for n in range(150):
        words = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3])):
            words[draw.randrange(100)] = word()
        texts[10_000 + n] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nd.near_dedup(docs, 4).collect()}
    assert got == components(texts, 4, 80)
    kept = nd.drop_near_copies(docs, 4)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_near_dedup_matches_brute_force_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["component_id"] for r in nd.near_dedup(docs, 4).collect()} == components(texts, 4, 80)


def test_near_dedup_finds_a_pair_at_the_threshold_behind_a_frequent_passage(spark):
    passage = " ".join(f"p{i}" for i in range(403))
    text = lambda n, tail: " ".join([passage, *(f"t{n}w{i}" for i in range(tail))])
    # 400 shingles of 500 in common; no tree of the first sixteen keeps these two together for four levels
    texts = {n: text(n, 50) for n in (55, 258)}
    texts |= {n: text(n, 51) for n in range(1000, 1120)}  # 400 of 501 and 502: linked with nothing
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nd.near_dedup(docs, 4).collect()}
    assert got == {n: 55 if n == 258 else n for n in texts}


@pytest.mark.parametrize("level", range(nd.LEVELS))
def test_near_dedup_plants_enough_trees_at_every_level(level):
    assert (1 - 0.8 ** (level + 1)) ** nd.trees_at(level, 80) <= 1e-9
    assert nd.trees_at(level, 100) == nd.TREES


def test_sketches_keep_pairs_at_the_threshold():
    """The least number of equal ranges is one that a sample with replacement falls short of with a chance of 1e-11 at most."""
    for bins in (nd.SKETCH, nd.FINE):
        for n in (1, 10, 60, 200, bins):
            least = math.floor(nd._least_equal(bins, 80)[n])
            below = sum(Fraction(math.comb(n, k)) * Fraction(4, 5) ** k * Fraction(1, 5) ** (n - k) for k in range(least))
            assert below <= Fraction(1, 10**11)
            assert n < 200 or least > 0.55 * n
    whole = np.sort(np.random.default_rng(1).integers(0, 2**64, 400, dtype=np.uint64))
    for bins in (nd.SKETCH, nd.FINE):
        sketch = np.frombuffer(nd._sketch(whole, bins), np.uint8)
        at = [int(x) * bins >> 64 for x in whole]
        assert set(np.flatnonzero(sketch)) == set(at)
        assert all(sketch[k] == min(int(x) for x, y in zip(whole, at, strict=True) if y == k) % 255 + 1 for k in set(at))


def test_large_nodes_meet_in_blocks(spark):
    """Every similar pair of two components comes out once, whatever the blocks, and no pair that is far from similar."""
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**64, (3, 250), dtype=np.uint64)
    sets = []
    for rep in range(90):
        new = draw.integers(0, 2**64, rep % 110, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[rep % 3][len(new) :], new])))
    rows = [(rep, rep // 4 * 4, len(x), nd._sketch(x, nd.SKETCH), nd._sketch(x, nd.FINE)) for rep, x in enumerate(sets)]
    alike = {}
    for a, ca, *_ in rows:
        for b, cb, *_ in rows:
            if a < b and ca != cb:
                alike[a, b] = len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    want = {pair for pair, x in alike.items() if x >= 0.8}
    assert len(want) > 50 and sum(0.65 <= x < 0.8 for x in alike.values()) > 50
    names = ["rep", "comp", "n_shingles", "sketch", "fine", "block"]
    seen = []
    for blocks in (1, 3):
        found = []
        for i in range(blocks):
            for j in range(i, blocks):
                part = [(*r, r[0] % blocks) for r in rows if r[0] % blocks in (i, j)]
                columns = list(zip(*part, strict=True))
                table = pa.table({**dict(zip(names, map(list, columns), strict=True)), "i": [i] * len(part), "j": [j] * len(part)})
                out = nd._block_pairs(80)(table)
                found += list(zip(*(out[c].to_pylist() for c in ("a", "b")), strict=True))
        assert len(found) == len(set(found)) and set(found) >= want
        assert all(alike[pair] > 0.72 for pair in found)
        seen.append(set(found))
    assert seen[0] == seen[1]
    reps = spark.createDataFrame([(r, k, n) for r, _, n, k, _ in rows], "rep long, sketch binary, n_shingles long")
    fine = spark.createDataFrame([(r, k) for r, *_, k in rows], "rep long, fine binary")
    members = spark.createDataFrame([(7, 2000, r, c) for r, c, *_ in rows], "node long, n long, rep long, comp long")
    assert {tuple(r) for r in nd.likely_in_large(members, reps, fine, 80).collect()} == seen[0]


def test_batches_of_long_texts_are_small(spark):
    rows_ = spark.range(300).repartition(1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    got = [r["n"] for r in cut_in_small_batches(rows_.mapInArrow(sizes, "n long")).collect()]
    assert sum(got) > 300 * 100_000 and max(got) < 2 * BATCH_BYTES


def test_blocks_compare_few_sketches_at_a_time(monkeypatch):
    n, seen, whole = 200, [], nd._not_ruled_out

    def counted(a, b, na, nb, similarity):
        seen.append(a.nbytes)
        return whole(a, b, na, nb, similarity)

    monkeypatch.setattr(nd, "_not_ruled_out", counted)
    tokens = [nd.shingle_set(" ".join(f"w{(i % 4) * 5000 + k + i}" for k in range(900)), 4) for i in range(n)]
    kinds = {"sketch": nd.SKETCH, "fine": nd.FINE}
    table = pa.table({
        "rep": np.arange(n), "comp": np.arange(n), "n_shingles": np.array([len(x) for x in tokens]), "block": np.zeros(n, np.int64),
        "i": np.zeros(n, np.int64), "j": np.zeros(n, np.int64), **{k: pa.array([nd._sketch(x, w) for x in tokens], pa.binary()) for k, w in kinds.items()},
    })
    out = nd._block_pairs(80)(table)
    got = set(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))
    similar = {
        (i, j) for i in range(n) for j in range(i + 1, n)
        if 100 * (c := len(np.intersect1d(tokens[i], tokens[j]))) >= 80 * (len(tokens[i]) + len(tokens[j]) - c)
    }
    assert similar and similar <= got
    assert max(seen) <= nd.SKETCHES_AT_ONCE
