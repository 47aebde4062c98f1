import math
import random

import pytest

from netloom.operators.sets import set_edges, share_of_pairs


def awkward(seed=3):
    draw = random.Random(seed)
    items = [f"i{k}" for k in range(60)]
    sets = [draw.choices(items, weights=[1 / (k + 1) for k in range(60)], k=draw.randint(1, 14)) for _ in range(140)]
    sets += [s[:-1] + [draw.choice(items)] for s in sets[:40]] + [sets[0]] * 5 + [["i0"]] * 7 + [["i0", "i1"]] * 3
    sets += [[], None, [None], [None, "i5", "i5"], ["i5"], items, items[:-1], items[1:]]
    return list(enumerate(sets))


SIMILARITY = {
    "jaccard": lambda a, b: len(a & b) / len(a | b),
    "dice": lambda a, b: 2 * len(a & b) / (len(a) + len(b)),
    "cosine": lambda a, b: len(a & b) / math.sqrt(len(a) * len(b)),
}


def brute(rows, measure, bound, inclusive):
    sets = {i: frozenset(x for x in s or () if x is not None) for i, s in rows}
    out = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                d = 1 - SIMILARITY[measure](sets[a], sets[b])
                if d <= bound if inclusive else d < bound:
                    out[a, b] = round(d, 9)
    return out


@pytest.mark.parametrize("measure", ["jaccard", "dice", "cosine"])
@pytest.mark.parametrize(("bound", "inclusive", "tile"), [(0.5, True, 10_000), (0.5, False, 5), (0.2, False, 10_000), (0.8, True, 40)])
def test_against_all_pairs(spark, measure, bound, inclusive, tile):
    rows = awkward()
    df = spark.createDataFrame(rows, "key long, things array<string>")
    found = set_edges(df, "key", "things", bound, measure, inclusive, tile)
    got = {(r["source"], r["target"]): round(r["dist"], 9) for r in found.rows().collect()}
    assert got == brute(rows, measure, bound, inclusive)
    # classes are equal sets under their least id
    members = {r["id"]: r["class"] for r in found.members.collect()}
    sets = {i: frozenset(x for x in s or () if x is not None) for i, s in rows}
    assert members == {i: min(j for j in sets if sets[j] == s) for i, s in sets.items() if s}
    pairs = [tuple(r) for r in found.candidates.collect()]
    assert len(pairs) == len(set(pairs))  # no pair is compared twice


def test_candidates_stay_near_the_answer(spark):
    """Baskets of a hot item and rare ones: the hot item brings no two of them together."""
    draw = random.Random(1)
    rows = [(i, [0, *draw.sample(range(1, 3000), 6)]) for i in range(1500)]
    rows += [(1500 + i, r[:6] + [5000 + i]) for i, (_, r) in enumerate(rows[:200])]
    found = set_edges(spark.createDataFrame(rows, "id long, items array<int>"), "id", "items", 0.3)
    links = found.edges.count()
    assert links >= 200
    assert found.candidates.count() <= 10 * links
    assert share_of_pairs(found) < 0.001


def test_bounds_and_empty_tables(spark):
    df = spark.createDataFrame([], "id long, items array<string>")
    found = set_edges(df, "id", "items", 0.5)
    assert found.rows().count() == 0 and found.members.count() == 0
    for bad in ({"max_dist": 1.5}, {"max_dist": 1.0, "inclusive": True}, {"max_dist": 0.5, "measure": "overlap"}):
        with pytest.raises(ValueError):
            set_edges(df, "id", "items", **bad)
