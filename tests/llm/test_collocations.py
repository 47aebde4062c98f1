import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import documents, nothing, rows
from netloom.llm import collocations as co


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(table, longest, least, share, keep):
    counts = defaultdict(Counter)
    for _, text, lang, *_ in table:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low(text)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        covered = {}
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    part = g[i : i + k]
                    covered[part] = max(covered.get(part, 0), a)
        found = []
        for g, a in candidates.items():
            if 100 * covered.get(g, 0) >= share * a:
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), l, r))
        n = sum(a for g, a in f.items() if len(g) == 1)
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "head", "keep"), [(3, 3, 1 << 17, 2000), (4, 2, 3, None), (2, 4, 0, 7)])
def test_against_plain_python(spark, longest, least, head, keep):
    table = rows() + [(100 + i, "To be, or not to be: that is\tthe  question! to BE or not to be?" * 2, None if i % 2 else "en", "s", 0, 0.0, None, "") for i in range(5)]
    docs = spark.createDataFrame(table, documents(spark).schema)
    found = co.collocations(docs, longest, least, 50, keep, head)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r) for r in found.collect())
    assert got == expected(table, longest, least, 50, keep)
    assert got


def test_empty_tables_and_clashing_names(spark):
    assert co.collocations(nothing(spark)).count() == 0
    assert co.collocations(spark.createDataFrame([(1, None, None)], "n long, text string, lang string")).count() == 0
    odd = spark.createDataFrame([("a b a b", "en", 1, "x", 2)] * 6, "text string, lang string, i1 long, phrase string, n int")
    assert [tuple(r)[:5] for r in co.collocations(odd, least=6, longest=2).orderBy("rank").collect()] == [("en", 1, "a b", 12, 12), ("en", 2, "b a", 6, 12)]


def brute(stream, k):
    at = [i for i in range(len(stream) - k + 1) if all(stream[i : i + k])]
    return Counter(tuple(int(x) for x in stream[i : i + k]) for i in at)


@pytest.mark.parametrize("k", [2, 3, 5])
def test_group_counts_of_a_stream(k):
    draw = np.random.default_rng(k)
    for n in (0, 1, 4, 300):
        stream = draw.choice([0, 0, 1, 2, 3, -(1 << 63), 1 << 62], n)
        columns, counts = co._counted(stream, k)
        assert {tuple(int(c[i]) for c in columns): int(n) for i, n in enumerate(counts)} == brute(stream, k)


@pytest.mark.parametrize("k", [2, 3])
def test_runs_hold_the_windows_of_the_next_length(k):
    draw = np.random.default_rng(k)
    stream = draw.integers(0, 6, 4000)
    chosen = list(brute(stream, k))[::2]
    columns = [np.array([g[i] for g in chosen]) for i in range(k)]
    table = np.zeros(co.BITS // 64, np.uint64)
    slots = co._slots(columns)
    np.bitwise_or.at(table, slots >> np.uint64(6), np.uint64(1) << (slots & np.uint64(63)))
    out, offsets = co._runs(stream, k, table)
    want = Counter({g: n for g, n in brute(stream, k + 1).items() if g[:k] in set(chosen) and g[1:] in set(chosen)})
    assert brute(out, k + 1) == want
    assert offsets[0] == 0 and offsets[-1] == len(out) and len(offsets) > 2
    assert all(out[o - 1] == 0 for o in offsets[1:])  # rows are cut between runs


def test_blocks_end_between_words(monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 5)
    text = "naïve Über. words,\tand\nmore of them ".encode() * 20
    joined = b"".join(co._blocks(text, co._AS_PIECES))
    assert joined == text.translate(co._AS_PIECES)
    assert [w for b in co._blocks(text, co._AS_WORDS) for w in b.split()] == text.translate(co._AS_WORDS).split()
