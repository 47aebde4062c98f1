"""Awkward rows and plain-Python counterparts of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^ \t-\r]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, digest string"


def rows(seed: int = 1) -> list[tuple]:
    """Documents with nulls, empty and long texts, ties, repeated rows and columns whose names clash."""
    draw = random.Random(seed)
    vocabulary = ["la", "the", "Über", "naïve", "漢字", "x1", "don't", "end.", "A", "of", "re", "ing", "word", "🙂"]
    text = lambda n: " ".join(draw.choice(vocabulary) + draw.choice(["", "", "s", "er"]) for _ in range(n))
    base = [text(80) for _ in range(6)]
    texts = [
        None, "", " \t\n", "one", "one two three", "ONE two THREE", base[0], base[0].upper(), base[0], base[1],
        base[1].replace(" ", "  ", 3), base[1].rsplit(" ", 1)[0] + " changed", base[2], base[2] + " tail", base[3], base[4],
        base[5] + "\n" + base[5], "same line\n" * 40, "a" * 5000, text(4000), "\x00 odd ​ chars ▁ here", "go " * 300,
    ]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}", 0, -1.0, None, "clash") for i, t in enumerate(texts)]
    out += [out[6], out[6], out[0], (None, base[3], None, None, None, None, None, None), (None, None, "en", "s1", 1, 0.0, True, "")]
    return out


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def lower(text: str | None) -> bytes:
    return (text or "").encode().lower()


def shingles(text: str | None, size: int) -> frozenset:
    words = lower(text).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(texts: dict, size: int, similarity: int) -> dict:
    """Smallest key reachable, by comparing every pair of distinct sets."""
    of = {k: shingles(t, size) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    same = defaultdict(list)
    for k, s in of.items():
        same[s].append(k)
    sets = [s for s in same if s]
    for s in sets:
        for k in same[s]:
            parent[root(k)] = root(same[s][0])
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if 100 * len(a & b) >= similarity * len(a | b):
                parent[root(same[a][0])] = root(same[b][0])
    least = {}
    for k in texts:
        least[root(k)] = min(least.get(root(k), k), k)
    return {k: least[root(k)] for k in texts}


def quality_counts(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )
