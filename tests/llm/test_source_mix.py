from collections import defaultdict

import pytest

from helpers import documents, nothing, rows
from netloom.llm import source_mix as sm


def plain_rake(cells, targets, sweeps=500):
    weight = {c: n / sum(cells.values()) for c, n in cells.items()}
    for _ in range(sweeps):
        for d in range(3):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {c: w * targets[d].get(c[d], 0) / sums[c[d]] if sums[c[d]] else 0.0 for c, w in weight.items()}
    return weight


def plain_probabilities(cells, weight, budget):
    total, sure, scale = sum(cells.values()), set(), 0.0
    rate = {c: weight[c] / n if n else 0.0 for c, n in cells.items()}
    while True:
        open_ = sum(weight[c] for c in cells if c not in sure)
        if not open_:
            break
        scale = (budget * total - sum(cells[c] for c in sure)) / open_
        now = {c for c in cells if rate[c] * scale >= 1}
        if now <= sure:
            break
        sure |= now
    return {c: 1.0 if c in sure else min(1.0, rate[c] * scale) for c in cells}


def test_raking_matches_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sm.mix_sources(docs, budget=0.6).collect()
    cells = defaultdict(int)
    for r in got:
        cells[r["source"], r["lang"], r["topic"]] += r["n_words"]
    total = sum(cells.values())
    targets = []
    for d in range(3):
        sums = defaultdict(int)
        for c, n in cells.items():
            sums[c[d]] += n
        powers = {v: n**sm.TEMPERATURE for v, n in sums.items() if n}
        targets.append({v: x / sum(powers.values()) for v, x in powers.items()})
    weight = plain_rake(cells, targets)
    chance = plain_probabilities(cells, weight, 0.6)
    for r in got:
        cell = r["source"], r["lang"], r["topic"]
        assert r["weight"] == pytest.approx(weight[cell], rel=1e-4, abs=1e-12)
        assert r["probability"] == pytest.approx(chance[cell], rel=1e-4, abs=1e-9)
    assert sum(r["probability"] * r["n_words"] for r in got) == pytest.approx(0.6 * total, rel=1e-6)
    drawn = sum(r["n_words"] for r in got if r["sampled"])
    assert 0.4 * total < drawn < 0.8 * total
    again = sm.mix_sources(docs, budget=0.6).where("sampled").select("doc_id").collect()
    assert {r["doc_id"] for r in again} == {r["doc_id"] for r in got if r["sampled"]}


def test_stated_targets_hold(spark):
    docs = spark.createDataFrame(
        [(i, "w " * 10, ["en", "fr"][i % 2], ["a", "b"][i % 3 == 0]) for i in range(600)], "doc_id long, text string, lang string, source string"
    )
    share = lambda x: spark.createDataFrame(x, "value string, share double")
    targets = {"source": share([("a", 0.5), ("b", 0.5)]).withColumnRenamed("value", "source"), "lang": share([("en", 0.2), ("fr", 0.8)]).withColumnRenamed("value", "lang")}
    got = sm.mix_sources(docs, targets, budget=0.3).collect()
    expected = defaultdict(float)
    for r in got:
        expected[r["source"]] += r["probability"]
        expected[r["lang"]] += r["probability"]
    assert expected["a"] == pytest.approx(expected["b"], rel=1e-4) and expected["fr"] == pytest.approx(4 * expected["en"], rel=1e-4)
    assert got[0]["miss"] <= 1 + sm.TOLERANCE


def test_awkward_rows(spark):
    got = sm.mix_sources(documents(spark).withColumnRenamed("n_chars", "weight"))
    assert got.count() == len(rows()) and got.where("probability is null or sampled is null").count() == 0
    assert sm.mix_sources(nothing(spark)).count() == 0


def test_clashing_names_are_carried(spark):
    """Names of the inside stay as they are, names given out are replaced whatever their case."""
    docs = spark.createDataFrame(
        [(i, f"words {i} " * (i + 1), "en", "s", i, f"x{i}", -1.0) for i in range(6)], "doc_id long, text string, lang string, source string, _topic long, row string, Weight double"
    )
    found = sm.mix_sources(docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "_topic", "row", "topic", "n_words", "weight", "probability", "sampled", "miss"]
    assert sorted(tuple(r)[:6] for r in found.collect()) == sorted(tuple(r)[:6] for r in docs.collect())
    assert {r["n_words"] for r in found.collect()} == {2 * (i + 1) for i in range(6)}
    assert sm.mix_sources(docs, carry=["row"]).columns == ["row", "topic", "n_words", "weight", "probability", "sampled", "miss"]
