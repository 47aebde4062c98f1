import numpy as np

from helpers import documents, nothing, rows
from netloom.llm import weak_quality as wq


def test_estimates_recover_planted_rates():
    rng = np.random.default_rng(1)
    n, m = 40_000, len(wq.HEURISTICS)
    truth = rng.random(n) < 0.8
    right = rng.uniform(0.75, 0.95, m)
    counts = {}
    for good in truth:
        cast = [(1 if (rng.random() < right[j]) == good else -1) if rng.random() < 0.8 else 0 for j in range(m)]
        code = wq._code(cast)
        assert wq._votes_of(code) == cast
        counts[code] = counts.get(code, 0) + 1
    model = wq.estimate(counts)
    assert abs(model["prior"] - 0.8) < 0.02
    assert np.abs(model["rates"][1, :, 1] - right).max() < 0.02 and np.abs(model["rates"][0, :, 0] - right).max() < 0.03


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = wq.weak_quality(docs, wq.fit(docs)).join(labels, "doc_id").select("kept", "weak_label", "quality").collect()
    good, bad = ([r for r in out if r["quality"] == q] for q in (1, 0))
    assert sum(r["kept"] for r in good) / len(good) > 0.97
    assert sum(r["kept"] for r in bad) / len(bad) < 0.15
    assert sum((r["weak_label"] > 0.5) == (r["quality"] == 1) for r in out) / len(out) > 0.95


def test_awkward_rows(spark):
    docs = documents(spark).drop("score", "kept").withColumnRenamed("digest", "score")
    model = wq.fit(docs, limit=5)
    got = wq.weak_quality(docs, model).collect()
    assert len(got) == len(rows()) and not any(r["kept"] for r in got if not r["n_words"])
    empty = wq.fit(nothing(spark))
    assert empty["bias"] == 0.0 and wq.weak_quality(nothing(spark), empty).count() == 0
