import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import WORD, documents, nothing, quality_counts, rows
from netloom.llm import quality_rules as qr


def hashed(data: bytes, seed: int = 42) -> int:
    out = xxhash.xxh64_intdigest(data, seed)
    return out - (1 << 64) if out >> 63 else out


def grams(text, buckets):
    words = [w.encode() for w in WORD.findall(text or "")]
    one = [hashed(w) for w in words]
    two = [hashed(b.to_bytes(8, "little", signed=True), a % (1 << 64)) for a, b in _chained(one)]
    return [x % buckets for x in one + two]


def _chained(one):
    """xxhash64(a, b) of two longs hashes b with the hash of a as its seed."""
    return [(hashed(a.to_bytes(8, "little", signed=True)), b) for a, b in zip(one, one[1:], strict=False)]


def test_against_plain_python(spark):
    docs = documents(spark)
    trusted = docs.where("doc_id in (6, 9, 12)")
    ratios = qr.fit_ratios(docs, trusted, 512)
    texts = [r[1] for r in rows()]
    raw = Counter(g for t in texts for g in grams(t, 512))
    good = Counter(g for r in rows() if r[0] in (6, 9, 12) for g in grams(r[1], 512))
    n_good, n_raw = sum(good.values()) + 512, sum(raw.values()) + 512
    expected = [round(1e6 * (math.log((good[b] + 1) / n_good) - math.log((raw[b] + 1) / n_raw))) for b in range(512)]
    assert ratios == expected
    got = qr.quality_rules(docs, ratios, 0.0).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, lines, repeats = quality_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        failed = n < 50 or 100 * repeats > 50 * n
        assert r["base_failed"] == failed
        found = grams(r["text"], 512)
        total = sum(expected[g] for g in found)
        assert r["kept"] == (not failed and total >= 0)
        assert r["score"] is None if not n else r["score"] == pytest.approx(total / len(found) / 1e6)


def test_no_trusted_text_leaves_the_base_rules(spark):
    docs = documents(spark)
    ratios = qr.fit_ratios(docs, docs.where("false"), 64)
    assert set(ratios) == {0}
    assert qr.quality_rules(docs, ratios).where("kept = base_failed").count() == 0


def test_empty_table_and_bounded_trust(spark):
    ratios = qr.fit_ratios(nothing(spark), nothing(spark), 16)
    assert qr.quality_rules(nothing(spark), ratios).count() == 0
    docs = documents(spark)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert qr.trusted_texts(docs, labels, 3).select("doc_id").distinct().count() == 3
    assert qr.trusted_texts(docs, labels).where("doc_id is null").count() == 0


def test_labels_are_separated(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = qr.quality_rules(docs, qr.fit_ratios(docs, qr.trusted_texts(docs, labels))).where("not base_failed").join(labels, "doc_id")
    shares = {r["quality"]: r["s"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert shares[1] > 0.99 and shares[0] < 0.1


def test_names_of_the_inside_may_clash(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a", 2, 3.5, "old")], "doc_id long, text string, _w string, _h long, _given double, N_Words string")
    found = qr.quality_rules(docs, [0] * 16)
    assert found.columns == ["doc_id", "text", "_w", "_h", "_given", *qr.OUTPUT]
    assert tuple(found.first())[:6] == (1, text, "a", 2, 3.5, 60)
