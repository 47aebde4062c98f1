import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from helpers import documents, nothing, rows
from netloom.llm import target_resample as tr

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, runs):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, runs + 1) if i + k <= len(words)]


def expected(docs, target, runs, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, runs)[1])
    t = Counter(bucket(f) for x in target for f in features(x, runs)[1])
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(buckets)}
    out = []
    for doc_id, text in docs:
        n_words, found = features(text, runs)
        weight = math.floor(sum(gain[bucket(f)] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    high = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for place, r in enumerate(high[: percent * len(high) // 100], 1):
        r[5] = place
    return out


def key(r):
    return [(x is not None, x or 0) for x in r]


@pytest.mark.parametrize(("runs", "head"), [(1, 20_000), (1, 3), (2, 5), (3, 4)])
def test_against_plain_python(spark, runs, head):
    docs = documents(spark)
    target = ["The word of naïve 漢字", None, "", "re ing the LA la of x1"]
    table = spark.createDataFrame([(t,) for t in target], "text string")
    found = tr.importance_resample(docs, table, runs, 512, 50, 20, head=head)
    assert found.columns == ["row", "n_words", "n_features", "weight", "score", "rank"]
    assert set(found.select("row.*").columns) == set(docs.columns)
    got = [[r["row"]["doc_id"], *r[1:]] for r in found.collect()]
    want = expected([(r[0], r[1]) for r in rows()], target, runs, 512, 50, 20)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[5] for r in got)
    assert {r["row"]["score"] for r in found.collect()} == {-1.0, 0.0, None}


def test_head_does_not_change_totals(spark):
    docs = documents(spark)
    plain = tr.bucket_totals(docs, tr.Head(), 2, 97)
    assert plain == tr.bucket_totals(docs, tr.fit_head(docs, 2, 6), 2, 97)
    assert sum(plain) == sum(len(features(r[1], 2)[1]) for r in rows())


def test_long_texts_are_cut_between_words():
    text = ("naïve Über words " * 500).encode()
    whole = [w for b in tr.word_blocks(text) for w in b]
    for block in (1, 7, 64, 5000):
        assert [w for b in tr.word_blocks(text, block) for w in b] == whole
        joined = [c for b, k in tr._carried(tr.word_blocks(text, block), 3) for c in tr._run_crcs(tr.Head(), b, k, 3)]
        assert sorted(joined) == sorted(zlib.crc32(f.encode()) for f in features(text.decode(), 3)[1])


def test_frequent_words_survive_the_summary():
    kept = tr._Frequent(4)
    stream = [f"w{i}" for i in range(300)] + ["the"] * 200 + [f"v{i}" for i in range(300)] + ["of"] * 250
    for at in range(0, len(stream), 10):
        kept.add(stream[at : at + 10])
    kept.shrink()
    assert {"the", "of"} <= set(kept.counts) and len(kept.counts) <= 4


def test_empty_tables(spark):
    empty = nothing(spark)
    assert tr.importance_resample(empty, empty).count() == 0
    found = tr.importance_resample(documents(spark), empty, percent=100, least_words=0)
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, len(rows()) + 1))
