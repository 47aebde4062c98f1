import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
import xxhash

import corpus_pipeline
from helpers import components, documents, lower, quality_counts
from netloom.llm import quality_rules as qr
from netloom.llm import source_mix as sm
from netloom.runtime import cut
from test_quality_rules import grams
from test_source_mix import plain_probabilities, plain_rake


def test_stages_follow_each_other(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, folder))
        sizes.append(docs.count())
        if name != "piece_ids":
            assert docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[4] == sizes[5] > 0
    assert docs.where("not round_trip").count() == 0


def test_stages_take_awkward_rows(spark, tmp_path):
    documents(spark).select("doc_id").selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, str(tmp_path)))


def plain_rules(docs, labels):
    good = sorted({i for i, quality in labels if quality == 1})
    n = qr.BUCKETS
    raw = Counter(g for t in docs.values() for g in grams(t, n))
    trusted = Counter(g for i in good if i in docs for g in grams(docs[i], n))
    n_raw, n_good = sum(raw.values()) + n, sum(trusted.values()) + n
    ratio = [round(qr.UNIT * (math.log((trusted[b] + 1) / n_good) - math.log((raw[b] + 1) / n_raw))) for b in range(n)]
    out = set()
    for i, text in docs.items():
        words, _, _, _, repeats = quality_counts(text)
        found = grams(text, n)
        fits = sum(ratio[g] for g in found) >= round(qr.THRESHOLD * qr.UNIT) * (2 * words - 1)
        if words >= 50 and 100 * repeats <= 50 * words and fits:
            out.add(i)
    return out


def plain_exact(docs):
    last = {}
    for i in sorted(docs):
        last[lower(docs[i])] = i
    return set(last.values())


def plain_near(docs):
    return set(components(docs, 5, 80).values())


def plain_mix(docs, about):
    def topic(text):
        return next((name for name, pattern in sm.TOPIC_RULES if re.search(pattern, text)), "prose")

    cell = {i: (about[i][0], about[i][1], topic(t)) for i, t in docs.items()}
    cells = defaultdict(int)
    for i, t in docs.items():
        cells[cell[i]] += quality_counts(t)[0]
    targets = []
    for d in range(3):
        sums = defaultdict(int)
        for c, n in cells.items():
            sums[c[d]] += n
        powers = {v: n**sm.TEMPERATURE for v, n in sums.items()}
        targets.append({v: x / sum(powers.values()) for v, x in powers.items()})
    chance = plain_probabilities(cells, plain_rake(cells, targets), sm.BUDGET)
    start = xxhash.xxh64_intdigest((0).to_bytes(4, "little"), 42)
    draw = lambda i: (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), start) >> 11) / 2**53
    return {i for i in docs if draw(i) < chance[cell[i]]}


def test_run_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet").collect()
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    about = {r["doc_id"]: (r["source"] or sm.UNKNOWN, r["lang"] or sm.UNKNOWN) for r in table}
    held, sizes = {r["doc_id"]: r["text"] or "" for r in table}, []
    assert len(held) == len(table)
    for stage in (lambda d: plain_rules(d, labels), plain_exact, plain_near, lambda d: plain_mix(d, about)):
        kept = stage(held)
        sizes.append(len(held) - len(kept))
        held = {i: t for i, t in held.items() if i in kept}
    assert all(sizes) and held  # every stage has something to drop
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == {i: library.encode(t) for i, t in held.items()}


def test_columns_come_out_as_they_went_in(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "concat('w', doc_id) AS weight", "doc_id AS Kept", "lang AS _row", "doc_id AS topic")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name in ("quality_rules", "source_mix"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
        assert out.columns == docs.columns
        assert all(before[r["doc_id"]] == r for r in out.collect())
