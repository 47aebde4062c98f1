"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, all in built-in functions.

Word unigrams and bigrams are hashed into ``buckets``. Two smoothed multinomials over the
buckets, one of the trusted texts and one of the whole corpus, give each bucket a log ratio; the
score of a document is the mean ratio of its n-grams (after Xie et al., 2023, "Data selection for
language models via importance resampling", with a threshold in place of resampling).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import words_of

BUCKETS = 8192
#: Ratios are kept as integers of this many to one, so sums do not depend on their order.
UNIT = 1_000_000
#: Documents whose mean log ratio lies below are rejected.
THRESHOLD = -0.05
#: The trusted multinomial is fitted on at most this many labelled documents; the raw one on all documents.
TRUSTED = 20_000


def _bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def _pairs(docs: DataFrame, buckets: int) -> DataFrame:
    """``(bucket)``: one row per unigram and bigram, made by generators that stay in compiled code."""
    words = docs.select(words_of("text").alias("w")).where("size(w) > 0")
    rows = words.select(F.inline(F.arrays_zip("w", F.expr("slice(w, 2, size(w))").alias("x"))).alias("a", "b"))
    hashed = rows.select(F.xxhash64("a").alias("a"), F.when(F.col("b").isNotNull(), F.xxhash64("b")).alias("b"))
    one = _bucket(F.col("a"), buckets)
    two = F.when(F.col("b").isNotNull(), _bucket(F.xxhash64("a", "b"), buckets))
    return hashed.select(F.explode(F.array(one, two)).alias("bucket")).where("bucket is not null")


def _counts(docs: DataFrame, buckets: int) -> list[int]:
    """N-grams per bucket; ``buckets`` rows reach the driver, however large the corpus is."""
    out = [0] * buckets
    for row in _pairs(docs, buckets).groupBy("bucket").count().collect():
        out[row["bucket"]] = row["count"]
    return out


def fit_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Log ratio trusted to raw of every bucket, in units; all zero if no trusted text has a word."""
    good = _counts(trusted, buckets)
    if not any(good):
        return [0] * buckets
    raw = _counts(docs, buckets)
    n_good, n_raw = sum(good) + buckets, sum(raw) + buckets
    return [round(UNIT * (math.log((g + 1) / n_good) - math.log((r + 1) / n_raw))) for g, r in zip(good, raw, strict=True)]


def quality_rules(docs: DataFrame, ratios: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and the counts, ``score`` and verdicts of every document.

    One narrow pass: no shuffle, no join; the ratios travel as a constant. Null and empty texts
    have no words, fail the base rule and score null. Columns of the input that bear a name given
    out here, in letters of either case, are replaced; all other names may clash. Repeated rows are judged one by one, alike.
    """
    buckets = len(ratios)
    ratio = F.lit(",".join(map(str, ratios)))
    ratio = F.split(ratio, ",").cast("array<bigint>")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUTPUT]).alias("_given")
    text = F.coalesce(F.col("text"), F.lit(""))
    at_words = docs.select(own, text.alias("_text"), words_of("text").alias("_w"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    counted = at_words.select(
        "_given",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    places = lambda size: F.expr(f"if(n_words >= {size}, sequence(0, cast(n_words as int) - {size}), array())")
    windows = counted.select(
        "_given",
        "n_words", "word_chars", "n_symbols", "_h",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(places(3), lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2))).alias("_g"),
        F.aggregate("_h", F.lit(0).cast("long"), lambda s, h: s + F.get(ratio, _bucket(h, buckets))).alias("_one"),
        F.aggregate(
            places(2),
            F.lit(0).cast("long"),
            lambda s, i: s + F.get(ratio, _bucket(F.xxhash64(F.get("_h", i), F.get("_h", i + 1)), buckets)),
        ).alias("_two"),
    )
    # windows found twice: equal neighbours after a sort, so long texts cost n log n
    repeats = F.size(F.array_distinct("_g")) < F.size("_g")
    tagged = F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    ordered = windows.withColumn("_s", F.when(repeats, F.sort_array(tagged)))
    same = lambda x, j: F.get("_s", j)["g"].eqNullSafe(x["g"])
    found = F.filter("_s", lambda x, j: ((j > 0) & same(x, j - 1)) | same(x, j + 1))
    starts = F.sort_array(F.transform(found, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(3), i - s["last"])).alias("sum")),
        lambda s: s["sum"],
    )
    n_grams = F.col("n_words") * 2 - 1
    judged = ordered.select(
        "_given",
        "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.when(F.col("n_words") > 0, (F.col("_one") + F.col("_two")) / n_grams / UNIT).alias("score"),
        (F.col("_one") + F.col("_two") >= F.round(F.lit(threshold * UNIT)).cast("long") * n_grams).alias("_fits"),
        # a filter on the verdict must not be pushed below this point, where it would repeat all of the above many times over
        (F.spark_partition_id() >= 0).alias("_here"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        judged.withColumn("base_failed", failed & F.col("_here"))
        .withColumn("kept", ~F.col("base_failed") & F.col("_fits") & F.col("_here"))
        .select("_given.*", *OUTPUT)
    )


OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


def trusted_texts(docs: DataFrame, labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """Whole texts of at most ``limit`` documents labelled good, those whose ids hash lowest.

    The bound keeps the ids fit for a broadcast, so no text is shuffled to find them. Null ids match nothing.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
