"""Importance resampling towards a target text (after Xie et al., 2023), with a head-tail vocabulary.

Features are runs of 1 to ``runs`` consecutive words; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``.
The frequent words (the head) are found by mergeable summaries over the whole corpus. Their CRC states, and the states
of frequent pairs, are broadcast: a run is continued from the state of the run before it, so ``crc32(b" next", state)``
replaces hashing the run anew. Whatever is not in the head takes its CRC directly. Both ways add to the same bucket totals, which are
therefore exact whatever the head holds.

A document's weight is the floored mean of its features' log gains, its score the weight plus a Gumbel draw from its id;
the highest scores are drawn, which is sampling without replacement in proportion to the importance.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import cut
from netloom.runtime import dense_index

BUCKETS = 10_000
#: Entries of the broadcast head, each of at most ``LONGEST`` bytes: 20,000 words and as many pairs are below 3 MB.
HEAD = 20_000
LONGEST = 64
#: Words of one text are looked at in blocks of about this many bytes.
BLOCK = 1 << 20
#: A worker's tables of words are emptied at this many entries.
HELD = 200_000
GUMBEL_SPAN = 4294967296

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
#: A-Z in lower case, every byte that is in no word as a space.
_FOLD = bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_blocks(text: bytes | None, block: int = BLOCK) -> Iterator[list[bytes]]:
    """Words of a text, lower-cased, in lists of bounded size; a word is never cut."""
    text = text or b""
    if len(text) <= block:
        yield text.translate(_FOLD).split()
        return
    start = 0
    while start < len(text):
        stop = start + block
        while stop < len(text) and _FOLD[text[stop]] != 32:
            stop += 1
        yield text[start:stop].translate(_FOLD).split()
        start = stop


class Head:
    """CRC states of the frequent words and of the frequent pairs of words."""

    def __init__(self, words: Sequence[bytes] = (), pairs: Sequence[tuple[bytes, bytes]] = ()):
        self.words = {w: zlib.crc32(w) for w in words}
        self.pairs = {(a, b): zlib.crc32(b" " + b, self.state(a)) for a, b in pairs}

    def state(self, word: bytes) -> int:
        found = self.words.get(word)
        return zlib.crc32(word) if found is None else found

    def runs(self, words: Sequence[bytes], runs: int) -> Iterator[int]:
        """CRC of every run of 1 to ``runs`` words."""
        for i, word in enumerate(words):
            crc = self.state(word)
            yield crc
            for k in range(1, min(runs, len(words) - i)):
                longer = self.pairs.get((word, words[i + 1])) if k == 1 else None
                crc = zlib.crc32(b" " + words[i + k], crc) if longer is None else longer
                yield crc


def _carried(blocks: Iterator[list[bytes]], runs: int) -> Iterator[tuple[list[bytes], int]]:
    """Blocks with the last ``runs - 1`` words of the block before in front, and how many of those there are."""
    last: list[bytes] = []
    for words in blocks:
        joined = last + words
        yield joined, len(last)
        last = joined[-(runs - 1) :] if runs > 1 else []


def _run_crcs(head: Head, words: list[bytes], carried: int, runs: int) -> Iterator[int]:
    """CRCs of the runs that end after the carried words."""
    yield from head.runs(words[carried:], runs)
    for i in range(max(0, carried - runs + 1), carried):  # runs that begin among the carried words
        crc = head.state(words[i])
        for k in range(1, min(runs, len(words) - i)):
            crc = zlib.crc32(b" " + words[i + k], crc)
            if i + k >= carried:
                yield crc


class _Frequent:
    """Misra-Gries summary: every key with more than ``n / size`` of ``n`` occurrences is in it."""

    def __init__(self, size: int):
        self.size, self.counts = size, Counter()

    def add(self, keys) -> None:
        self.counts.update(keys)
        if len(self.counts) > 8 * self.size:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.size:
            least = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = Counter({k: n - least for k, n in self.counts.items() if n > least})


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("text"))


def fit_head(docs: DataFrame, runs: int = 1, size: int = HEAD) -> Head:
    """The most frequent words, and for longer runs pairs of words, of the whole corpus; at most ``size`` of each.

    A task keeps a bounded summary; the summaries are added up and the first ``size`` by count reach the driver.
    """

    def summarise(batches):
        words, pairs = _Frequent(size), _Frequent(size)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for block, carried in _carried(word_blocks(text), min(runs, 2)):
                    words.add(w for w in block[carried:] if len(w) <= LONGEST)
                    if runs > 1:
                        pairs.add(p for p in zip(block, block[1:], strict=False) if len(p[0]) + len(p[1]) < LONGEST)
        for kept, joined in ((words, False), (pairs, True)):
            kept.shrink()
            names = [b" ".join(k) if joined else k for k in kept.counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([joined] * len(names), pa.bool_()), pa.array(list(kept.counts.values()), pa.int64())],
                names=["feature", "pair", "n"],
            )

    found = _texts(docs).mapInArrow(summarise, "feature binary, pair boolean, n long")
    summed = cut(found.groupBy("pair", "feature").agg(F.sum("n").alias("n")))
    first = lambda pair: [
        bytes(r[0]) for r in summed.where(F.col("pair") == pair).orderBy(F.desc("n"), "feature").limit(size).select("feature").collect()
    ]
    return Head(first(False), [tuple(p.split(b" ")) for p in first(True)] if runs > 1 else [])


def bucket_totals(docs: DataFrame, head: Head, runs: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Occurrences of all features per bucket; ``buckets`` rows reach the driver, however large the corpus is."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def count(batches):
        head, totals, words = shared.value, np.zeros(buckets, np.int64), Counter()

        def flush():
            crcs = np.fromiter(map(head.state, words), np.int64, len(words))
            np.add.at(totals, crcs % buckets, np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if runs == 1:  # equal words are hashed once
                    for block in word_blocks(text):
                        words.update(block)
                        if len(words) > HELD:
                            flush()
                else:
                    for block, carried in _carried(word_blocks(text), runs):
                        crcs = np.fromiter(_run_crcs(head, block, carried, runs), np.int64)
                        totals[:] += np.bincount(crcs % buckets, minlength=buckets)
        flush()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at], pa.int64())], names=["bucket", "n"])

    out = [0] * buckets
    for row in _texts(docs).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: Sequence[int], target: Sequence[int]) -> list[int]:
    """Thousandths of the log ratio target to corpus of every bucket, both smoothed by one, rounded down."""
    size = float(len(corpus))
    s_all, t_all = float(sum(corpus)) + size, float(sum(target)) + size
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus, target, strict=True)]


def gumbel(seed: int, doc_id: int | None) -> int:
    """Thousandths of a Gumbel draw that depends on seed and id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / GUMBEL_SPAN)))


class _Gains(dict):
    """Gain by word; the head stays, other words are hashed and kept until there are too many."""

    def __init__(self, head: Head, gains: Sequence[int]):
        self.head = {w: gains[crc % len(gains)] for w, crc in head.words.items()}
        super().__init__(self.head)
        self.gains = gains

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD:
            self.clear()
            self.update(self.head)
        gain = self[word] = self.gains[zlib.crc32(word) % len(self.gains)]
        return gain


def score_documents(
    docs: DataFrame, head: Head, gains: Sequence[int], runs: int = 1, seed: int = 2024, carry: Sequence[str] | None = None
) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all, if not given) as one struct ``row``, and ``n_words``, ``n_features``, ``weight`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast((head, list(gains)))
    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns])
    given = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([
        given.schema["row"],
        *[T.StructField(name, T.LongType(), False) for name in ("n_words", "n_features", "weight", "score")],
    ])

    def score(batches):
        head, gains = shared.value
        by_word = _Gains(head, gains)
        of = by_word.__getitem__
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n_words = n = total = 0
                if runs == 1:
                    for block in word_blocks(text):
                        n_words += len(block)
                        total += sum(map(of, block))
                    n = n_words
                else:
                    for block, carried in _carried(word_blocks(text), runs):
                        n_words += len(block) - carried
                        for crc in _run_crcs(head, block, carried, runs):
                            n += 1
                            total += gains[crc % len(gains)]
                weight = total // n if n else 0
                rows.append((n_words, n, weight, weight + gumbel(seed, doc_id)))
            cols = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=schema.names)

    return given.mapInArrow(score, schema)


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Add ``rank`` (1, 2, 3 …) to the highest scores among the documents of enough words; null for the others.

    Scores are whole numbers within about 110,000 of each other (a gain is a logarithm of counts, a draw one of 32 bits), so their
    histogram fits the driver. It gives the last score that is drawn; only documents from there on are sorted, by ranges.
    """
    enough = F.col("n_words") >= least_words
    heights = scored.where(enough).groupBy("score").count().collect()
    wanted = sum(r["count"] for r in heights) * percent // 100
    lowest, above = None, 0
    for r in sorted(heights, key=lambda r: -r["score"]):
        if above >= wanted:
            break
        lowest, above = r["score"], above + r["count"]
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = enough & (F.col("score") >= lowest)
    named = scored.where(high).select(
        (-F.col("score")).alias("_down"), F.col("row.doc_id").alias("_id"), F.col("n_features").alias("_n"), *scored.columns
    )
    ranked = dense_index(named, "_at", "_down", "_id", "_n")
    place: Column = F.col("_at") + 1
    ranked = ranked.select(*scored.columns, F.when(place <= wanted, place).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    runs: int = 1,
    buckets: int = BUCKETS,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    head: int = HEAD,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``(row, n_words, n_features, weight, score, rank)`` for every row of ``docs``, drawn towards the texts of ``target``.

    ``docs`` has ``doc_id`` and ``text``, ``target`` has ``text``; ``row`` holds the columns of ``docs`` named in ``carry``, the id
    among them, or all of them, as they came and whatever their names. Null and empty texts have no features and weight 0; a null id is drawn like an empty one. Rows with
    equal id and text score alike and are ranked one after the other; equal scores go by id, null ids first, then by number of features. An
    empty target makes every gain depend on the corpus alone; an empty corpus gives no rows.
    """
    texts = docs.select("text")
    vocabulary = fit_head(texts, runs, head)
    gains = bucket_gains(bucket_totals(texts, vocabulary, runs, buckets), bucket_totals(target.select("text"), vocabulary, runs, buckets))
    return draw(cut(score_documents(docs, vocabulary, gains, runs, seed, carry)), percent, least_words)


#: CRC-32 in SQL: the table of the reflected polynomial, then one step of the register per byte of every distinct word.
SQL = """WITH RECURSIVE bits(b, k, c) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
low AS (SELECT 0 AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
split AS (SELECT side, doc_id, list_filter(regexp_split_to_array(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM low),
used AS (SELECT side, doc_id, unnest(ws) AS w FROM split),
vocab AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM used),
reg(w, h, i, c) AS (SELECT w, h, 0, 4294967295::BIGINT FROM vocab UNION ALL
  SELECT w, h, i + 1, xor(c >> 8, t[xor(c & 255, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) + 1]) FROM reg, steps WHERE i < length(h) // 2),
crc AS (SELECT w, xor(c, 4294967295) % 10000 AS b FROM reg WHERE i = length(h) // 2),
n AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM used JOIN crc USING (w) GROUP BY b),
tot AS (SELECT (sum(s) + 10000)::DOUBLE AS s_all, (sum(t) + 10000)::DOUBLE AS t_all FROM n),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * s_all / ((s + 1)::DOUBLE * t_all)))::BIGINT AS g FROM n, tot),
weights AS (SELECT doc_id, count(*) AS n_features, floor(sum(g) / count(*))::BIGINT AS weight FROM used JOIN crc USING (w) JOIN gain USING (b) WHERE side = 0 GROUP BY 1),
scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (doc_id) WHERE side = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= total * 10 // 100 THEN place END AS rank FROM placed"""
