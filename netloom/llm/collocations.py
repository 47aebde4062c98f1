"""Collocations by set-oriented mining (SETM, Houtsma and Swami 1995): relations of occurrences, one length after another.

The relation of length 1 holds the occurrences of all frequent words, sorted by document, piece and position; that of length k
those of all frequent groups of k words. A round merges each relation with itself at the adjacent position of the same piece, counts
the groups that come out, keeps the frequent ones, and semi-joins the occurrences with them before the next round.

Every relation is written out clustered: a row holds the items of one stretch of text in order, a zero wherever a piece ends or
nothing frequent stands, so that equal pieces and adjacent positions stand side by side and the merge needs no shuffle. Only group
counts are shuffled. The semi-join uses a bit table of fixed size; a group that passes by chance is found out by its exact count.

A word's item is its number among the most frequent words (the head, of fixed size), else a hash of language and word; the
hash is seeded anew should a frequent word share it with another, so items stand for words one to one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import cut

#: Words of the head, each and its language of at most ``LONGEST`` bytes: below 17 MB in all.
HEAD = 1 << 17
LONGEST = 64
#: Bits of the table that stands for the frequent groups of a length: 8 MB.
BITS = 1 << 26
#: A task's counts of words are handed on at this many entries, and items are merged this many at a time.
HELD = 300_000
SLICE = 2_000_000
#: Rows of a relation hold about this many items, and very long texts are read in blocks of this many bytes.
RUN = 1024
BLOCK = 1 << 20
TOP = -(1 << 63)

_LOW = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
_ENDS = b".,;:!?\n\x0b\x0c\r"
_AS_WORDS = bytes(32 if b in _ENDS + b"\t" else _LOW[b] for b in range(256))
_AS_PIECES = bytes(10 if b in _ENDS else 32 if b == 9 else _LOW[b] for b in range(256))


def _blocks(text: bytes, table: bytes) -> Iterator[bytes]:
    """The text, translated, in blocks that end between words."""
    start = 0
    while start < len(text):
        stop = start + BLOCK
        while stop < len(text) and table[text[stop]] not in (10, 32):
            stop += 1
        yield text[start:stop].translate(table)
        start = stop


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text")
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of every word; tasks add up before anything is shuffled."""

    def count(batches):
        held, size = defaultdict(Counter), 0

        def flush():
            for lang, counts in held.items():
                words, n = list(counts), list(counts.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.binary()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"]
                )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held[lang]
                size -= len(own)
                for block in _blocks(text or b"", _AS_WORDS):
                    own.update(block.split())
                size += len(own)
                if size > HELD:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()

    rows = _given(docs).mapInArrow(count, "lang binary, word binary, n long")
    return rows.groupBy(F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def _lang_seed(lang: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang + b"\x00%d" % seed, 42)


def _hashed(seed: int):
    return F.xxhash64(F.concat("lang", F.lit(f"\x00{seed}")), "word").bitwiseOR(F.lit(TOP))


def number_words(words: DataFrame, least: int, head: int = HEAD) -> tuple[DataFrame, DataFrame, int]:
    """``(i1, lang, word, a)`` of the frequent words, the part of it that is the head, and the seed of the hash."""
    frequent = words.where(F.col("n") >= least)
    short = frequent.where((F.octet_length("lang") <= LONGEST) & (F.octet_length("word") <= LONGEST))
    first = cut(short.orderBy(F.desc("n"), "lang", "word").limit(head))
    order = Window.orderBy(F.desc("n"), "lang", "word")  # over the head alone
    chosen = cut(first.select(F.row_number().over(order).cast("long").alias("i1"), "lang", "word"))
    others = words.join(chosen, ["lang", "word"], "left_anti")
    seed = 0
    while others.groupBy(_hashed(seed).alias("i1")).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).where(
        (F.col("k") > 1) & (F.col("n") >= least)
    ).head(1):
        seed += 1
    known = frequent.join(chosen, ["lang", "word"], "left")
    return cut(known.select(F.coalesce("i1", _hashed(seed)).alias("i1"), "lang", "word", F.col("n").alias("a"))), chosen, seed


def _slots(columns: Sequence[np.ndarray]) -> np.ndarray:
    """The place of a group of items in a bit table."""
    out = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for column in columns:
            out = (out ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return out & np.uint64(BITS - 1)


def bit_table(groups: DataFrame, k: int) -> np.ndarray:
    """A bit per slot that some group of ``groups`` falls on; ``BITS / 64`` numbers reach the driver at most."""

    def place(batches):
        for batch in batches:
            slots = _slots([np.asarray(batch.column(c)) for c in range(k)])
            bits = np.uint64(1) << (slots & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])

    placed = groups.select(*_items(k)).mapInArrow(place, "at long, bits long")
    found = placed.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.uint64)
    table[np.asarray(found["at"])] = np.asarray(found["bits"]).view(np.uint64)
    return table


def _marked(table: np.ndarray, columns: Sequence[np.ndarray]) -> np.ndarray:
    slots = _slots(columns)
    return (table[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def _items(k: int, start: int = 1) -> list[str]:
    return [f"i{n}" for n in range(start, start + k)]


class _Numbers(dict):
    """Item by word of one language; words outside the head are hashed, and forgotten when there are too many."""

    def __init__(self, head: dict[bytes, int], seed: int):
        super().__init__(head)
        self.head, self.seed = head, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.head) + HELD:
            self.clear()
            self.update(self.head)
        value = xxhash.xxh64_intdigest(word, self.seed) | 1 << 63
        value = self[word] = value - (1 << 64)
        return value


def _rows(values: np.ndarray, offsets: Sequence[int]) -> pa.RecordBatch:
    column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
    return pa.RecordBatch.from_arrays([column], names=["items"])


def word_relation(docs: DataFrame, known: DataFrame, head: DataFrame, seed: int) -> DataFrame:
    """``(items)``: a row per document, its words in order, zero for the end of a piece and for words that are not frequent."""
    numbers: dict[bytes, dict[bytes, int]] = defaultdict(dict)
    for row in head.toLocalIterator():
        numbers[row["lang"].encode()][row["word"].encode()] = row["i1"]
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((dict(numbers), bit_table(known.where("i1 < 0"), 1)))

    def number(batches):
        heads, table = shared.value
        of: dict[bytes, _Numbers] = {}
        for batch in batches:
            found, offsets, size = [], [0], 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in of:
                    of[lang] = _Numbers(heads.get(lang, {}) | {b"\n": 0}, _lang_seed(lang, seed))
                item = of[lang].__getitem__
                for block in _blocks(text or b"", _AS_PIECES):
                    found.append(np.fromiter(map(item, filter(None, block.replace(b"\n", b" \n ").split(b" "))), np.int64))
                    size += len(found[-1])
                offsets.append(size)
                if size > SLICE:
                    yield _rows(_only_marked(np.concatenate(found), table), offsets)
                    found, offsets, size = [], [0], 0
            if len(offsets) > 1:
                yield _rows(_only_marked(np.concatenate([*found, np.empty(0, np.int64)]), table), offsets)

    return cut(_given(docs).mapInArrow(number, "items array<long>"))


def _only_marked(items: np.ndarray, table: np.ndarray) -> np.ndarray:
    rare = np.flatnonzero(items < 0)
    items[rare[~_marked(table, [items[rare]])]] = 0
    return items


def _streams(batches, k: int) -> Iterator[np.ndarray]:
    """Items of whole batches with a zero between rows, in slices that overlap by ``k - 1`` items."""
    for batch in batches:
        column = batch.column(0)
        values, lengths = np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))
        stream = np.insert(values, np.cumsum(lengths), 0)
        for start in range(0, max(1, len(stream)), SLICE):
            yield stream[start : start + SLICE + k - 1]


def _windows(stream: np.ndarray, k: int) -> np.ndarray:
    """Where ``k`` items stand side by side."""
    n = len(stream) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(reduce(np.logical_and, (stream[i : i + n] != 0 for i in range(k))))


def _counted(stream: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct groups of ``k`` adjacent items and how often each occurs."""
    at = _windows(stream, k)
    distinct, code = np.unique(stream, return_inverse=True)
    size = total = max(1, len(distinct))
    group = code[at]
    for i in range(1, k):
        if total * size >= 1 << 62:
            seen, group = np.unique(group, return_inverse=True)
            total = len(seen)
        group, total = group * size + code[at + i], total * size
    _, first, n = np.unique(group, return_index=True, return_counts=True)
    return [stream[at[first] + i] for i in range(k)], n


def group_counts(relation: DataFrame, k: int) -> DataFrame:
    """``(i1 … ik, a)``: the groups of ``k`` adjacent items of the relation of length ``k - 1``, and their occurrences."""
    names = _items(k)

    def count(batches):
        for stream in _streams(batches, k):
            columns, n = _counted(stream, k)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(n, pa.int64())], names=[*names, "n"])

    rows = relation.mapInArrow(count, ", ".join(f"{c} long" for c in [*names, "n"]))
    return rows.groupBy(*names).agg(F.sum("n").alias("a"))


def _runs(stream: np.ndarray, k: int, table: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Stretches whose every ``k`` adjacent items are marked and that are longer than ``k``, each followed by a zero, and row offsets."""
    at = _windows(stream, k)
    at = at[_marked(table, [stream[at + i] for i in range(k)])] if len(at) else at
    breaks = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.r_[0, breaks + 1]] if len(at) else at, at[np.r_[breaks, len(at) - 1]] if len(at) else at
    longer = last > first
    first, lengths = first[longer], (last - first)[longer] + k
    ends = np.cumsum(lengths + 1)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    starts = ends - lengths - 1
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(starts, lengths) + inside] = stream[np.repeat(first, lengths) + inside]
    rows = starts[np.flatnonzero(np.diff(starts // RUN, prepend=-1))] if len(starts) else starts
    return out, [*rows.tolist(), len(out)]


def semi_join(relation: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """The occurrences of the frequent ``groups`` of ``k`` items that adjoin another one: the relation of length ``k``.

    A stretch that two slices of a very long row share is cut where every window of ``k + 1`` items still lies in one part.
    """
    shared = relation.sparkSession.sparkContext.broadcast(bit_table(groups, k))

    def keep(batches):
        for stream in _streams(batches, k + 1):
            out, offsets = _runs(stream, k, shared.value)
            if len(out):
                yield _rows(out, offsets)

    return cut(relation.mapInArrow(keep, "items array<long>"))


def frequent_groups(docs: DataFrame, words: DataFrame, longest: int, least: int, head: int = HEAD) -> list[DataFrame]:
    """Tables ``(i1 … ik, a)`` of the frequent groups of 1, 2 … words; the first also has ``lang`` and ``word``."""
    known, first, seed = number_words(words, least, head)
    levels = [known]
    relation = word_relation(docs, known, first, seed)
    for k in range(2, longest + 1):
        counts = group_counts(relation, k).where(F.col("a") >= least)
        parts = levels[-1].select(*_items(k - 1))
        for shift in (1, 2):  # both parts must be frequent themselves; what only passed the bit table by chance is not
            counts = counts.join(parts.toDF(*_items(k - 1, shift)), _items(k - 1, shift), "left_semi")
        levels.append(cut(counts))
        if k < longest:
            relation = semi_join(relation, levels[-1], k)
    return levels


def _judged(levels: list[DataFrame], k: int, share: int) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of the groups of ``k`` words that no longer group takes the place of."""
    found = levels[k - 1].select(*_items(k), "a")
    for m in range(1, k):
        left = levels[m - 1].select(*_items(m), F.col("a").alias(f"l{m}"))
        right = levels[k - m - 1].select(*[F.col(c).alias(n) for c, n in zip(_items(k - m), _items(k - m, m + 1), strict=True)], F.col("a").alias(f"r{m}"))
        found = found.join(left, _items(m)).join(right, _items(k - m, m + 1))
    for longer in range(k + 1, len(levels) + 1):
        inside = levels[longer - 1].select(
            F.explode(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(_items(k, s), _items(k), strict=True)], "a") for s in range(1, longer - k + 2)])).alias("g")
        )
        most = inside.groupBy(*[F.col(f"g.{c}").alias(c) for c in _items(k)]).agg(F.max("g.a").alias("_most"))
        found = found.join(most, _items(k), "left").where(f"_most is null or cast(100 as decimal(3)) * _most < cast({share} as decimal(3)) * a").drop("_most")
    # counts to 10 ** 15: the square of one times a million has 37 digits
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    exact = found.select(
        "*", (whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)")).alias("_top"), *[(whole(f"l{m}") * whole(f"r{m}")).alias(f"_under{m}") for m in range(1, k)]
    )
    cuts = [F.struct(F.expr(f"_top div _under{m}").alias("score"), F.lit(m).alias("k"), F.col(f"l{m}").alias("l"), F.col(f"r{m}").alias("r")) for m in range(1, k)]
    worst = exact.withColumn("_cut", F.array_min(F.array(*cuts)))
    for i in range(1, k + 1):
        names = levels[0].select(F.col("i1").alias(f"i{i}"), F.col("word").alias(f"w{i}"), *(["lang"] if i == 1 else []))
        worst = worst.join(names, f"i{i}")
    return worst.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(1, k + 1)]).alias("phrase"), "a", "_cut.l", "_cut.r", "_cut.score")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, keep: int | None = 2000, head: int = HEAD) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the phrases of 2 to ``longest`` words with the highest scores of every language.

    Texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs, A-Z in lower case. ``a`` is the
    number of a phrase's occurrences, at least ``least``; ``l`` and ``r`` those of its parts at the worst cut, the score a million times
    ``a² / (l r)`` there, rounded down, in whole numbers; ``n`` the words of the language. A phrase inside a longer one with
    ``share`` per cent of its occurrences is left out. Equal scores go by ``a``, then by phrase. ``keep`` phrases a language are
    returned, all of them if None. Null texts count as empty, a null language as ``und``; repeated rows count each time; other
    columns are not looked at. An empty table, or one without a frequent pair, gives no rows.
    """
    words = cut(word_counts(docs))
    levels = frequent_groups(docs, words, longest, least, head)
    found = reduce(DataFrame.unionByName, [_judged(levels, k, share) for k in range(2, longest + 1)])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long"))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """WITH pieces AS (SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS w FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
one AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM pieces),
f1 AS (SELECT lang, w, count(*) AS f FROM one GROUP BY ALL),
two AS (SELECT a.lang, a.piece, a.pos, a.w AS x, b.w AS y FROM one a JOIN one b ON a.piece = b.piece AND b.pos = a.pos + 1),
f2 AS (SELECT lang, x, y, count(*) AS a FROM two GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT t.lang, x, y, c.w AS z, count(*) AS a FROM two t JOIN one c ON t.piece = c.piece AND c.pos = t.pos + 2 GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT f2.lang, x || ' ' || y AS phrase, a, p.f AS l, q.f AS r FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.w = x JOIN f1 q ON q.lang = f2.lang AND q.w = y
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND ((f3.x = f2.x AND f3.y = f2.y) OR (f3.y = f2.x AND f3.z = f2.y)) AND 100 * f3.a >= 50 * f2.a)),
c3 AS (SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.a, p.f AS l1, q.a AS r1, s.a AS l2, t.f AS r2 FROM f3
  JOIN f1 p ON p.lang = f3.lang AND p.w = f3.x JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
  JOIN f2 s ON s.lang = f3.lang AND s.x = f3.x AND s.y = f3.y JOIN f1 t ON t.lang = f3.lang AND t.w = f3.z),
cuts AS (SELECT lang, phrase, a, 1 AS k, l, r FROM c2 UNION ALL SELECT lang, phrase, a, 1, l1, r1 FROM c3 UNION ALL SELECT lang, phrase, a, 2, l2, r2 FROM c3),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
