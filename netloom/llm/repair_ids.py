"""Token-id files compressed by Re-Pair grammars (Larsson and Moffat, 1999).

A shard holds consecutive documents. Its ids are rewritten in rounds: every round counts all adjacent
pairs, replaces the frequent ones by new symbols, and stores a rule for each. Pairs never reach over
the end of a document, so any document, and any range of its ids, is decoded from its own symbols with the
rules and the stored expansion lengths.

File layout, little-endian: magic ``RPAIR001``; six unsigned 64-bit numbers (terminals, rules, documents, symbols, ids,
bytes of a symbol); rules (2 x uint32 each); expansion lengths (uint32); document ids (int64, with a uint8 that says
null); first symbol of each document and the end (uint64); ids of each document (uint64); symbols.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from netloom.llm.common import cut, scratch_path
from netloom.llm.files import dealt, read_file, write_file
from netloom.runtime import running_total

MAGIC = b"RPAIR001"
#: Ids per shard: the memory of one task, and the unit of random access.
SHARD_IDS = 1_000_000
#: A pair is worth a rule from this many places in a shard on.
LEAST_COUNT = 32
CELL_BITS = 20
#: Bounds on a worker's memory: remembered words, words encoded in one call, documents split at a time.
REMEMBERED = 400_000
AT_ONCE = 5_000
DOCS_AT_ONCE = 128


#: How a vocabulary must read texts for plain words to be lowered and cut before the library's model sees them.
LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Plain characters: printable ASCII and the letters of Latin-1 that have both cases, which lowering keeps plain.
PLAIN = re.compile("[\n -~À-ÖØ-Þà-öø-þ]*")
#: The cuts in a lowered plain word.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-þ]+|[0-9]|[^a-zà-öø-þ0-9]+")


class WordEncoder:
    """Ids of a text by the tokenizers library. Spaces and newlines separate words for good, so words are remembered.

    Where the vocabulary lowers texts and cuts words as ``CUTS`` does, a plain word is put together from its parts, which are
    far fewer than the words, and the library's model encodes each part; words of any other kind go
    through the whole library. Ids come as the bytes of little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads cost more than they bring
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        steps = [(made[kind] or {}).get(inner, []) for kind, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        split = [x.get("pattern") == {"Regex": CUTS} and x["behavior"] == "Removed" and x["invert"] for x in steps[1][:1]]
        level = [x["type"] == "ByteLevel" and not (x["add_prefix_space"] or x["use_regex"]) for x in steps[1][1:]]
        added = all(x["content"].startswith("<|") for x in made["added_tokens"])
        self.cuts = added and steps[0] == LOWERED and split == level == [True] and made["post_processor"] is None
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {x: as_bytes(chr(x))[0][0] for x in range(0xE0, 0xFF)}

    def _plain(self, text: str) -> bool:
        # an added token is found in the text as it stands
        return self.cuts and PLAIN.fullmatch(text) is not None and "<|" not in text

    @staticmethod
    def _joined(groups: list[list[str]], known: dict[str, bytes], encode: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """The bytes of the members of each group. Once the memory is full, what is new lives for this call only; frequent ones came early."""
        new = list(set().union(*groups).difference(known))
        full = len(known) >= REMEMBERED
        known.update(zip(new, encode(new), strict=True))
        out = [b"".join(map(known.__getitem__, members)) for members in groups]
        if full:
            for x in new:
                del known[x]
        return out

    def _encode_parts(self, parts: list[str]) -> Iterator[bytes]:
        model, letters = self.model.tokenize, self.letters
        for part in parts:
            yield array("I", [x.id for x in model(part if part.isascii() else part.translate(letters))]).tobytes()

    def _encode_words(self, words: list[str]) -> Iterable[bytes]:
        plain = [self._plain(w) for w in words]
        groups = iter(self._joined([PARTS.findall(w.lower()) for w, yes in zip(words, plain, strict=True) if yes], self.parts, self._encode_parts))
        others = self._encode_whole([w for w, yes in zip(words, plain, strict=True) if not yes])
        return (next(groups if yes else others) for yes in plain)

    def _encode_whole(self, words: list[str]) -> Iterator[bytes]:
        for start in range(0, len(words), AT_ONCE):
            for found in self.tokenizer.encode_batch_fast(words[start : start + AT_ONCE], add_special_tokens=False):
                yield array("I", found.ids).tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        lowered = (x.lower() if self._plain(x) else x for x in (x or "" for x in texts))
        return self._joined([x.replace("\n", " ").split(" ") for x in lowered], self.words, self._encode_words)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker."""
    return WordEncoder(path)


def _numbered(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs as ``left << 32 | right`` in order, the number of the pair at each place, and the places of each pair."""
    width, at = (symbols - 1).bit_length(), len(left).bit_length()
    if 2 * width + at > 64:
        return np.unique((left.astype(np.uint64) << np.uint64(32)) | right, return_inverse=True, return_counts=True)
    # pair and place in one number: sorting numbers is much faster than sorting places by their pairs
    place = np.arange(len(left), dtype=np.uint64)
    packed = np.sort((((left.astype(np.uint64) << np.uint64(width)) | right) << np.uint64(at)) | place)
    keys = packed >> np.uint64(at)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    often = np.diff(first, append=len(keys))
    number = np.empty(len(keys), np.int64)
    number[(packed & np.uint64((1 << at) - 1)).astype(np.int64)] = np.repeat(np.arange(len(first)), often)
    found = keys[first]
    return ((found >> np.uint64(width)) << np.uint64(32)) | (found & np.uint64((1 << width) - 1)), number, often


def compress(symbols: np.ndarray, ends: np.ndarray, terminals: int, least: int = LEAST_COUNT):
    """``(symbols, ends, rules, lengths)`` of a shard; ``ends`` are the documents' ends in the symbols.

    A round counts all adjacent pairs, first in hashed cells, then exactly where a cell is full enough, and replaces
    those with at least a sixteenth of the fullest cell, so frequent pairs go before those they would break. Of
    overlapping places in a run the first, third and so on are replaced.
    """
    seq = symbols.astype(np.uint32)
    final = np.zeros(len(seq), bool)
    final[ends[ends > 0] - 1] = True
    rules, lengths, n_rules = [], [], 0
    size_of = np.ones(terminals, np.int64)
    limit = None
    while len(seq) > 1:
        cells = (seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - CELL_BITS)
        counts = np.bincount(cells, minlength=1 << CELL_BITS)
        wanted = max(least, int(counts.max()) // 16)
        limit = wanted if limit is None else min(limit, wanted)
        places = np.flatnonzero((counts >= limit)[cells] & ~final[:-1])  # a frequent pair makes its cell frequent
        found, number, often = _numbered(seq[places], seq[places + 1], terminals + n_rules)
        chosen = often >= limit
        if not chosen.any():
            if limit == least:
                break
            limit = max(least, limit // 4)
            continue
        hit = chosen[number]
        places, rule = places[hit], (np.cumsum(chosen) - 1)[number[hit]]
        found = found[chosen]
        index = np.arange(len(places))
        opens = np.ones(len(places), bool)
        opens[1:] = np.diff(places) != 1
        odd = (index - np.maximum.accumulate(np.where(opens, index, 0))) % 2 == 0
        places, rule = places[odd], rule[odd]
        left, right = (found >> np.uint64(32)).astype(np.uint32), (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rules.append(np.stack([left, right], axis=1))
        lengths.append(size_of[left] + size_of[right])
        size_of = np.concatenate([size_of, lengths[-1]])
        seq[places] = (terminals + n_rules + rule).astype(np.uint32)
        n_rules += len(found)
        final[places] |= final[places + 1]
        stays = np.ones(len(seq), bool)
        stays[places + 1] = False
        seq, final = seq[stays], final[stays]
    new_ends = np.zeros(len(ends), np.int64)
    new_ends[ends > 0] = np.flatnonzero(final) + 1 if len(seq) else 0
    rules = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    lengths = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    return seq, new_ends, rules.astype(np.uint32), lengths.astype(np.uint32)


def to_bytes(doc_ids: list[int | None], documents: list[bytes], terminals: int) -> bytes:
    """A shard file of documents given as bytes of 32-bit ids; every document must have at least one id."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents)) // 4
    flat = np.frombuffer(b"".join(documents), "<u4")
    terminals = max(terminals, int(flat.max()) + 1)
    seq, ends, rules, lengths = compress(flat, np.cumsum(sizes), terminals)
    width = 3 if terminals + len(rules) < 1 << 24 else 4
    packed = seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    head = np.array([terminals, len(rules), len(sizes), len(seq), len(flat), width], "<u8")
    return b"".join(
        [
            MAGIC, head.tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.concatenate([[0], ends]).astype("<u8").tobytes(), sizes.astype("<u8").tobytes(), packed.tobytes(),
        ]
    )


class ShardReader:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.terminals, n_rules, self.n_docs, n_symbols, self.n_ids, width = map(int, np.frombuffer(data, "<u8", 6, 8))
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        ids, null = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if n else int(x) for x, n in zip(ids, null, strict=True)]
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        self.sizes = take("<u8", self.n_docs).astype(np.int64)
        symbols = take("u1", n_symbols * width).reshape(-1, width).astype(np.uint32)
        self.symbols = sum(symbols[:, k] << np.uint32(8 * k) for k in range(width))

    @cached_property
    def opened(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all rules, one rule after another, and the first id and number of ids of every rule."""
        first = np.cumsum(self.lengths) - self.lengths
        return self._open(self.rules.reshape(-1)), first, self.lengths

    def _open(self, symbols: np.ndarray) -> np.ndarray:
        """Every symbol opens into its two parts until all are terminals."""
        while True:
            deep = symbols >= self.terminals
            if not deep.any():
                return symbols
            out = np.repeat(symbols, 1 + deep)
            at = np.flatnonzero(deep) + np.arange(int(deep.sum()))
            pairs = self.rules[symbols[deep] - self.terminals]
            out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
            symbols = out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a stretch of symbols, each rule's ids copied from where it is opened."""
        deep = np.flatnonzero(symbols >= self.terminals)
        if not len(deep):
            return symbols
        ids, first, size = self.opened
        rule = symbols[deep] - self.terminals
        sizes = np.ones(len(symbols), np.int64)
        sizes[deep] = size[rule]
        out = np.repeat(symbols, sizes)
        starts = (np.cumsum(sizes) - sizes)[deep]
        n = size[rule]
        shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(starts, n) + shift] = ids[np.repeat(first[rule], n) + shift]
        return out

    def document(self, number: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[number] : self.starts[number + 1]])

    def ids(self, number: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a document, opening only symbols that overlap the range."""
        symbols = self.symbols[self.starts[number] : self.starts[number + 1]]
        deep = symbols >= self.terminals
        size = np.ones(len(symbols), np.int64)
        size[deep] = self.lengths[symbols[deep] - self.terminals]
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - skipped : stop - skipped]


MANIFEST = "place int, part int, file string, n_docs long, n_ids long, n_bytes long"


def write_ids(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1) -> DataFrame:
    """Encode every text, append ``end_id``, write shards into ``folder`` in ascending doc_id order.

    Returns the written manifest, one row per shard: ``place`` and ``part`` order the shards. Null texts count as
    empty and hold just the end id. Null doc_ids come first; rows of equal id follow the hash of their text.
    Rows are dealt out by ranges of (doc_id, hash, row), so no id can fill a task.
    """
    order = ["doc_id", "_hash", "_row"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("place"), "doc_id", "text")

    def run(batches):
        encoder = word_encoder(vocabulary)
        ids, documents, n_ids, part, place = [], [], 0, 0, 0
        end = array("I", [end_id]).tobytes()

        def shard() -> pa.RecordBatch:
            data = to_bytes(ids, documents, encoder.size)
            name = write_file(folder, ".rpair", data)
            row = [place], [part], [name], [len(ids)], [n_ids], [len(data)]
            kinds = pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            if batch.num_rows:
                place = batch.column("place")[0].as_py()
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(start, DOCS_AT_ONCE)
                keys = some.column("doc_id").to_pylist()
                for key, found in zip(keys, encoder.encode_batch(some.column("text").to_pylist()), strict=True):
                    ids.append(key)
                    documents.append(found + end)
                    n_ids += len(found) // 4 + 1
                    if n_ids >= SHARD_IDS:
                        yield shard()
                        ids, documents, n_ids, part = [], [], 0, part + 1
        if ids:
            yield shard()

    return cut(placed.mapInArrow(run, MANIFEST))


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files of a written manifest."""
    order = manifest.withColumn("_at", F.col("place").cast("long") * (1 << 31) + F.col("part"))
    shards = running_total(order, "_at", "n_ids").select("file", F.col("before").alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = ShardReader(read_file(folder, name))
                flat, ends = memoryview(shard.expand(shard.symbols).astype("<u4")), np.cumsum(shard.sizes)
                checks = [zlib.crc32(flat[a:b]) for a, b in zip(ends - shard.sizes, ends, strict=True)]
                starts = start + ends - shard.sizes
                columns = shard.doc_ids, starts, shard.sizes, checks
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt(shards, manifest.count()).mapInArrow(run, schema)


def token_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` as shard files and return what the files hold, one row per document.

    An empty table writes no file and gives no rows. Repeated rows are written as often as they occur.
    """
    folder = folder or scratch_path(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, vocabulary, folder), folder)
