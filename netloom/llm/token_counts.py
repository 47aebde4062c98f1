"""Exact token counts of every prefix of a text, for a byte-level byte-pair vocabulary.

The table of a text holds, for each of its bytes, the number of tokens of the text up to and with that
byte, as the tokenizer itself would count that prefix. Truncation and budget questions are then
look-ups; nothing is encoded again. Words (the stretches that merges never leave) are solved once each by
the dynamic program of ``prefix_bpe`` and remembered.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from tokenizers import Regex, pre_tokenizers

from netloom.llm.common import with_fields
from netloom.llm.prefix_bpe import MEMORY, PrefixBpe

#: The split pattern of the byte-level vocabularies (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = {"'re", "'ve", "'ll"}
#: Stands for characters that this module's Unicode tables call letters or digits and the tokenizer's do not.
NEITHER = "͸"


def _byte_letters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str):
        with open(path) as file:
            spec = json.load(file)
        back = {letter: chr(byte) for byte, letter in _byte_letters().items()}
        plain = lambda s: "".join(back[c] for c in s)
        specials = [x["content"] for x in spec["added_tokens"]]
        merges = {tuple(map(plain, m)): i for i, m in enumerate(spec["model"]["merges"])}
        self.bpe = PrefixBpe([a + b for a, b in merges], lambda a, b: merges.get((a, b)))
        self.pattern = regex.compile(SPLIT)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.known = set(map(chr, range(0x250)))
        self.odd: dict[int, str] = {}
        self.letter = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True)
        self.letter_here = regex.compile(r"[\p{L}\p{N}]")
        self.words: dict[str, bytes | np.ndarray] = {}

    def _stretches(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text)
        new = set(text) - self.known
        for c in new:
            if self.letter_here.match(c) and not self.letter.pre_tokenize_str(c):
                self.odd[ord(c)] = NEITHER
        self.known |= new
        if not self.odd or not any(chr(c) in text for c in self.odd):
            return self.pattern.findall(text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(text.translate(self.odd))]

    def _word(self, word: str):
        """Counts of the word's byte prefixes: as bytes while they fit, which is nearly always."""
        known = self.words.get(word)
        if known is None:
            counts = self.bpe.counts(word.encode().decode("latin-1"))
            if word in SHORT:
                counts[1] = 2  # cut short, the quote and the letter are words of their own
            known = bytes(counts) if len(counts) < 256 else np.array(counts, np.int32)
            if len(word) < 256:
                if len(self.words) >= MEMORY:
                    self.words.clear()
                self.words[word] = known
        return known

    def _plain(self, text: str) -> np.ndarray:
        words = self._stretches(text)
        if not words:
            return np.empty(0, np.int32)
        known = self.words
        found = [x if (x := known.get(w)) is not None else self._word(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        inside = np.frombuffer(b"".join(found), np.uint8).astype(np.int32) if all(type(x) is bytes for x in found) else np.concatenate(
            [np.frombuffer(x, np.uint8).astype(np.int32) if type(x) is bytes else x for x in found]
        )
        ends = np.cumsum(sizes)
        totals = inside[ends - 1]
        base = np.cumsum(totals) - totals
        out = inside + np.repeat(base, sizes).astype(np.int32)
        # white space before a word gives it its last character; cut there, the run is one word
        for i in range(len(words) - 1):
            w = words[i + 1]
            if w[0].isspace() and words[i][-1].isspace() and words[i].isspace():
                out[ends[i] + len(w[0].encode()) - 1] = base[i] + self._word(words[i] + w[0])[-1]
        return out

    def table(self, text: str | None) -> np.ndarray:
        """Token count of every non-empty byte prefix; prefixes that end inside a character count its bytes so far."""
        if not text:
            return np.empty(0, np.int32)
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        parts, before = [], 0
        tail = ""
        for i, part in enumerate(self.specials.split(text)):
            if i % 2:  # a special string is ordinary text until it is complete
                whole = self._plain(tail + part)
                at = len(tail.encode())
                counts = whole[at:] + before - (self._plain(tail)[-1] if tail else 0)
                counts[-1] = before + 1
                tail = ""
            else:
                counts = self._plain(part) + before
                tail = part
            parts.append(counts)
            before = int(counts[-1]) if len(counts) else before
        return np.concatenate(parts)


def pack(table: np.ndarray) -> bytes:
    """A prefix table as compressed 16-bit steps; a step is at most one up and one token's length down."""
    return zstandard.compress(np.diff(table, prepend=0).astype("<i2").tobytes())


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), "<i2"), dtype=np.int32)


def longest_prefix(table: np.ndarray, text: str, budget: int) -> int:
    """Bytes of the longest prefix, ending with a whole character, that has at most ``budget`` tokens."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    whole = np.append((raw[1:] & 0xC0) != 0x80, True) if len(raw) else np.empty(0, bool)
    fits = np.flatnonzero((table <= budget) & whole)
    return int(fits[-1]) + 1 if len(fits) else 0


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One counter per Python worker."""
    return PrefixCounter(path)


ADDED = ("n_bytes", "n_tokens", "over_limit", "fitting_bytes", "prefix_counts")


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, keep_tables: bool = True) -> DataFrame:
    """All columns of ``docs`` but ``text``, with counts read off the prefix table of the whole text.

    ``n_bytes`` and ``n_tokens`` of the text, ``over_limit`` (more than ``limit`` tokens), ``fitting_bytes`` (the longest
    prefix within the limit) and, with ``keep_tables``, the packed table ``prefix_counts`` for ``unpack``. Null counts
    as empty: no bytes, no tokens. Special strings inside texts count as one token. Rows are handled one by one;
    columns of the input that bear a name given out here are replaced.
    """
    given = ADDED if keep_tables else ADDED[:-1]
    rows = docs.select(*[c for c in docs.columns if c not in ADDED and c != "text"], "text")
    ddl = "n_bytes long, n_tokens long, over_limit boolean, fitting_bytes long"
    schema = with_fields(rows.drop("text").schema, ddl + ", prefix_counts binary" * keep_tables)

    def run(batches):
        counter = prefix_counter(vocabulary)
        for batch in batches:
            sizes, tokens, over, fitting, packed = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                table = counter.table(text)
                total = int(table[-1]) if len(table) else 0
                sizes.append(len(table))
                tokens.append(total)
                over.append(total > limit)
                fitting.append(len(table) if total <= limit else longest_prefix(table, text, limit))
                if keep_tables:
                    packed.append(pack(table))
            columns = [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(fitting, pa.int64())]
            if keep_tables:
                columns.append(pa.array(packed, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *given])

    return rows.mapInArrow(run, schema)
