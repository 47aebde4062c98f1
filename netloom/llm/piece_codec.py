"""SentencePiece ids by a streaming Viterbi pass, and text from ids.

The pass keeps the last piece of every prefix (``prefix_bpe``), which is the backpointer table of the
one admissible path to each position. A piece still to come starts within the last ``longest`` positions, so
once the paths from all of those meet at one boundary, nothing before it can change: its ids are given out
and the window starts anew there. Memory follows the window, not the text.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import with_fields
from netloom.llm.prefix_bpe import MEMORY, PrefixBpe

SPACE = "▁"
#: Longer stretches without a sure boundary are streamed and not remembered.
WORD = 64
BLOCK = 4096
#: Documents of an Arrow batch that are encoded, and given out, at a time.
DOCS_AT_ONCE = 256


class PieceModel:
    """Pieces of a SentencePiece model of the byte-pair kind."""

    def __init__(self, path: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        order = {piece: -sp.get_score(i) for piece, i in self.ids.items()}
        self.bpe = PrefixBpe(list(order), lambda a, b: order.get(a + b))
        self.longest = max(map(len, self.ids))
        bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_ids = [bytes_[i] for i in range(256)] if len(bytes_) == 256 else None
        self.text_of = [b""] * size
        for piece, i in self.ids.items():
            self.text_of[i] = piece.replace(SPACE, " ").encode()
        for value, i in bytes_.items():
            self.text_of[i] = bytes([value])
        self.prefixed = sp.normalize("a").startswith(SPACE)
        # boundaries that no piece crosses: before a space mark that follows another character, around lone characters
        alone = "".join(c for c in "\n\t\r" if not any(c in piece for piece in self.ids))
        crossing = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        self.stretches = None if crossing else regex.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone or SPACE}]")
        self.words: dict[str, bytes] = {}

    def ids_of(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        if self.byte_ids is None:
            return [self.sp.unk_id()]
        return [self.byte_ids[x] for x in piece.encode()]

    def stream(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the normalised text in ``blocks``, as soon as they are certain."""
        bpe, longest = self.bpe, self.longest
        window, last, context = "", [], None
        for block in blocks:
            window += block
            start = max(0, len(last) - longest + 1)
            for end, found in enumerate(bpe.matches(window[start:]), start):
                if end < len(last):
                    continue
                for piece in [*found, window[end]]:
                    before = end - len(piece)
                    u = last[before] if before >= 0 else context
                    if before >= -1 and (u is None or bpe.may_follow(u, piece)):
                        break
                last.append(piece)
            size = len(last)
            open_ = set(range(max(0, size + 1 - longest), size + 1))
            while len(open_) > 1:
                top = max(open_)
                open_.remove(top)
                open_.add(top - len(last[top - 1]))
            sure = open_.pop()
            if sure:
                yield self._trace(last, sure)
                context, window, last = last[sure - 1], window[sure:], last[sure:]
        if last:
            yield self._trace(last, len(last))

    def _trace(self, last: list[str], end: int) -> list[int]:
        path = []
        while end > 0:
            path.append(last[end - 1])
            end -= len(path[-1])
        return [i for piece in reversed(path) for i in self.ids_of(piece)]

    def _stretch(self, text: str) -> bytes:
        known = self.words.get(text)
        if known is not None:
            return known
        if len(text) > WORD:
            blocks = (text[i : i + BLOCK] for i in range(0, len(text), BLOCK))
            return array("i", [i for part in self.stream(blocks) for i in part]).tobytes()
        # all paths meet at the end of a stretch, so a short one needs no earlier meeting
        out = array("i", self._trace(self.bpe.last_pieces(text), len(text))).tobytes()
        if len(self.words) < MEMORY:  # frequent stretches come early
            self.words[text] = out
        return out

    def encode(self, text: str | None) -> array:
        normal = self.sp.normalize(text or "")
        out = array("i")
        if not normal:
            return out
        out.frombytes(b"".join(map(self._stretch, self.stretches.findall(normal) if self.stretches else [normal])))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefixed and text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model per Python worker."""
    return PieceModel(path)


ADDED = ("ids", "n_ids", "ids_crc32", "n_text_chars", "round_trip")


def _encoded(model_path: str):
    def run(batches):
        model = piece_model(model_path)
        for batch in (whole.slice(start, DOCS_AT_ONCE) for whole in batches for start in range(0, whole.num_rows, DOCS_AT_ONCE)):
            offsets, flat, checks, chars, same = [0], array("i"), [], [], []
            for text in batch.column("text").to_pylist():
                ids = model.encode(text)
                flat.extend(ids)
                offsets.append(len(flat))
                checks.append(zlib.crc32(np.frombuffer(ids, "<u4").tobytes() if ids else b""))
                chars.append(len(text or ""))
                same.append(model.decode(ids) == (text or ""))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], lists, pa.array(sizes, pa.int64()), pa.array(checks, pa.int64()), pa.array(chars, pa.int64()), pa.array(same, pa.bool_())],
                names=[*batch.schema.names[:-1], *ADDED],
            )

    return run


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``docs`` but ``text``, with the ids of its whole text and proof of decoding.

    ``ids`` is the list of piece ids, ``n_ids`` its length, ``ids_crc32`` the unsigned crc32 of the ids as little-endian
    unsigned 32-bit integers, ``n_text_chars`` the code points of the text, and ``round_trip`` says whether decoding
    gives the text back (a text that holds the space mark itself does not). Null counts as empty and
    has no ids. Rows are handled one by one, so repeated rows get equal results. Columns
    of the input that bear a name given out here are replaced. ``model_path`` must exist on every executor.
    """
    rows = docs.select(*[c for c in docs.columns if c not in ADDED and c != "text"], F.col("text"))
    schema = with_fields(rows.drop("text").schema, "ids array<int>, n_ids long, ids_crc32 long, n_text_chars long, round_trip boolean")
    return rows.mapInArrow(_encoded(model_path), schema)
