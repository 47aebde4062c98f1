import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from helpers import documents, nothing, rows
from netloom.llm import piece_codec as pc
from netloom.llm import repair_ids as ri
from netloom.llm import token_counts as tc
from netloom.llm.files import read_file

BYTES, WORDS, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SYLLABLES = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "漢", "😀", "0", "12", ".", "'s", "'re", "'", "<|endoftext|>", "<|endo",
             "　", "\U0001e4d0", "▁", "x", "!!", "ing", "THE"]


def scraps(seed: int, n: int):
    draw = random.Random(seed)
    return ["".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(12))) for _ in range(n)]


def test_every_prefix_counts_as_the_library_does():
    counter, library = tc.PrefixCounter(BYTES), Tokenizer.from_file(BYTES)
    for text in scraps(2, 400):
        table = counter.table(text)
        assert len(table) == len(text.encode()) and (tc.unpack(tc.pack(table)) == table).all()
        for i in range(1, len(text) + 1):
            prefix = text[:i]
            assert table[len(prefix.encode()) - 1] == len(library.encode(prefix, add_special_tokens=False).ids), (text, prefix)


def test_longest_prefix_answers_budgets():
    counter, library = tc.PrefixCounter(BYTES), Tokenizer.from_file(BYTES)
    for text in scraps(4, 60):
        for budget in (0, 1, 3):
            fits = [i for i in range(len(text) + 1) if len(library.encode(text[:i], add_special_tokens=False).ids) <= budget]
            assert tc.longest_prefix(counter.table(text), text, budget) == len(text[: max(fits)].encode())


def test_long_words_do_not_break_the_table():
    text = "x" * 20_000 + " " * 1000 + "é" * 700
    assert tc.PrefixCounter(BYTES).table(text)[-1] == len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids)


def test_token_counts_awkward_rows(spark):
    library = Tokenizer.from_file(BYTES)
    got = tc.token_counts(documents(spark).withColumnRenamed("n_chars", "n_tokens"), BYTES, limit=100).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, text, *_ in rows():
        if i is not None:
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            assert (by[i]["n_bytes"], by[i]["n_tokens"], by[i]["over_limit"]) == (len((text or "").encode()), n, n > 100)
            assert len(tc.unpack(by[i]["prefix_counts"])) == by[i]["n_bytes"]
    assert tc.token_counts(nothing(spark), BYTES).count() == 0


def test_grammar_round_trip_and_random_access():
    draw = random.Random(8)
    documents_ = [array("I", [draw.randrange(6) for _ in range(draw.randrange(1, 400))]) for _ in range(300)]
    documents_ += [array("I", [1]), array("I", [7] * 3000), array("I", [70_000, 1])]
    data = ri.to_bytes([None, *range(1, len(documents_))], [x.tobytes() for x in documents_], 10)
    shard = ri.ShardReader(data)
    assert len(shard.rules) > 10 and len(data) < 4 * sum(map(len, documents_))
    assert shard.doc_ids[:2] == [None, 1]
    for n, ids in enumerate(documents_):
        assert shard.document(n).tolist() == list(ids)
        a = draw.randrange(len(ids))
        b = draw.randrange(a, len(ids)) + 1
        assert shard.ids(n, a, b).tolist() == list(ids[a:b])
    for rule, length in zip(shard.rules, shard.lengths, strict=True):
        assert len(shard.expand(rule)) == length


def test_token_files_awkward_rows(spark, tmp_path):
    library = Tokenizer.from_file(WORDS)
    folder = f"file:{tmp_path}/ids"
    manifest = ri.write_ids(documents(spark), WORDS, folder)
    got = ri.read_ids(manifest, folder).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((i is not None, i or 0) for i, *_ in rows())
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    texts = {}
    for i, text, *_ in rows():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        texts.setdefault(i, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    assert all((r["n_tokens"], r["ids_crc32"]) in texts[r["doc_id"]] for r in got)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][:2] == [None, None]
    first = manifest.first()
    assert ri.ShardReader(read_file(folder, first["file"])).n_docs == first["n_docs"]
    assert ri.token_files(nothing(spark), WORDS).count() == 0


def test_words_are_put_together_from_parts():
    encoder, library = ri.word_encoder(WORDS), Tokenizer.from_file(WORDS)
    assert encoder.cuts
    odd = [
        "Thoner. THONER, thoner's", "<|endoftext|> A<|ENDOFTEXT|>b", "x<|startoftext|>'S it'S \"'s 'tis we'Re''d", "\x1cfoo\x1d \x85 a\tb\rC",
        "İI ſ Ḱ e\u0301 b", "12³ ½a٣ _x_'s'", "éÉ'S Éa ÿ Ÿ ß × ÷ þÞ", "éé漢é a.é.b!é", None, "", " \n\n ", "A" * 300 + "!?" * 50,
    ]
    texts = odd + scraps(9, 3000)
    ids = [array("I", library.encode(x or "", add_special_tokens=False).ids).tobytes() for x in texts]
    assert encoder.encode_batch(texts) == ids
    # the model is asked once for a part, whatever stands around it and in either case
    assert {"thoner", ".", ",", "'s"} <= set(encoder.parts) and "thoner." not in encoder.parts


def test_full_memory_changes_no_id(monkeypatch):
    library = Tokenizer.from_file(WORDS)
    monkeypatch.setattr(ri, "REMEMBERED", 5)
    encoder, texts = ri.WordEncoder(WORDS), scraps(10, 300)
    for start in range(0, 300, 20):
        some = texts[start : start + 20]
        assert encoder.encode_batch(some) == [array("I", library.encode(x, add_special_tokens=False).ids).tobytes() for x in some]
    assert len(encoder.words) < 100


def test_pairs_are_numbered_the_same_either_way():
    draw = np.random.default_rng(4)
    for n in (0, 1, 5000):
        left, right = draw.integers(0, 50, (2, n), dtype=np.uint32)
        for a, b in zip(ri._numbered(left, right, 50), ri._numbered(left, right, 1 << 32), strict=True):
            assert a.tolist() == b.ravel().tolist()


@pytest.fixture(scope="module")
def model():
    return pc.PieceModel(PIECES)


def test_pieces_match_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in [*scraps(6, 2000), "", " ", "\n\n", "a" * 3000, " " * 300 + "x", "x▁y"]:
        ids = library.encode(text)
        assert model.encode(text).tolist() == ids, text
        assert model.decode(ids) == library.decode(ids)


def test_stream_is_the_same_for_any_blocks_and_keeps_a_small_window(model):
    draw = random.Random(3)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = " ".join(draw.choice(["unbelievable", "anti", "establishment", "漢字", "a", "🙂"]) for _ in range(3000))
    normal = library.normalize(text)
    for size in (1, 7, 500):
        blocks = [normal[i : i + size] for i in range(0, len(normal), size)]
        parts = list(model.stream(blocks))
        assert [i for p in parts for i in p] == library.encode(text)
        assert max(map(len, parts)) <= size + 4 * model.longest


def test_pieces_come_out_in_small_batches():
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [f"text {i}" for i in range(1000)]})
    out = list(pc._encoded(PIECES)([texts]))
    assert max(b.num_rows for b in out) <= pc.DOCS_AT_ONCE
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(1000)) and all(x for b in out for x in b.column("round_trip").to_pylist())


def test_piece_codec_awkward_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pc.encode_pieces(documents(spark).withColumnRenamed("n_chars", "ids"), PIECES).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, text, *_ in rows():
        if i is not None:
            ids = library.encode(text or "")
            assert by[i]["ids"] == ids and by[i]["n_ids"] == len(ids)
            assert by[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            assert by[i]["round_trip"] == ("▁" not in (text or ""))
    assert pc.encode_pieces(nothing(spark), PIECES).count() == 0
