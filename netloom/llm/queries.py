"""The queries of this folder: ``QUERIES[name] = (callable on (spark, folder), SQL or None)``."""

from __future__ import annotations

import public_tokenizers

from netloom.llm import quality_rules as qr
from netloom.llm import collocations, page_templates, secret_scan, target_resample, weak_quality
from netloom.llm.common import table
from netloom.llm.exact_dedup import exact_dedup
from netloom.llm.near_dedup import near_dedup
from netloom.llm.piece_codec import encode_pieces
from netloom.llm.repair_ids import token_files
from netloom.llm.source_mix import mix_sources
from netloom.llm.token_counts import token_counts
from netloom.llm.warc_archive import archive

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


@query("op8_quality_rules")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    ratios = qr.fit_ratios(docs, qr.trusted_texts(docs, table(spark, folder, "labels")))
    return qr.quality_rules(docs.select("doc_id", "text"), ratios).drop("text")


@query(
    "op7_exact_dedup",
    """WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    keyed AS (SELECT doc_id, sha256(t) AS text_sha256 FROM low),
    grouped AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM keyed JOIN grouped USING (text_sha256)""",
)
def _(spark, folder):
    return exact_dedup(table(spark, folder, "documents"))


@query("op4_near_dedup")
def _(spark, folder):
    return near_dedup(table(spark, folder, "documents"), size=4)


@query("op1_token_counts")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_token_files")
def _(spark, folder):
    return token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_piece_codec")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op6_warc_archive",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    big AS (SELECT html, max(page_id) AS first_id FROM p WHERE strlen(html) >= 1000 GROUP BY html)
    SELECT page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS payload_digest,
      CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM p LEFT JOIN big ON p.html = big.html""",
)
def _(spark, folder):
    return archive(table(spark, folder, "pages"))


@query("op10_secret_scan", secret_scan.SQL)
def _(spark, folder):
    return secret_scan.secret_scan(table(spark, folder, "documents"))


@query("op5_source_mix")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mix_sources(docs, carry=["doc_id", "lang", "source"])


@query("op3_weak_quality")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return weak_quality.weak_quality(docs, weak_quality.fit(docs))


@query("op11_target_resample", target_resample.SQL)
def _(spark, folder):
    drawn = target_resample.importance_resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), carry=["doc_id"])
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")


@query("op13_collocations", collocations.SQL)
def _(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


@query("op12_page_templates", page_templates.SQL)
def _(spark, folder):
    return page_templates.main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")
