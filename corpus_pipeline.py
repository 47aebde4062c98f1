"""The corpus pipeline: rules, exact copies, near copies, mixing, ids; part of the ``llm`` subpackage.

Every stage takes the documents its predecessor kept. All but the last return the columns of ``documents``; the
last returns piece ids in place of the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import quality_rules as qr
from netloom.llm.common import cut, table
from netloom.llm.exact_dedup import drop_copies
from netloom.llm.near_dedup import drop_near_copies
from netloom.llm.piece_codec import encode_pieces
from netloom.llm.source_mix import mix_sources

#: SQL has no way to state near copies, raking and piece ids; tests hold every stage and the whole run against plain Python.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """Id, text and the marginals' columns beside the whole row as one struct, so that no name given out replaces a column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "lang", "source")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram verdict.

    Null, empty and short texts fail; repeated rows fare alike; an empty table gives none. Columns come out as they went in.
    """
    ratios = qr.fit_ratios(docs, qr.trusted_texts(docs, table(spark, sf_dir, "labels")))
    return qr.quality_rules(_packed(docs).select("_row", "text"), ratios).where("kept").select("_row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, but for the case of A-Z, the one with the largest id.

    Null counts as empty; of rows equal in id and text one stays; null ids come after all others. Columns come out as they went in.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: five words a shingle, similarity 0.8.

    Texts without words are linked with nothing and stay; of rows equal in id and text one stays. Columns come out as they went in.
    """
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target shares of the tokens.

    A null source or language is a value of its own; texts without words follow their cell; rows of equal id share their fate
    within a cell. Columns come out as they went in.
    """
    return mix_sources(_packed(docs), carry=["_row"]).where("sampled").select("_row.*")


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text, with proof that they decode to it; null and empty texts have none."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("piece_ids", piece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between two stages the documents are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position + 1 < len(STAGES):
            docs = cut(docs)
    return docs
