"""Training-data pipeline over ``documents``: quality, exact dedup, near dedup, decontamination, packing.

Every stage works on all its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from tessera.llm import decontam, exact, near, packing, quality
from tessera.llm.common import Scratch, table

#: Tokenizer file of the packing stage.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: SQL can't express the classifier or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score below 0.5).

    Null and empty texts are scored as empty ones, texts of any length whole. Repeated rows stay or go
    together, a score of exactly 0.5 stays, and without usable labels everything does. The row travels
    as one struct, so further columns may have any name. An empty table gives an empty result.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays.

    Texts are equal up to runs of ASCII white space, whatever their length; null and empty ones are
    one text. A null id comes after all others; of repeated rows one stays. Further columns may have
    any name. An empty table gives an empty result.
    """
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates on five-word shingles the smallest id stays.

    Texts of any length are compared whole; null, empty and blank ones have no near duplicate and stay,
    and so do rows with a null id. Rows that repeat the id that stays all stay. Further columns may
    have any name. An empty table gives an empty result.
    """
    return near.representatives(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, with a similarity of 0.8 or more on five-word shingles.

    Texts of any length are read whole; null and empty ones hold no item and stay. Rows that share an
    id stay or go together. Further columns may have any name. An empty table gives an empty result,
    an empty benchmark drops nothing.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null or empty text is its end token alone; a text of any length is cut into as many pieces as it
    needs; repeated rows are packed once each, in order of their place in the input. Further columns
    are left out. An empty table gives no pieces.
    """
    return packing.pack(docs, TOKENIZER, with_ids=False)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and reread as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
