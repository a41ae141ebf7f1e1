"""The corpus pipeline: from documents to packed sequences.

Toxic documents and those of poor quality go, one document of each group of near duplicates stays,
the sources are mixed to their target weights, and what the mix takes is packed. Every stage works
on all rows that the one before has kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pomelo.llm import minhash, mixing, packing, quality, toxicity
from pomelo.llm.common import table
from pomelo.llm.queries import tokenizer_path
from pomelo.session import materialize

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic.

    Null and empty texts have no terms and stay unless a text without terms is predicted to be toxic; without
    labels of both classes all documents stay. Repeated rows stay or go together. An empty table gives an
    empty one; columns besides those of ``documents`` are left out.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*DOCUMENT_COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be of good quality.

    Null and empty texts are judged as texts without tokens; without labels of both classes all documents
    stay. Repeated rows stay or go together. An empty table gives an empty one.
    """
    return quality.good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*DOCUMENT_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Null, empty and blank texts have no shingles, are linked with nothing and all stay. Of rows that repeat an id
    one stays if its texts are linked. An empty table gives an empty one.
    """
    return minhash.without_near_copies(docs).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them: up to three times, or not at all.

    Null and empty texts have no words, so no budget takes them. A null source is one of its own. Of repeated
    rows as many are taken as are wanted. An empty table gives an empty one.
    """
    return mixing.mixed_documents(docs).select(*DOCUMENT_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of at most 1024 tokens.

    A null or empty text is its end token alone. Repeated rows are packed each on its own. An empty table gives no
    pieces.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Classifiers, components and differencing can't be put in SQL; tests/llm checks them by brute force.
ORACLE_SQL = None
