"""The corpus pipeline: quality classifier, exact and near deduplication, mixing, tokenisation.

Each stage takes the documents that the one before kept. ``run`` applies them in turn; the check tool and the driver may
also write each stage's result and hand it to the next.

Near copies are documents whose sets of five-word shingles have a resemblance of 0.8 or more; copies with more changes than
that are different documents here (``op9`` takes two-word shingles, by its contract).

Defined cases: documents without words go in the first stage; rows that repeat an id with other texts are told apart by
their text, except that all rows of the id that a group of near copies keeps stay; of rows that repeat id and text the
exact stage leaves one; null ids pass all stages; very long texts are processed whole; ties are settled as the operators
say; an empty table gives an empty result; further columns stay until the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phasegrid.llm import exact_dedup, mixing, near_dedup, quality, sentencepiece_codec
from phasegrid.llm.common import cut, packed


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample holds; labels come from the ``labels`` table."""
    return packed(quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return packed(exact_dedup.drop_copies(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a resemblance of 0.8 of five-word shingles."""
    return packed(near_dedup.drop_near_copies(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents mixed to their sources' target weights, a row for each pass in which a document is drawn."""
    return packed(mixing.mixed_documents(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return packed(sentencepiece_codec.encoded(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokenise),
]

#: SQL can express neither the hashed models nor the tokeniser; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table ``documents``; each result is cut before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
