"""From raw documents to encoded training text: each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from steadyseed.llm import exact_dedup, mixing, quality, sentence_pieces, simhash_dedup
from steadyseed.llm.common import new_folder, read

PIECE_MODEL = "piece_bpe_32k.model"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text, by the digest index, which takes the documents in ranges of ascending ids."""
    index = exact_dedup.new_index(spark)
    kept = exact_dedup.deduplicate(docs, index)
    index.close()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of fingerprints within four bits."""
    return simhash_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the sentence pieces of every document; the last stage, so its columns are its own."""
    return sentence_pieces.encode_documents(docs, public_tokenizers.path(PIECE_MODEL))


STAGES = [
    ("quality", keep_good), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("mixing", mix_sources),
    ("sentence_pieces", encode),
]
#: The classifier, the fingerprints and the pieces have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; the ids of the mixed corpus.

    Null and empty texts, null ids and repeated rows are what the stages say; an
    empty table gives an empty result.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
