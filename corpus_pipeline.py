"""A corpus pipeline of four stages: quality, near-duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import load
from quern.llm import packing, pii_feistel, quality_gam, simhash_dedup
from quern.llm.storage import materialise

#: The word tokenizer's vocabulary, on every executor.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least its threshold), as they are.

    Null and empty texts are scored like others; repeated rows have one fate; rows without a doc_id are scored too; columns
    of any name pass through. Without labels nothing is rejected; an empty table gives an empty result.
    """
    return quality_gam.accepted(docs, quality_gam.train(docs, load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one with the smallest doc_id.

    Texts without words (null and empty ones too) have fingerprint zero and so make one group. Of rows of a group
    that repeat its doc_id the one whose text has the smallest hash stays; rows that repeat a doc_id with texts of unlike groups
    stay, one for each group; so do rows without a doc_id. An empty table gives an empty result.
    """
    return simhash_dedup.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms of the same format; n_chars follows the text.

    Null and empty texts stay as they are, and so do columns whose names the operator gives to its counts. Repeated rows are
    rewritten alike; an empty table gives an empty result.
    """
    clashing = {c: f"{c}_of_docs" for c in docs.columns if c in ("pii_found", "pii_kinds", "_found")}
    clean = pii_feistel.pseudonymise(docs.withColumnsRenamed(clashing), pii_feistel.key_of(spark))
    clean = clean.withColumn("n_chars", F.when(F.col("pii_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(clashing.get(c, c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents in as few sequences of 4,096 as can be, one row for each piece (the operator's columns).

    A null or empty text is one piece of the end id; repeated rows and rows without a doc_id are packed each; extra columns
    are left out; an empty table gives an empty result.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("pack", pack)]

#: SQL has neither the trained model nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written as Parquet and read again for the next."""
    docs = load(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
