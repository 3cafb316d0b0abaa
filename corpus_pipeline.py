"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), reads all that the stage before it kept, and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's result as Parquet to the shared folder and reads it again, so
a lost executor costs no earlier stage; what the stage wrote besides, and its input, are then deleted.

All stages take nulls in any column, empty and very long texts, repeated rows, ties, empty tables, and further columns, whatever their names. An empty table
gives an empty one. What becomes of the rest is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, language, packing, pii, simhash
from lodestrata.llm.session import documents, drop, kept, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose language isn't told with a score of 0.4 or more.

    Null and empty texts have no letter. Rows are judged each by itself, so repeated ones share their fate; a null doc_id or lang teaches nothing. If no
    row has a language, no language is told and all rows go.
    """
    return language.accepted(docs, language.fit(language.training_rows(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a Jaccard similarity of 0.8 or more of their five-word shingles.

    Pairs are found by SimHash fingerprints in BK-trees and checked by the sets of shingles. The least doc_id of a group stays; of rows that share it, the least one. Rows with a null doc_id are in no group: one of each text stays.
    """
    return simhash.distinct(docs, shingle=simhash.STAGE_SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a test item.

    Each row is judged by its own text, also where rows share a doc_id or have none; null and empty texts overlap nothing, and neither do items of under five words.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put labels for personal data and for terms that disclose it.

    Null texts stay null; rows without personal data stay as they are; repeated rows are changed alike, and count as documents of their own.
    """
    return pii.sanitise(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left.

    A null text is an empty one: its end token. Repeated rows and rows with a null doc_id are packed each by itself.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("packing", sequences),
]

#: Random fields, fingerprints of XXH64 values and tokenizers aren't SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            done = kept(stage(spark, docs, sf_dir), name)
        if number:
            drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
