"""The document pipeline: five stages, each on all that the stage before it kept.

A stage takes the session, the documents so far, and the folder of the tables; all but the last return the
columns of documents. Line dedup changes text (and n_chars with it); the others drop rows or encode.

Defined results: null text counts as empty and stays null, rows without doc_id are judged and encoded but have no
duplicates, repeated rows of one doc_id and text end as one row, an empty table gives an empty table, and columns of any
name are carried through untouched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from cataloom.llm.scratch import Store, cut
from cataloom.session import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast("long"))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=True).drop("same")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; between stages the rows are written to the shared folder, whose tables go at the end or on failure."""
    docs, store, before = table(spark, sf_dir, "documents"), Store(spark, "pipeline"), None
    try:
        for name, stage in STAGES[:-1]:
            docs = store.write(stage(spark, docs, sf_dir), name)
            if before:
                store.drop(before)
            before = name
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        store.drop("")


#: The stages fit models and follow links; SQL cannot express them. The tests compare each with brute force.
ORACLE_SQL = None
