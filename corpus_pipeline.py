"""From raw documents to packed training sequences, each stage by one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, language, minhash_join, mixing, packing
from millrace.llm.queries import tokenizer_file
from millrace.llm.shared import KEY, checkpoint_dir

#: A document whose largest language has a smaller share of its words is rejected, as is one without letters.
LEAST_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty texts among them), and those in which no language reaches
    LEAST_SHARE of the words. If no row has a language to learn from, only documents without letters go.

    Each row is judged by its own text, also where it repeats an id or has none.
    """
    model = language.learn(docs)

    def judge(rows: DataFrame) -> DataFrame:
        told = language.label(rows, model, id_col=KEY)
        return told.select(F.col("doc_id").alias(KEY), ((F.col("n_words") > 0) & ((F.col("lang_pred") == language.UNKNOWN) | (F.col("score") >= LEAST_SHARE))).alias("kept"))

    return exact_dedup.keep_rows(docs, judge)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for white space) the row with the most code points, then the smallest id, stays.

    Null and empty texts are one group. Rows that repeat an id, or have none, are documents of their own.
    """
    return exact_dedup.keep_rows(docs, lambda rows: exact_dedup.exact_duplicates(rows, key_col=KEY))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest id: shingles of five words, similarity 0.8.

    Texts without words are linked with nothing. Rows that repeat an id, or have none, are documents of their own.
    """
    return exact_dedup.keep_rows(docs, lambda rows: minhash_join.near_duplicates(rows, id_col=KEY).select(F.col("doc_id").alias(KEY), "kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, some not at all and some twice; those without words once.

    A source's words are those of the mix's plan, give or take its largest document; a null source is one of its own.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequence and the offset of each.

    Rows that repeat an id are packed each; a null text is empty and gives the end id alone.
    """
    return packing.pack(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the language model, MinHash signatures or the genetic algorithm; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the cluster's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
