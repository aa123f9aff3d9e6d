"""The corpus pipeline: four operators of docspark.llm, each stage written as Parquet and read again as the next one's documents.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns of any name: see its docstring. The
second stage takes candidates from op3's ball hashing of SimHashes, and from MinHash bands as well: SimHashes of texts 0.8 alike differ in too many bits for a ball.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import checkpoint_folder, table
from docspark.llm.mixing import mixed_texts
from docspark.llm.near_copies import without_near_duplicates
from docspark.llm.packing import pack_documents
from docspark.llm.quality import fit_quality, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good, with their columns of COLUMNS; further columns are left behind.

    A null or empty text gets the score of the model's bias; repeated rows share a fate; without labels all documents score 0.5 and go. An empty table gives no rows.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    own = [c for c in COLUMNS if c in docs.columns]
    scored = score_quality(docs, model, keep=tuple(own)).where("predicted = 1")
    return scored.select(*[F.col(f"kept.{c}").alias(c) for c in own])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id, null before all others; among equal ids the smallest hash of the row.

    Null texts and texts without words are copies of one another; rows equal in all columns are one. An empty table gives no rows.
    """
    return without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix draws a document, with as much of its text as is drawn and n_chars counted again.

    Null and empty texts are never drawn; null sources are one source; equal rows are drawn alike. An empty table gives no rows.
    """
    return mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Repeated rows are packed again. An empty table gives no rows."""
    return pack_documents(docs)


STAGES = [("quality classifier", classify), ("near duplicates by SimHash balls and MinHash bands", deduplicate), ("source mixing", mix), ("lexical packing", pack)]

#: A fitted classifier, hashed draws and greedy packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What is between stages goes to the cluster's shared checkpoint folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
