"""Queries of the index that outlives them. Each builds one in a new folder beside the checkpoints and asks it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docspark.operators import search_index as I
from docspark.operators.checkpoints import checkpoint_folder
from docspark.plans.base import BM25, TOKENS, bm25_sql, items, query, questions, table

TOP10 = "SELECT query_id, item_id, round(score, 6) AS score, r AS rank FROM (SELECT query_id, item_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS r FROM bm25) WHERE r <= 10"


def folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"


def best(spark, sf_dir, path):
    return I.top(questions(spark, sf_dir), path, 10).withColumn("score", F.round("score", 6))


@query(f"""SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS('text')})) AS term FROM documents) GROUP BY term UNION ALL
        SELECT '', count(*) FROM documents""")
def index_build(spark, sf_dir):
    """Document frequency of every term of a new index, and the number of documents."""
    path = folder(spark)
    I.build(items(spark, sf_dir), path)
    return I.stored(spark, path, "counts", "bigint").groupBy("term").agg(F.sum("df").alias("df"))


@query(f"WITH {BM25} {TOP10}")
def index_search(spark, sf_dir):
    path = folder(spark)
    I.build(items(spark, sf_dir), path)
    return best(spark, sf_dir, path)


@query(f"WITH {BM25} {TOP10}")
def index_upsert(spark, sf_dir):
    """Built before some documents came and others got their texts: what it finds at last is what an index of all documents finds."""
    path, own = folder(spark), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", F.concat_ws(" ", "lang", "source", F.substring("text", 1, 200)).alias("draft"))
    late, changed = F.col("item_id") % 5 == 0, F.col("item_id") % 3 == 0
    I.build(own.where(~late).select("item_id", F.when(changed, F.col("draft")).otherwise(F.col("text")).alias("text")), path)
    I.upsert(own.where(late).select("item_id", "draft").withColumnRenamed("draft", "text"), path)
    I.upsert(own.where(late | changed).select("item_id", "text"), path)
    return best(spark, sf_dir, path)


@query(f"WITH {bm25_sql('SELECT doc_id AS item_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)')} {TOP10}")
def index_delete(spark, sf_dir):
    """Toxic documents go one by one, and the index is put together anew."""
    path = folder(spark)
    I.build(items(spark, sf_dir), path)
    I.delete(table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id")), path)
    I.compact(spark, path)
    return best(spark, sf_dir, path)
