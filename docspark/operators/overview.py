"""Overviews of documents from a few of their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_rank(label: Column) -> Column:
    """Titles first, then sections, then anything else."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.when(low.rlike("title|heading|header"), 0).when(low.rlike("section|subtitle"), 1).otherwise(2)


def sample(blocks: DataFrame, pages: int = 3, first: int = 8, other: int = 4, most: int = 24) -> DataFrame:
    """doc_id, page, pos, k, content: blocks (doc_id, page, pos, label, content) of the first pages, titles before sections before others, `first` on page 0, `other` on others, `most` in all."""
    solid = blocks.where((F.col("page") < pages) & (F.trim("content") != ""))
    ranked = solid.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(label_rank(F.col("label")), "pos")))
    kept = ranked.where(F.col("n") <= F.when(F.col("page") == 0, first).otherwise(other))
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "n")).cast("long")).where(F.col("k") <= most).select("doc_id", "page", "pos", "k", "content")


def title_candidates(sampled: DataFrame, chars: int = 80, most: int = 5) -> DataFrame:
    """doc_id, place, title: the first distinct texts of a sample of at most `chars` characters."""
    short = sampled.select("doc_id", "k", F.trim("content").alias("title")).where(F.length("title") <= chars).groupBy("doc_id", "title").agg(F.min("k").alias("k"))
    return short.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")).cast("long")).where(F.col("place") <= most).select("doc_id", "place", "title")


def heuristic(sampled: DataFrame, points: int = 6, chars: int = 120, words: int = 3) -> DataFrame:
    """doc_id, short (the first characters of the first text), long (the first texts), keywords (the first title candidates) of a sample."""
    ranked = sampled.select("doc_id", F.trim("content").alias("t"), "k").where(F.col("k") <= points)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda p: p["t"])
    keys = title_candidates(sampled).where(F.col("place") <= words).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("keys"))
    own = ranked.groupBy("doc_id").agg(texts.alias("texts")).join(keys, "doc_id", "left")
    none = F.array().cast("array<string>")
    return own.select("doc_id", F.substring(F.col("texts")[0], 1, chars).alias("short"), F.array_join("texts", "\n").alias("long"), F.coalesce(F.transform("keys", lambda x: x["title"]), none).alias("keywords"))
