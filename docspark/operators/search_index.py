"""A BM25 index that outlives queries: Parquet tables in a folder, changed document by document.

Every change is a generation: a folder of its own in each table, in force once its row stands in `log`. Nothing is rewritten, so a lost executor or a failed
change leaves the index as it was. One writer at a time.

postings   term, item_id, tf, dl, dealt by hash of the term into folders, sorted by term: a search reads the folders of asked terms only
forward    item_id, dl, terms, dealt by hash of the item: what an item held when it was last changed, so that its terms' counts can be taken back; dl is null for a deleted item
counts     term, df: corrections, dealt as postings are; term '' has the number of items in df and their length in length
log        generation, base, parts: the generations from the last `base` on count; parts is the number of folders
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators.checkpoints import checkpointed
from docspark.operators.retrieval import bm25_scores, query_terms
from docspark.operators.scoring import best, listed, one_row, packed_postings, query_blocks

#: Folders of a generation, if an index isn't built with another number. Terms that a search names in its filter, at most; beyond them only folders are chosen.
PARTS, NAMED_TERMS = 16, 1000
SCHEMAS = {
    "postings": lambda kind: f"term string, item_id {kind}, tf bigint, dl bigint, generation bigint, part int",
    "forward": lambda kind: f"item_id {kind}, dl bigint, terms array<struct<term:string,tf:bigint>>, generation bigint, part int",
    "counts": lambda kind: "term string, df bigint, length bigint, generation bigint, part int",
}


def part_of(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def generations(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(base, last, parts) of the generations in force."""
    rows = spark.read.schema("generation bigint, base bigint, parts int").parquet(f"{path}/log").orderBy(F.col("generation").desc()).limit(1).collect()
    if not rows:
        raise ValueError(f"no index in {path}")
    return rows[0].base, rows[0].generation, rows[0].parts


def stored(spark: SparkSession, path: str, table: str, kind: str) -> DataFrame:
    """The rows of a table that are in force. Only folders of those generations are read."""
    base, last, _ = generations(spark, path)
    return spark.read.schema(SCHEMAS[table](kind)).option("basePath", f"{path}/{table}").parquet(f"{path}/{table}").where(F.col("generation").between(base, last))


def item_type(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/kind").schema["item_id"].dataType.simpleString()


def put(df: DataFrame, path: str, table: str, generation: int, by: str, parts: int) -> None:
    """Written by folder; Spark splits a folder that a common term makes large among several tasks and files."""
    dealt = df.withColumn("part", part_of(by, parts)).hint("rebalance", "part").sortWithinPartitions("part", by)
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/{table}/generation={generation}")


def logged(spark: SparkSession, path: str, generation: int, base: int, parts: int) -> None:
    spark.createDataFrame([(generation, base, parts)], "generation bigint, base bigint, parts int").coalesce(1).write.mode("append").parquet(f"{path}/log")


def analysed(items: DataFrame, tokens=X.simple_tokens) -> DataFrame:
    """item_id, dl, terms of `items` (item_id, text), one row an item: texts are counted where they are read, and don't move. An id that comes twice counts by its longest text, ties by the text."""
    twice = checkpointed(items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item_id"))
    longest = items.join(twice, "item_id", "left_semi").groupBy("item_id").agg(F.max(F.struct(F.length("text"), "text"))["text"].alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            t = batch.column("t")
            n, flat = t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), t.flatten().dictionary_encode()
            words, width = flat.dictionary, max(len(flat.dictionary), 1)
            both, tf = np.unique(np.repeat(np.arange(len(n)), n) * width + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
            terms = pa.StructArray.from_arrays([words.take(pa.array(both % width)), pa.array(tf.astype(np.int64))], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(n), listed(terms, np.bincount(both // width, minlength=len(n)))], ["item_id", "dl", "terms"])

    schema = f"item_id {kind}, dl long, terms array<struct<term:string,tf:bigint>>"
    of = lambda rows: rows.select("item_id", tokens(F.col("text")).alias("t")).mapInArrow(count, schema)
    return of(items.join(twice, "item_id", "left_anti").select("item_id", "text")).unionByName(of(longest))


def write_generation(spark: SparkSession, path: str, generation: int, base: int, parts: int, changed: DataFrame, before: DataFrame | None) -> None:
    """changed: (item_id, dl, terms), dl null where an item goes; before: the same of what these items held."""
    put(changed, path, "forward", generation, "item_id", parts)
    now = stored_generation(spark, path, generation, changed)
    there = now.where("dl is not null")
    postings = there.select("item_id", "dl", F.explode("terms").alias("t")).select("t.term", "item_id", "t.tf", "dl")
    put(postings, path, "postings", generation, "term", parts)

    def counts(rows: DataFrame, sign: int) -> DataFrame:
        terms = rows.select(F.explode("terms.term").alias("term")).groupBy("term").agg((sign * F.count(F.lit(1))).alias("df")).withColumn("length", F.lit(0).cast("long"))
        whole = rows.agg((sign * F.count(F.lit(1))).alias("df"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("length")).select(F.lit("").alias("term"), "df", "length")
        return terms.unionByName(whole)

    delta = counts(there, 1) if before is None else counts(there, 1).unionByName(counts(before, -1))
    put(delta.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).where("df != 0 or length != 0"), path, "counts", generation, "term", parts)
    logged(spark, path, generation, base, parts)


def stored_generation(spark: SparkSession, path: str, generation: int, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(f"{path}/forward/generation={generation}")


def build(items: DataFrame, path: str, tokens=X.simple_tokens, parts: int = PARTS) -> None:
    """A new index of `items` (item_id, text) in the new folder `path`, generation 0. Null texts count as items without terms; null ids are left out."""
    spark = items.sparkSession
    items.select("item_id").limit(0).write.mode("overwrite").parquet(f"{path}/kind")
    write_generation(spark, path, 0, 0, parts, analysed(items.select("item_id", "text").where("item_id is not null"), tokens), None)


def changed_since(spark: SparkSession, path: str, base: int) -> DataFrame:
    """item_id, latest: items that changed after the generation `base`, and when they last did."""
    return stored(spark, path, "forward", item_type(spark, path)).where(F.col("generation") > base).groupBy("item_id").agg(F.max("generation").alias("latest"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """item_id, generation, dl, terms: each item as it was last changed, deleted ones too. Only changed items are looked up; the others are taken as they stand."""
    base, last, _ = generations(spark, path)
    own = stored(spark, path, "forward", item_type(spark, path)).select("item_id", "generation", "dl", "terms")
    if last == base:
        return own
    return own.join(changed_since(spark, path, base), "item_id", "left").where("latest is null or generation = latest").drop("latest")


def _change(spark: SparkSession, path: str, changed: DataFrame) -> None:
    """Folders of changed items are read, no others: the old rows take their terms' counts back."""
    changed = checkpointed(changed)
    base, last, parts = generations(spark, path)
    own_parts = [r.part for r in changed.select(part_of("item_id", parts).alias("part")).distinct().collect()]  # `parts` rows at most
    if not own_parts:
        return
    own = stored(spark, path, "forward", item_type(spark, path)).where(F.col("part").isin(own_parts)).join(changed.select("item_id"), "item_id", "left_semi").select("item_id", "generation", "dl", "terms")
    latest = own.groupBy("item_id").agg(F.max("generation").alias("generation"))
    before = checkpointed(own.join(latest, ["item_id", "generation"]).where("dl is not null").select("item_id", "dl", "terms"))
    write_generation(spark, path, last + 1, base, parts, changed, before)


def upsert(items: DataFrame, path: str, tokens=X.simple_tokens) -> None:
    """Items (item_id, text) that come or change, as one generation."""
    _change(items.sparkSession, path, analysed(items.select("item_id", "text").where("item_id is not null"), tokens))


def delete(ids: DataFrame, path: str) -> None:
    """Items (item_id) that go; ids that aren't there change nothing."""
    spark = ids.sparkSession
    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    _change(spark, path, ids.where("item_id is not null").select("item_id").distinct().select("item_id", F.lit(None).cast("long").alias("dl"), empty.alias("terms")))


def compact(spark: SparkSession, path: str) -> None:
    """All items in one generation, which is the new base; folders before it are no longer read."""
    _, last, parts = generations(spark, path)
    write_generation(spark, path, last + 1, last + 1, parts, current(spark, path).where("dl is not null").select("item_id", "dl", "terms"), None)


def asked_rows(spark: SparkSession, path: str, table: str, terms: list[str] | None, parts: list[int]) -> DataFrame:
    """Rows of a table dealt by term, of the folders `parts`; `terms` go into the scan's filter, where they are few."""
    rows = stored(spark, path, table, item_type(spark, path)).where(F.col("part").isin(parts))
    return rows if terms is None else rows.where(F.col("term").isin(terms))


def in_force(queries: DataFrame, path: str, tokens=X.simple_tokens) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(postings, df, whole, asked) of what `queries` (query_id, question) ask for."""
    spark = queries.sparkSession
    asked = checkpointed(query_terms(queries, tokens))
    named = sorted(r.term for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect())
    terms = [*named, ""] if len(named) <= NAMED_TERMS else None
    base, last, n_parts = generations(spark, path)
    every = asked.select("term").unionByName(spark.range(1).select(F.lit("").alias("term")))
    parts = sorted(r.part for r in every.select(part_of("term", n_parts).alias("part")).distinct().collect())  # `n_parts` rows at most
    counts = asked_rows(spark, path, "counts", terms, parts).groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
    whole = counts.where("term = ''").select(F.col("df").alias("n"), F.greatest(F.col("length") / F.greatest("df", F.lit(1)), F.lit(1e-6)).alias("avgdl"))
    postings = asked_rows(spark, path, "postings", terms, parts).join(asked.select("term").distinct(), "term", "left_semi")
    if last > base:  # of items that have changed since, only the last generation counts
        postings = postings.join(changed_since(spark, path, base), "item_id", "left").where("latest is null or generation = latest")
    return postings.select("item_id", "term", "tf", "dl"), counts.where("term != ''").select("term", "df"), whole, asked


def search(queries: DataFrame, path: str, tokens=X.simple_tokens, repeat_terms: bool = True) -> DataFrame:
    """query_id, item_id, score, matched of `queries` (query_id, question): retrieval.bm25 of all items as they are now; a row for each pair. For the best items see top."""
    return bm25_scores(*in_force(queries, path, tokens), repeat_terms)


def top(queries: DataFrame, path: str, k: int, digits: int = 9, tokens=X.simple_tokens) -> DataFrame:
    """query_id, item_id, score, rank: the k best of search, rounded, ties by item. Postings are dealt by item, and scored within tasks (scoring.best)."""
    postings, df, whole, asked = in_force(queries, path, tokens)
    found = best(packed_postings(postings), query_blocks(asked, checkpointed(df)), one_row(whole), {"": (k, digits, lambda s: s.bm25)})
    return checkpointed(found.select("query_id", "item_id", "score", "rank"))
