"""Packed chunks and the blocks they are made of: a table of lineage, chunks with what they take from their sources, and context that goes through both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators.blocks import pack_ranges
from docspark.operators.context import expand
from docspark.operators.folds import fold_groups

#: Headings and kinds that a chunk names, at most.
NAMED = 5


def pack_lineage(blocks: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """doc_id, chunk, chunk_id, pos, place: the blocks of each packed chunk in order. Blocks (doc_id, pos, content, ...) without text aren't packed, nor are those with
    kind 'image', if there is such a column. Only positions and lengths go through the fold."""

    def fold(rows):
        return [(rows[0][0], k, rows[at][1], at - first) for k, (first, last) in enumerate(pack_ranges([r[2] for r in rows], size, overlap)) for at in range(first, last + 1)]

    if "kind" in blocks.columns:
        blocks = blocks.where(F.coalesce(F.lower(F.trim("kind")), F.lit("")) != "image")
    solid = blocks.select("doc_id", "pos", F.length(X.strip(F.col("content"))).cast("long").alias("n")).where("n > 0")
    kind = blocks.schema["doc_id"].dataType.simpleString()
    found = fold_groups(solid, ["doc_id"], ["pos"], fold, f"doc_id {kind}, chunk long, pos long, place long")
    name = F.concat(F.lit(f"rag_{size}_{overlap}_"), F.lpad(F.col("chunk").cast("string"), 4, "0"))
    return found.select("doc_id", "chunk", F.when(F.col("chunk") < 10_000, name).otherwise(F.concat(F.lit(f"rag_{size}_{overlap}_"), F.col("chunk"))).alias("chunk_id"), "pos", "place")


def packed_chunks(lineage: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each chunk of `lineage`: doc_id, chunk, chunk_id, page (its first), content, n_chars, n_sources, sources, pages (sorted), sections and kinds (in order, each once),
    heading (its first headings), section and kind (the first section, the first kinds).

    blocks: (doc_id, pos, page, content, section_pos, kind, heading), heading being null or empty for blocks that are none. A chunk's blocks are gathered, no document.
    """
    own = lineage.join(blocks.select("doc_id", "pos", "page", X.strip(F.col("content")).alias("content"), "section_pos", "kind", "heading"), ["doc_id", "pos"])
    parts = F.array_sort(F.collect_list(F.struct("place", "pos", "page", "content", "section_pos", "kind", "heading"))).alias("parts")
    gathered = own.groupBy("doc_id", "chunk", "chunk_id").agg(parts)
    every = lambda c: F.transform("parts", lambda p: p[c])
    once = lambda c: F.array_distinct(F.filter(every(c), lambda v: v.isNotNull() & (v.cast("string") != "")))
    rows = gathered.select("doc_id", "chunk", "chunk_id", every("pos").alias("sources"), F.array_sort(F.array_distinct(every("page"))).alias("pages"), once("section_pos").alias("sections"), once("kind").alias("kinds"), once("heading").alias("headings"), F.array_join(every("content"), "\n\n").alias("content"))
    joined = lambda c, sep: F.array_join(F.slice(c, 1, NAMED), sep)
    return rows.select(
        "doc_id", "chunk", "chunk_id", F.get("pages", F.lit(0)).alias("page"), "content", F.length("content").cast("long").alias("n_chars"), F.size("sources").cast("long").alias("n_sources"), "sources", "pages", "sections", "kinds",
        joined("headings", " | ").alias("heading"), F.get("sections", F.lit(0)).alias("section"), joined("kinds", ",").alias("kind"),
    )


def seed_blocks(hits: DataFrame, lineage: DataFrame) -> DataFrame:
    """query_id, doc_id, pos, seed_rank: the blocks that the chunks of `hits` (query_id, doc_id, chunk, rank) are made of, each once, chunk by chunk in the order of rank."""
    met = hits.join(lineage.select("doc_id", "chunk", "pos", "place"), ["doc_id", "chunk"])
    first = met.groupBy("query_id", "doc_id", "pos").agg(F.min(F.struct("rank", "place")).alias("at"))
    return first.select("query_id", "doc_id", "pos", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id")).cast("long").alias("seed_rank"))


def packed_context(hits: DataFrame, lineage: DataFrame, filled: DataFrame, budget: int = 6, strategy: str = "section_first") -> DataFrame:
    """query_id, doc_id, pos, part, place: the source blocks of each query's hits among packed chunks (part 'source'), and the blocks around them ('related', `budget` at most).

    hits: (query_id, doc_id, chunk, rank); filled: structure.fill_sections. A document that was packed but has no structure gives sources only.
    """
    seeds = seed_blocks(hits, lineage)
    related = expand(filled, seeds, budget, strategy)
    part = lambda df, name, place: df.select("query_id", "doc_id", "pos", F.lit(name).alias("part"), F.col(place).alias("place"))
    return part(seeds, "source", "seed_rank").unionByName(part(related, "related", "rank"))

