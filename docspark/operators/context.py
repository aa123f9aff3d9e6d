"""Context around retrieved blocks: expansion by section and neighbours, groups of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand(filled: DataFrame, seeds: DataFrame, budget: int, strategy: str = "section_first") -> DataFrame:
    """query_id, doc_id, pos, rank: up to `budget` blocks around the seeds of each query, without these.

    filled: structure.fill_sections; seeds: (query_id, doc_id, pos, seed_rank). section_first: blocks of the seeds' sections that are no headings, section by
    section in the seeds' order, in document order, then neighbours; neighbor_first: for each seed the blocks before and after in the
    document, then in the page, then sections; mixed: sections for half of the budget, then neighbours; interleaved: one of a section, one neighbour, in turn, then
    blocks of the documents' other sections. Only the seeds' documents are looked at.
    """
    if strategy not in ("section_first", "neighbor_first", "mixed", "interleaved"):
        raise ValueError(f"no such strategy: {strategy}")
    filled = filled.join(seeds.select("doc_id").distinct(), "doc_id", "left_semi")
    near_by = Window.partitionBy("doc_id").orderBy("pos")
    page_by = Window.partitionBy("doc_id", "page").orderBy("pos")
    near = F.array(F.lag("pos").over(near_by), F.lead("pos").over(near_by), F.lag("pos").over(page_by), F.lead("pos").over(page_by))
    marked = filled.withColumn("near", near)
    own = seeds.join(marked.select("doc_id", "pos", "section_pos", "near"), ["doc_id", "pos"])
    sections = own.where("section_pos is not null").groupBy("query_id", "doc_id", "section_pos").agg(F.min("seed_rank").alias("place"))
    body = filled.where("not is_heading and section_pos is not null").select("doc_id", "section_pos", "pos")
    first = sections.join(body, ["doc_id", "section_pos"]).select("query_id", "doc_id", "pos", F.struct("place", F.col("pos").alias("at")).alias("order"))
    second = own.select("query_id", "doc_id", "seed_rank", F.posexplode("near").alias("k", "pos")).where("pos is not null")
    second = second.select("query_id", "doc_id", "pos", F.struct(F.col("seed_rank").alias("place"), F.col("k").cast("long").alias("at")).alias("order"))

    def phase(rows: DataFrame, number: int) -> DataFrame:
        return rows.groupBy("query_id", "doc_id", "pos").agg(F.min("order").alias("order")).withColumn("phase", F.lit(number))

    sides = (phase(first, 1), phase(second, 2)) if strategy != "neighbor_first" else (phase(first, 2), phase(second, 1))
    both = sides[0].unionByName(sides[1]).join(seeds.select("query_id", "doc_id", "pos"), ["query_id", "doc_id", "pos"], "left_anti")
    by = Window.partitionBy("query_id").orderBy("phase", "order", "doc_id")
    if strategy == "mixed":
        half = max(1, budget // 2)
        counted = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "phase").orderBy("order", "doc_id")))
        both = counted.where((F.col("phase") == 2) | (F.col("n") <= half)).drop("n")
    if strategy == "interleaved":
        turn = Window.partitionBy("query_id", "phase").orderBy("order", "doc_id")
        both = both.withColumn("order", F.struct(F.row_number().over(turn).alias("place"), F.col("phase").cast("long").alias("at"))).withColumn("phase", F.lit(1))
        other = seeds.select("query_id", "doc_id").distinct().join(body, "doc_id").select("query_id", "doc_id", "pos", F.struct(F.lit(0).alias("place"), F.col("pos").alias("at")).alias("order"))
        both = both.unionByName(other.withColumn("phase", F.lit(3)).join(seeds.select("query_id", "doc_id", "pos"), ["query_id", "doc_id", "pos"], "left_anti"))
    once = both.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "doc_id", "pos").orderBy("phase", "order"))).where("copy = 1")
    return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= budget).select("query_id", "doc_id", "pos", F.col("rank").cast("long").alias("rank"))


def in_document_order(hits: DataFrame) -> DataFrame:
    """Each query's hits once, numbered by document and position in place of score."""
    once = hits.dropDuplicates(["query_id", "doc_id", "pos"])
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "pos")).cast("long"))


def split_groups(ranked: DataFrame, current: int = 4, support: int = 3) -> DataFrame:
    """With `group`: the first hits answer, the next support, others are left out."""
    group = F.when(F.col("rank") <= current, "current").when(F.col("rank") <= current + support, "support")
    return ranked.withColumn("group", group).where("group is not null")


def structural_context(ranked: DataFrame, filled: DataFrame, seeds: int = 8, total: int = 15, more: int = 4, strategy: str = "section_first") -> DataFrame:
    """query_id, doc_id, pos, part, place: the context of each query of `ranked` (query_id, doc_id, pos, rank).

    The `seeds` best are current; their expansion up to `total` supports them, then the `more` next hits as far as there is room.
    """
    chosen = ranked.where(F.col("rank") <= seeds).select("query_id", "doc_id", "pos", F.col("rank").alias("seed_rank"))
    room = chosen.groupBy("query_id").agg((F.lit(total) - F.count(F.lit(1))).alias("room"))
    around = expand(filled, chosen, total, strategy).join(room, "query_id").where(F.col("rank") <= F.col("room")).select("query_id", "doc_id", "pos", F.lit(0).alias("turn"), "rank")
    later = ranked.where(F.col("rank").between(seeds + 1, seeds + more)).select("query_id", "doc_id", "pos", F.lit(1).alias("turn"), "rank")
    return _parts(chosen.select("query_id", "doc_id", "pos", F.col("seed_rank").alias("rank")), around.unionByName(later)).join(room, "query_id").where("part = 'current' or place <= room").drop("room")


def retrieval_context(ranked: DataFrame, blocks: DataFrame, wide: DataFrame) -> DataFrame:
    """query_id, doc_id, pos, part, place: the first 3 hits (4 for a wide question) are current, the next 4 (6) support them, and 4 (6) at most of the blocks before and
    after the first two. wide: (query_id, wide). blocks: (doc_id, pos)."""
    both = ranked.join(wide, "query_id")
    n = F.when(F.col("wide"), 4).otherwise(3)
    most = F.when(F.col("wide"), 6).otherwise(4)
    current = both.where(F.col("rank") <= n).select("query_id", "doc_id", "pos", "rank")
    later = both.where((F.col("rank") > n) & (F.col("rank") <= n + most)).select("query_id", "doc_id", "pos", F.lit(0).alias("turn"), "rank")
    sides = both.where("rank <= 2").select("query_id", "doc_id", "rank", "wide", F.posexplode(F.array(F.col("pos") - 1, F.col("pos") + 1)).alias("k", "pos")).join(blocks.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")
    placed = sides.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "k")).cast("long")).where(F.col("rank") <= most)
    return _parts(current, later.unionByName(placed.select("query_id", "doc_id", "pos", F.lit(1).alias("turn"), "rank")))


def _parts(current: DataFrame, support: DataFrame) -> DataFrame:
    """Both, numbered in their order, each block once; what is current supports nothing."""
    key = ["query_id", "doc_id", "pos"]
    once = support.groupBy(*key).agg(F.min(F.struct("turn", "rank")).alias("o")).join(current.select(*key), key, "left_anti")
    number = lambda df, order, part: df.select(*key, F.lit(part).alias("part"), F.row_number().over(Window.partitionBy("query_id").orderBy(order, "doc_id", "pos")).cast("long").alias("place"))
    return number(current, "rank", "current").unionByName(number(once, "o", "support"))
