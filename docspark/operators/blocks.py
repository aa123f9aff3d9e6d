"""Blocks of documents: building, linking, windows, intervals, packing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators.folds import fold_groups

#: Lines that make a page where a text has no pages.
PAGE_LINES = 20


def line_blocks(documents: DataFrame, *more: str, page_lines: int = PAGE_LINES) -> DataFrame:
    """doc_id, pos, page, idx (within the page), content, and `more` of the document: a block for each line of a text, without a shuffle."""
    lines = documents.select("doc_id", *more, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "content"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.floor(F.col("pos") / page_lines).cast("long").alias("page"), (F.col("pos") % page_lines).cast("long").alias("idx"), "content", *more)


def block_id(page: Column, idx: Column) -> Column:
    return F.concat(F.lit("p"), F.lpad((page + 1).cast("string"), 4, "0"), F.lit("_c"), F.lpad((idx + 1).cast("string"), 3, "0"))


def region_boxes(regions: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes (x1, y1, x2, y2, in thousandths) held within the page, those without area dropped, with their pixels and shares."""
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(1000))
    held = regions.select(*[c for c in regions.columns if c not in ("x1", "y1", "x2", "y2")], *[clamp(c).alias(c) for c in ("x1", "y1", "x2", "y2")]).where("x2 > x1 and y2 > y1")
    sides = {"x1": width, "y1": height, "x2": width, "y2": height}
    return held.select("*", *[F.floor(F.col(c) * side / 1000 + F.lit(0.5)).cast("long").alias(f"{c}_px") for c, side in sides.items()], *[F.round(F.col(c) / 1000, 6).alias(f"{c}_norm") for c in sides])


def links(blocks: DataFrame) -> DataFrame:
    """With the ids before and after: in the document, and in the page."""
    whole, page = Window.partitionBy("doc_id").orderBy("pos"), Window.partitionBy("doc_id", "page").orderBy("pos")
    named = blocks.withColumn("block_id", block_id(F.col("page"), F.col("idx")))
    return named.select("doc_id", "pos", "block_id", *[f("block_id").over(w).alias(n) for n, f, w in (("prev_global", F.lag, whole), ("next_global", F.lead, whole), ("prev_page", F.lag, page), ("next_page", F.lead, page))])


def neighbours(blocks: DataFrame, radius: int = 1) -> DataFrame:
    """For each block, the positions within `radius` in its page, itself aside, in order."""
    if not 1 <= radius <= 5:
        raise ValueError("the radius is 1 to 5")
    around = F.collect_list("pos").over(Window.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(-radius, radius))
    return blocks.select("doc_id", "pos", F.array_remove(around, F.col("pos")).alias("near"))


def merge_intervals(rows: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Bands of overlapping or touching intervals of a key: keys, band, low, high, n."""
    by = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("fresh", F.when(reach.isNull() | (F.col(low) > reach), 1).otherwise(0))
    banded = fresh.withColumn("band", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return banded.groupBy(*keys, "band").agg(F.min(low).alias(low), F.max(high).alias(high), F.count(F.lit(1)).alias("n"))


def islands(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Runs of consecutive positions, with the positions just before and after: key, first, last, before, after."""
    run = F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos))
    return rows.select(key, pos, run.alias("run")).groupBy(key, "run").agg(F.min(pos).alias("first"), F.max(pos).alias("last")).select(key, "first", "last", (F.col("first") - 1).alias("before"), (F.col("last") + 1).alias("after"))


def pack_ranges(lengths: list[int], size: int, overlap: int, join: int = 2) -> Iterator[tuple[int, int]]:
    """(first, last) of the chunks that blocks are packed into: as many as fit into `size` characters with `join` between, the first always. The
    next chunk begins with the last blocks of this one that fit into `overlap`, the very last always, but after this one's first block."""
    upto = [0]
    for n in lengths:
        upto.append(upto[-1] + n)
    width = lambda a, b: upto[b] - upto[a] + join * (b - a - 1)  # noqa: E731  of blocks a to b - 1
    at = 0
    while at < len(lengths):
        end = at + 1
        while end < len(lengths) and width(at, end + 1) <= size:
            end += 1
        yield at, end - 1
        if end == len(lengths):
            return
        back = end - 1 if overlap > 0 else end
        while 0 < overlap and back > at and width(back, end) < overlap and width(back - 1, end) <= overlap:
            back -= 1
        at = back if back > at else min(end, at + 1)


def pack_blocks(blocks: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """doc_id, chunk, first_pos, last_pos, n_blocks, n_chars: greedy packing of each document's blocks that aren't empty.

    An order-dependent fold: only positions and lengths are sent to it.
    """

    def fold(rows):
        pos, upto = [r[1] for r in rows], [0]
        for r in rows:
            upto.append(upto[-1] + r[2])
        return [(rows[0][0], k, pos[a], pos[b], b - a + 1, upto[b + 1] - upto[a] + 2 * (b - a)) for k, (a, b) in enumerate(pack_ranges([r[2] for r in rows], size, overlap))]

    solid = blocks.select("doc_id", "pos", F.length(X.strip(F.col("content"))).cast("long").alias("n")).where("n > 0")
    return fold_groups(solid, ["doc_id"], ["pos"], fold, "doc_id long, chunk long, first_pos long, last_pos long, n_blocks long, n_chars long")


def page_text(blocks: DataFrame) -> DataFrame:
    """Each page's blocks that aren't empty, joined in order by an empty line, numbered anew."""
    solid = blocks.select("doc_id", "page", "pos", X.strip(F.col("content")).alias("content")).where("content != ''")
    parts = F.array_sort(F.collect_list(F.struct("pos", "content")))
    return solid.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_blocks"), F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("markdown"))


def numbered_anew(blocks: DataFrame) -> DataFrame:
    """Blocks without empty content, with idx counted anew from 0 in each page and where they were before."""
    by = Window.partitionBy("doc_id", "page").orderBy("pos")
    return blocks.where(X.strip(F.col("content")) != "").withColumn("was", F.col("idx")).withColumn("idx", F.row_number().over(by).cast("long") - 1)


def band_of_block(bands: DataFrame) -> DataFrame:
    """doc_id, chunk_id, band: of `bands` (doc_id, page, place, band, chunks: the ids it is made of) the first that holds each chunk."""
    each = bands.select("doc_id", "page", "place", "band", F.explode("chunks").alias("chunk_id")).where("trim(chunk_id) != '' and band != ''")
    return each.groupBy("doc_id", "chunk_id").agg(F.min(F.struct("page", "place", "band"))["band"].alias("band"))


def select_ranges(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """who, doc_id, page, idx, place: what each of `ranges` (who, step, doc_id, page, low, high, removes) selects of `blocks` in the end, a later range over an earlier one.

    A range counts only if all its blocks are there.
    """
    met = ranges.join(blocks.select("doc_id", "page", "idx"), ["doc_id", "page"]).where(F.col("idx").between(F.least("low", "high"), F.greatest("low", "high")))
    size = F.abs(F.col("high") - F.col("low")) + 1
    whole = met.groupBy("who", "step").agg(F.count(F.lit(1)).alias("n"), F.first(size).alias("size")).where("n = size").select("who", "step")
    last = met.join(whole, ["who", "step"], "left_semi").groupBy("who", "doc_id", "page", "idx").agg(F.max_by("removes", "step").alias("removes")).where("not removes")
    return last.select("who", "doc_id", "page", "idx", F.row_number().over(Window.partitionBy("who").orderBy("doc_id", "page", "idx")).cast("long").alias("place"))


def carry_ranges(lengths: list[int], size: int, overlap: int, join: int = 2) -> Iterator[tuple[int, int]]:
    """(first, last) of chunks that carry over the last block of the one before, and more of its last blocks up to `overlap`; the size isn't looked at again once the next block is added."""
    first, total, at = 0, 0, 0
    while at < len(lengths):
        add = lengths[at] + (join if at > first else 0)
        if at > first and total + add > size:
            yield first, at - 1
            back, kept = at, 0
            while back > first:
                more = lengths[back - 1] + (join if back < at else 0)
                if back < at and kept + more > overlap:
                    break
                back, kept = back - 1, kept + more
                if kept >= overlap:
                    break
            first, total = back, kept
        total += add
        at += 1
    if lengths:
        yield first, len(lengths) - 1


def pack_carrying(blocks: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """doc_id, chunk, first_pos, last_pos, n_blocks of carry_ranges over each document's blocks that aren't empty."""

    def fold(rows):
        pos = [r[1] for r in rows]
        return [(rows[0][0], k, pos[a], pos[b], b - a + 1) for k, (a, b) in enumerate(carry_ranges([r[2] for r in rows], size, overlap))]

    solid = blocks.select("doc_id", "pos", F.length(X.strip(F.col("content"))).cast("long").alias("n")).where("n > 0")
    return fold_groups(solid, ["doc_id"], ["pos"], fold, "doc_id long, chunk long, first_pos long, last_pos long, n_blocks long")


def manifest(chunks: DataFrame) -> DataFrame:
    """`chunks` (chunk_id, doc_id, doc_name, page, content, section_id, section_path, heading, kind) as the items of a search index, each its own only source, numbered over all by document and id."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(c)).otherwise(none)
    return chunks.select(
        "chunk_id", "doc_id", "doc_name", F.coalesce("page", F.lit(0)).alias("page"), F.lit("paragraph").alias("label"), "content", F.length("content").cast("long").alias("n_chars"), F.array("chunk_id").alias("sources"),
        listed("section_id").alias("source_sections"), listed("section_path").alias("source_paths"), F.array(F.coalesce("kind", F.lit("paragraph"))).alias("source_kinds"), F.coalesce("heading", F.lit("")).alias("heading"),
    )
