"""Quality of recognised pages, and boxes of their layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as X


def page_quality(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), heavy: DataFrame | None = None) -> DataFrame:
    """Density, garbled, wrongly decoded and empty shares and line count of each page, and its score from 0 to 1. heavy: (keys, heavy), how many of a page's pairs of boxes cover
    each other, see layout.pair_counts."""
    solid = F.regexp_replace("content", r"\s+", "")
    marks = sum((F.regexp_count("content", F.lit(m)) for m in X.MOJIBAKE), F.lit(0))
    rows = blocks.select(*keys, F.length(solid).cast("long").alias("n"), X.garbled_ratio(F.col("content")).alias("g"), marks.alias("marks"))
    page = rows.groupBy(*keys).agg(
        F.sum("n").alias("char_len"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.avg(F.when(F.col("n") == 0, 1.0).otherwise(0.0)).alias("empty_ratio"),
        F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("g"))), F.lit(1.0)).alias("garbled_ratio"),
        F.sum((F.col("n") > 0).cast("long")).alias("n_lines"),
        F.sum("marks").alias("marks"),
    )
    over = F.lit(0.0)
    if heavy is not None:
        page, pairs = page.join(heavy.select(*keys, "heavy"), list(keys), "left"), F.col("n_blocks") * (F.col("n_blocks") - 1) / 2
        over = F.when(pairs > 0, F.coalesce("heavy", F.lit(0)) / pairs).otherwise(0.0)
    short = F.when(F.col("char_len") < 20, (20 - F.col("char_len")) / 20).when(F.col("char_len") > 20000, F.least(F.lit(1.0), (F.col("char_len") - 20000) / 15000)).otherwise(0.0)
    lines = F.when(F.col("n_lines") < 2, 1.0).when(F.col("n_lines") > 220, F.least(F.lit(1.0), (F.col("n_lines") - 220) / 120)).otherwise(0.0)
    wrong = F.col("marks") / F.greatest(F.col("char_len"), F.lit(1))
    penalty = 0.25 * short + 0.3 * F.col("garbled_ratio") + 0.15 * F.least(F.lit(1.0), 8 * wrong) + 0.2 * F.col("empty_ratio") + 0.15 * over + 0.1 * lines
    return page.select(
        *keys, "char_len", "n_blocks", F.round("empty_ratio", 4).alias("empty_ratio"), F.round("garbled_ratio", 4).alias("garbled_ratio"), F.round(wrong, 4).alias("mojibake_ratio"), F.round(over, 4).alias("overlap_ratio"),
        F.round(F.greatest(F.lit(0.0), 1 - penalty), 4).alias("score"),
    )


def structure_quality(text: Column) -> Column:
    """(n_tags, n_long, n_unpunctuated, score) of a text whose lines are paragraphs."""
    lines = F.filter(F.transform(F.split(text, "\n"), X.strip), lambda p: p != "")
    tags = F.regexp_count(text, F.lit(r"<[^>\n]+>"))
    heading = text.rlike(r"(?m)^#{1,6}\s")
    long = F.size(F.filter(lines, lambda p: F.length(p) > 500))
    bare = F.size(F.filter(lines, lambda p: (F.length(p) > 120) & ~p.rlike("[.,;:!?。，；：！？]")))
    held = lambda most, n, each: F.least(F.lit(most), n * each)
    penalty = held(0.18, tags, 0.02) + F.when((tags > 0) & heading, 0.08).otherwise(0.0) + held(0.22, long, 0.08) + held(0.2, bare, 0.08)
    return F.struct(tags.cast("long").alias("n_tags"), long.cast("long").alias("n_long"), bare.cast("long").alias("n_unpunctuated"), F.round(F.greatest(F.lit(0.0), 1 - penalty), 4).alias("score"))


def rollup(pages: DataFrame, low: float = 0.6) -> DataFrame:
    """doc_id, n_pages, mean, worst, n_low of page scores."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.round(F.avg("score"), 4).alias("mean_score"), F.min("score").alias("worst_score"), F.sum((F.col("score") < low).cast("long")).alias("n_low")
    )


def area(p: str) -> Column:
    return (F.col(f"{p}.x2") - F.col(f"{p}.x1")) * (F.col(f"{p}.y2") - F.col(f"{p}.y1"))


def overlap(a: str = "a", b: str = "b") -> Column:
    """Area that two boxes have in common."""
    side = lambda c: F.greatest(F.least(F.col(f"{a}.{c}2"), F.col(f"{b}.{c}2")) - F.greatest(F.col(f"{a}.{c}1"), F.col(f"{b}.{c}1")), F.lit(0))
    return side("x") * side("y")


def box_pairs(boxes: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Pairs of boxes of a page that touch, i before j, with their IoU: the join is on the page, and a page has few boxes."""
    a, b = boxes.alias("a"), boxes.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.idx") < F.col("b.idx"), F.col("a.y1") < F.col("b.y2"), F.col("b.y1") < F.col("a.y2"), F.col("a.x1") < F.col("b.x2"), F.col("b.x1") < F.col("a.x2")]
    both = a.join(b, on)
    return both.select(*[F.col(f"a.{k}") for k in keys], F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), F.round(overlap() / (area("a") + area("b") - overlap()), 6).alias("iou"))


def drop_contained(boxes: DataFrame, share: float = 0.8, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Boxes without those of which a larger box of the page covers `share`; of equal boxes the first stays."""
    a, b = boxes.alias("a"), boxes.alias("b")
    larger = (area("b") > area("a")) | ((area("b") == area("a")) & (F.col("b.idx") < F.col("a.idx")))
    covered = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.idx") != F.col("b.idx"), larger, overlap() >= share * area("a")]
    return a.join(b, covered, "left_anti")


def merge_paragraphs(lines: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), factor: float = 1.25) -> DataFrame:
    """keys, paragraph, n_lines: lines (y1, y2) belong together while the gap to the line above is at most `factor` median heights."""
    page = Window.partitionBy(*keys)
    by = page.orderBy("y1", "idx")
    marked = lines.withColumn("height", F.percentile(F.col("y2") - F.col("y1"), F.lit(0.5)).over(page)).withColumn("gap", F.col("y1") - F.lag("y2").over(by))
    fresh = marked.withColumn("fresh", F.when(F.col("gap").isNull() | (F.col("gap") > factor * F.col("height")), 1).otherwise(0))
    return fresh.withColumn("paragraph", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "paragraph").agg(F.count(F.lit(1)).alias("n_lines"))


def suppress(boxes: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), same: float = 0.6, other: float = 0.98) -> DataFrame:
    """The `boxes` (keys, idx, x1, y1, x2, y2, score, label) that greedy non-maximum suppression keeps on each page: by score, ties by idx, a box goes if one that is kept before it covers it by
    `same` or more (`other` for another label), as intersection over union with a pixel's breadth counted in.

    Boxes that none before covers are kept; then, round by round, what they cover goes, and what is covered by boxes that went only is kept. Boxes meet in a page only if they overlap;
    no page is in one call. Boxes of one page and idx count as one, the first by score.
    """
    from docspark.operators.checkpoints import checkpointed

    side = lambda n: [F.col(c).alias(f"{n}_{c}") for c in ("idx", "x1", "y1", "x2", "y2", "score", "label")]
    k, c = boxes.select(*keys, *side("k")), boxes.select(*keys, *side("c"))
    width = F.least("k_x2", "c_x2") - F.greatest("k_x1", "c_x1") + 1
    height = F.least("k_y2", "c_y2") - F.greatest("k_y1", "c_y1") + 1
    size = lambda n: (F.col(f"{n}_x2") - F.col(f"{n}_x1") + 1) * (F.col(f"{n}_y2") - F.col(f"{n}_y1") + 1)
    before = (F.col("k_score") > F.col("c_score")) | ((F.col("k_score") == F.col("c_score")) & (F.col("k_idx") < F.col("c_idx")))
    met = k.join(c, [*keys]).where((F.col("k_idx") != F.col("c_idx")) & before & (width > 0) & (height > 0)).withColumn("both", width * height)
    covers = F.col("both") / (size("k") + size("c") - F.col("both")) >= F.when(F.col("k_label") == F.col("c_label"), same).otherwise(other)
    links = checkpointed(met.where(covers).select(*keys, F.col("k_idx").alias("above"), F.col("c_idx").alias("idx")).distinct())
    gone, open_links = None, links
    while not open_links.isEmpty():
        covered = open_links.select(*keys, "idx").distinct()
        kept = open_links.join(covered.withColumnRenamed("idx", "above"), [*keys, "above"], "left_anti").select(*keys, "above").distinct()  # nothing that is left covers these
        now = checkpointed(open_links.join(kept, [*keys, "above"], "left_semi").select(*keys, "idx").distinct())
        gone = now if gone is None else checkpointed(gone.unionByName(now))
        rest = open_links.join(now, [*keys, "idx"], "left_anti").join(now.withColumnRenamed("idx", "above"), [*keys, "above"], "left_anti")
        open_links = checkpointed(rest)
    return boxes if gone is None else boxes.join(gone, [*keys, "idx"], "left_anti")
