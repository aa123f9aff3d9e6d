"""Layout of recognised pages: reading order, lines, metrics of boxes, column risk, filters of detected regions, merges of neighbouring blocks."""

from __future__ import annotations

from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.folds import fold_groups
from docspark.operators.quality import area, overlap

PAGE = ("doc_id", "page")


def reading_order(boxes: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Boxes with an area, with `place` in their page: by the middle of their height, then from the left; ties by idx."""
    by = Window.partitionBy(*keys).orderBy((F.col("y1") + F.col("y2")) / 2, "x1", "idx")
    return boxes.where("x2 > x1 and y2 > y1").withColumn("place", F.row_number().over(by).cast("long") - 1)


def group_lines(boxes: list[tuple[int, float, float, float, float]]) -> list[list[int]]:
    """Indices of `boxes` (idx, x1, y1, x2, y2), in reading order, by line: each box joins the first line whose mean middle is near in height and whose
    extent is near sideways."""
    if not boxes:
        return []
    tolerance = max(6.0, median(b[4] - b[2] for b in boxes) * 0.45)
    wide = max(50.0, 3 * tolerance)
    lines: list[dict] = []
    for k, (_, x1, y1, x2, y2) in enumerate(boxes):
        middle = (y1 + y2) / 2
        for line in lines:
            gap = max(x1 - line["right"], line["left"] - x2, 0)
            if abs(middle - line["sum"] / len(line["of"])) <= tolerance and gap <= wide:
                line["of"].append(k)
                line["sum"], line["left"], line["right"] = line["sum"] + middle, min(line["left"], x1), max(line["right"], x2)
                break
        else:
            lines.append({"of": [k], "sum": middle, "left": x1, "right": x2})
    return [line["of"] for line in lines]


def merge_lines(boxes: DataFrame) -> DataFrame:
    """doc_id, page, line, x1, y1, x2, y2, n_blocks, text: boxes (doc_id, page, idx, x1, y1, x2, y2, content) as lines from the top; lines without text are dropped.

    An order-dependent fold over one page at a time, since a line's middle moves as boxes join it.
    """

    def fold(rows):
        ordered = sorted(rows, key=lambda r: ((r[4] + r[6]) / 2, r[3], r[2]))
        out = []
        for of in group_lines([r[2:7] for r in ordered]):
            own = sorted((ordered[k] for k in of), key=lambda r: (r[3], r[2]))
            text = " ".join(t for r in own if (t := (r[7] or "").strip()))
            if text:
                out.append((min(r[4] for r in own), min(r[3] for r in own), max(r[5] for r in own), max(r[6] for r in own), len(own), text))
        out.sort(key=lambda o: (o[0], o[1]))
        return [(rows[0][0], rows[0][1], k, o[1], o[0], o[2], o[3], o[4], o[5]) for k, o in enumerate(out)]

    solid = boxes.where("x2 > x1 and y2 > y1").select("doc_id", "page", "idx", "x1", "y1", "x2", "y2", "content")
    return fold_groups(solid, ["doc_id", "page"], ["idx"], fold, "doc_id long, page long, line long, x1 long, y1 long, x2 long, y2 long, n_blocks long, text string")


def nested(a: str, b: str, tolerance: int = 2) -> Column:
    """Whether box a lies in box b, give or take, without being it."""
    c = lambda t, n: F.col(f"{t}.{n}")
    inside = (c(a, "x1") >= c(b, "x1") - tolerance) & (c(a, "y1") >= c(b, "y1") - tolerance) & (c(a, "x2") <= c(b, "x2") + tolerance) & (c(a, "y2") <= c(b, "y2") + tolerance)
    return inside & ((c(a, "x1") != c(b, "x1")) | (c(a, "y1") != c(b, "y1")) | (c(a, "x2") != c(b, "x2")) | (c(a, "y2") != c(b, "y2")))


def pair_counts(boxes: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """keys, heavy, nested: pairs of a page's boxes whose IoU is above .5, and that lie in one another. Only pairs that meet or nearly do are made."""
    a, b = boxes.alias("a"), boxes.alias("b")
    near = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.idx") < F.col("b.idx")]
    near += [F.col(f"{p}.{c}1") <= F.col(f"{q}.{c}2") + 2 for c in "xy" for p, q in (("a", "b"), ("b", "a"))]
    both = a.join(b, near)
    return both.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.count_if(overlap() / (area("a") + area("b") - overlap()) > 0.5).alias("heavy"), F.count_if(nested("a", "b") | nested("b", "a")).alias("nested"))


def layout_metrics(boxes: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """For each page of `boxes` (keys, idx, x1, y1, x2, y2, content): shares of empty blocks, of their area, of heavy and nested pairs, the longest run of empty
    blocks in reading order, coverage, fragmentation, issues and the score from 0 to 1."""
    ordered = reading_order(boxes, keys).withColumn("empty", F.trim(F.coalesce("content", F.lit(""))) == "")
    by = Window.partitionBy(*keys).orderBy("place")
    runs = ordered.withColumn("run", F.sum((~F.col("empty")).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    longest = runs.groupBy(*keys, "run").agg(F.count_if("empty").alias("n")).groupBy(*keys).agg(F.max("n").alias("longest"))
    own = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    page = ordered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_if("empty").alias("n_empty"), F.sum(own).alias("covered"), F.sum(F.when(F.col("empty"), own).otherwise(0)).alias("empty_area"),
        F.greatest(F.lit(1), (F.max("x2") - F.min("x1")) * (F.max("y2") - F.min("y1"))).alias("whole"),
    )
    all_ = page.join(longest, list(keys)).join(pair_counts(boxes.where("x2 > x1 and y2 > y1"), keys), list(keys), "left")
    n, pairs = F.col("n_blocks"), F.col("n_blocks") * (F.col("n_blocks") - 1) / 2
    rate = lambda c: F.when(pairs > 0, F.coalesce(c, F.lit(0)) / pairs).otherwise(0.0)
    all_ = all_.select(*keys, n, "longest", (F.col("n_empty") / n).alias("empty"), (F.col("empty_area") / F.col("whole")).alias("empty_area"), rate("heavy").alias("heavy"), rate("nested").alias("nested"), F.least(F.lit(1.0), F.col("covered") / F.col("whole")).alias("coverage"))
    all_ = all_.withColumn("fragments", n / F.greatest(F.lit(1.0), F.col("coverage") * 100))
    issue = {
        "high_empty_block_ratio": F.col("empty") > 0.25, "consecutive_empty_blocks": F.col("longest") >= 3, "high_empty_block_area_ratio": F.col("empty_area") > 0.2, "heavy_bbox_overlap": F.col("heavy") > 0.1,
        "nested_bbox_anomaly": F.col("nested") > 0.08, "low_layout_coverage": F.col("coverage") < 0.15, "high_layout_coverage": F.col("coverage") > 0.95, "layout_fragmentation": F.col("fragments") > 1.2,
    }
    held = lambda most, c: F.least(F.lit(most), c)
    penalty = held(0.25, F.col("empty") * 0.6) + held(0.18, F.col("empty_area") * 0.6) + held(0.15, F.col("longest") * 0.05) + held(0.16, F.col("heavy") * 0.8) + held(0.12, F.col("nested") * 1.2)
    penalty = penalty + F.when((F.col("coverage") < 0.15) | (F.col("coverage") > 0.95), 0.12).otherwise(0.0) + held(0.16, F.greatest(F.lit(0.0), F.col("fragments") - 0.6) * 0.25)
    return all_.select(
        *keys, n, "longest", *[F.round(c, 4).alias(c) for c in ("empty", "empty_area", "heavy", "nested", "coverage", "fragments")],
        F.array_sort(F.array_compact(F.array(*[F.when(c, name) for name, c in issue.items()]))).alias("issues"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - penalty)), 4).alias("layout_score"),
    )


def column_risk(lines: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """keys, switches, balance, beside, risk of `lines` (keys, line, x1, y1, x2, y2): whether reading jumps between two columns. Pages of under six lines, or whose lines don't
    spread to both sides, have no risk."""
    page, by = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("line")
    middle = (F.col("x1") + F.col("x2")) / 2
    rows = lines.withColumn("middle", middle).withColumn("left", F.col("middle") < F.percentile("middle", F.lit(0.5)).over(page))
    rows = rows.withColumns({"height": F.percentile(F.col("y2") - F.col("y1"), F.lit(0.5)).over(page), "turned": F.col("left") != F.lag("left").over(by), "gap": F.abs(F.col("y1") - F.lag("y2").over(by))})
    n = F.count(F.lit(1))
    got = rows.groupBy(*keys).agg(
        n.alias("n"), (F.least(F.count_if("left"), F.count_if(~F.col("left"))) / n).alias("balance"), ((F.max("middle") - F.min("middle")) / F.greatest(F.lit(1.0), F.max("x2") - F.min("x1"))).alias("spread"),
        F.count_if("turned").alias("turns"), F.count_if(F.col("turned") & (F.col("gap") <= 0.8 * F.col("height"))).alias("close"),
    )
    two = (F.col("n") >= 6) & (F.col("balance") >= 0.2) & (F.col("spread") >= 0.35)
    switches = F.when(two, F.col("turns") / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(0.0)
    beside = F.when(two & (F.col("turns") > 0), F.col("close") / F.col("turns")).otherwise(0.0)
    return got.select(*keys, F.round(switches, 4).alias("switches"), F.round(F.when(F.col("n") >= 6, F.col("balance")).otherwise(0.0), 4).alias("balance"), F.round(beside, 4).alias("beside"), ((switches > 0.45) & (beside > 0.35)).alias("risk"))


def final_scores(pages: DataFrame) -> DataFrame:
    """`pages` (quality, structure, layout) with `final`: half quality, a fifth structure, the rest layout, rounded half up."""
    return pages.withColumn("final", F.round(0.5 * F.col("quality") + 0.2 * F.col("structure") + 0.3 * F.col("layout") + 1e-9, 4))


def better_attempt(attempts: DataFrame, keys: tuple[str, ...] = PAGE, least: float = 0.6) -> DataFrame:
    """Of each page's attempts (keys, attempt, score) the first if its score is `least` or more, else the best; ties go to the later."""
    first = F.min_by("score", "attempt").over(Window.partitionBy(*keys))
    by = Window.partitionBy(*keys).orderBy(F.when(F.col("enough"), -F.col("attempt")).otherwise(F.col("score")).desc(), F.col("attempt").desc())
    return attempts.withColumn("enough", first >= least).withColumn("n", F.row_number().over(by)).where("n = 1").drop("n", "enough")


def merge_boxes(boxes: DataFrame, mode: str = "large", keep: tuple[str, ...] = ("image", "seal", "chart"), label: str | None = None, share: float = 0.8, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Boxes of a page after those are dropped that lie in another (`share` of their area): large drops the inner, small drops those that hold another unless they lie in one
    themselves, union drops none. Boxes of the labels in `keep` are never inner. label: only boxes of that label count as outer (large) or inner (small)."""
    if mode == "union":
        return boxes
    if mode not in ("large", "small"):
        raise ValueError(f"no such mode: {mode}")
    a, b = boxes.alias("a"), boxes.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.idx") != F.col("b.idx"), ~F.col("a.label").isin(list(keep)), area("a") > 0, overlap() >= share * area("a")]
    if label is not None:
        on.append(F.col("b.label" if mode == "large" else "a.label") == label)
    pairs = a.join(b, on).select(*[F.col(f"a.{k}") for k in keys], F.col("a.idx").alias("inner"), F.col("b.idx").alias("outer"))
    inner, outer = (pairs.select(*keys, F.col(c).alias("idx")).distinct() for c in ("inner", "outer"))
    if mode == "large":
        return boxes.join(inner, [*keys, "idx"], "left_anti")
    return boxes.join(outer.join(inner, [*keys, "idx"], "left_anti"), [*keys, "idx"], "left_anti")


def without_oversize(boxes: DataFrame, width: int, height: int, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Boxes without images that fill the page, where a page has other boxes: over .82 of a landscape page, .93 of another."""
    side = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(most))
    own = (side("x2", width) - side("x1", width)) * (side("y2", height) - side("y1", height))
    large = (F.col("label") == "image") & (own > (0.82 if width > height else 0.93) * width * height)
    page = Window.partitionBy(*keys)
    marked = boxes.withColumn("large", large)
    marked = marked.withColumn("alone", F.min(F.col("large").cast("int")).over(page) == 1)
    return marked.where(~F.col("large") | F.col("alone")).drop("large", "alone")


def unclipped(boxes: DataFrame, across: float, down: float, width: int, height: int, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Boxes scaled about their middle, held within the page, without those that have no area left, with `place` in reading order."""
    half = lambda c, ratio: (F.col(f"{c}2") - F.col(f"{c}1")) * ratio / 2
    middle = lambda c: (F.col(f"{c}1") + F.col(f"{c}2")) / 2
    held = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(most)))
    sides = {f"{c}{k}": held(middle(c) + sign * half(c, ratio), most) for c, ratio, most in (("x", across, width), ("y", down, height)) for k, sign in ((1, -1), (2, 1))}
    return reading_order(boxes.select(*[c for c in boxes.columns if c not in sides], *[v.alias(k) for k, v in sides.items()]), keys)


def plausible(word: str) -> bool:
    """Whether a word put together from two lines may be one."""
    import re

    low = word.strip().lower()
    return bool(re.fullmatch(r"[a-z][a-z'\-]{2,30}", low)) and "--" not in low and "''" not in low


def join_hyphens(blocks: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """Blocks (idx, label, content) of a page in order: a text that ends in a hyphen takes in the next text, wherever it stands, if that begins in lower case and
    gives a plausible word. What was taken in begins no merge itself."""
    out, gone = [], set()
    for k, (idx, label, content) in enumerate(blocks):
        if k in gone:
            continue
        own = (content or "").rstrip()
        if label == "text" and own.endswith("-"):
            after = next((j for j in range(k + 1, len(blocks)) if blocks[j][1] == "text"), None)
            following = (blocks[after][2] or "").lstrip() if after is not None else ""
            if following[:1].islower() and own[:-1].split() and plausible(own[:-1].split()[-1] + following.split()[0]):
                gone.add(after)
                content = own[:-1] + following
        out.append((idx, label, content))
    return out


def tag_formulas(blocks: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """Blocks of a page in order: a formula's number, before or after it, becomes its tag; numbers without a formula go."""
    out, k = [], 0
    tagged = lambda f, number: f[:-3] + f" \\tag{{{number}}}\n$$" if f.endswith("\n$$") else f

    def bare(number: str) -> str:
        number = (number or "").strip()
        return number[1:-1] if number[:1] + number[-1:] in ("()", "（）") and len(number) > 1 else number

    while k < len(blocks):
        idx, label, content = blocks[k]
        after = blocks[k + 1] if k + 1 < len(blocks) else (None, "", "")
        if label == "formula_number":
            if after[1] == "formula":
                out.append((after[0], "formula", tagged(after[2], bare(content))))
                k += 1
        elif label == "formula" and after[1] == "formula_number":
            out.append((idx, label, tagged(content, bare(after[2]))))
            k += 1
        else:
            out.append(blocks[k])
        k += 1
    return out


def fill_bullets(blocks: list[tuple[int, str, str, float]], near: float = 10.0) -> list[tuple[int, str, str, float]]:
    """Blocks (idx, label, content, left) of a page in order: a text between two bullets that begins where they do is one. What was filled counts for the next."""
    out = list(blocks)
    for k in range(1, len(out) - 1):
        (_, a, before, left_a), (idx, b, own, left), (_, c, after, left_c) = out[k - 1 : k + 2]
        if a == b == c == "text" and before.startswith("- ") and after.startswith("- ") and not own.startswith("- ") and abs(left - left_a) <= near and abs(left - left_c) <= near:
            out[k] = (idx, b, "- " + own, left)
    return out


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, page, idx (numbered anew from 0), was, label, content: pages (doc_id, page, idx, label, content, x1) after formulas are tagged, hyphens joined and bullets filled; blocks
    without content are dropped before they are numbered."""

    def fold(rows):
        doc, page = rows[0][:2]
        left = {r[2]: float(r[5] or 0) for r in rows}
        own = join_hyphens(tag_formulas([(r[2], r[3], r[4] or "") for r in rows]))
        own = fill_bullets([(i, label, t, left[i]) for i, label, t in own if t.strip()])
        return [(doc, page, k, i, label, t) for k, (i, label, t, _) in enumerate(own)]

    return fold_groups(blocks.select("doc_id", "page", "idx", "label", "content", F.col("x1").cast("double").alias("x1")), ["doc_id", "page"], ["idx"], fold, "doc_id long, page long, idx long, was long, label string, content string")
