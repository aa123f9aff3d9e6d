"""Headings, sections and the document graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators.folds import fold_groups

# What a heading looks like.
MARKDOWN = r"^\s{0,3}(#{1,6})\s+(\S.*?)\s*$"
DECIMAL = r"^\s*([0-9]+(?:\.[0-9]+){0,6})([.)])?\s+(\S.{0,120})$"
COMPACT = r"^\s*([0-9]+\.[0-9]+(?:\.[0-9]+){0,5})([.)])?(\S.{0,120})$"
CHAPTER_ZH = r"^\s*第[一-鿿0-9]+[章节篇]\s*\S.{0,120}$"
CHAPTER = r"(?i)^\s*(chapter|section|part)\s+[a-z0-9]+[.:\-\s]+.{1,120}$"
APPENDIX = r"(?i)^\s*(appendix|附录)\s*[a-z0-9一-鿿]*[.:\-\s]+.{0,120}$"
COMMON = r"(?i)^\s*(abstract|introduction|background|methodology|method|methods|experiment|experiments|result|results|discussion|conclusion|references|acknowledgements?)\s*$"
ENUMERATION = r"^\s*[(（]\s*(?:[0-9]{1,3}|[A-Za-z]|[一-鿿]{1,3})\s*[)）]\s*\S.{0,120}$"
TRAILING = r"^\s*(?:[0-9]{1,3}|[A-Za-z]|[一-鿿]{1,3})[)）]\s*\S.{0,120}$"
SCENE = r"(?i)^\s*(?:场景|案例|示例|步骤|阶段|任务|scenario|case|example|step|stage|task)\s*[一-鿿0-9a-z]*[:：.\-\s]\s*\S.{0,120}$"

#: What a line begins with that one of these, or MARKDOWN, may match, if no tag stands before it.
BEGINS = r"^\s*(?:[#0-9(（第]|(?:[A-Za-z]|[一-鿿]{1,3})[)）]|(?i:chapter|section|part|appendix|附录|abstract|introduction|background|method|experiment|result|discussion|conclusion|references|acknowledgement|场景|案例|示例|步骤|阶段|任务|scenario|case|example|step|stage|task))"


# What speaks for a heading or against it, and how much of it is enough.
KIND_POINTS = {"numbered_body": -0.2, "attached": 0.56, "decimal": 0.78, "chapter": 0.78, "common": 0.62}
POINTS = {"marked": 0.72, "titled": 0.35, "short": 0.12, "long": -0.25, "few_lines": 0.06, "centred": 0.06, "language": 0.03}
SHORT_CHARS, LEAST_CONFIDENCE = 140, 0.52


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, whose columns the optimizer takes as they are: a filter on them isn't rewritten into all that they were computed from."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("r")).select("r.*")


def may_be_heading(content: Column) -> Column:
    """Whether a line may be a heading to headings() that has neither a label nor a place of its own; most others are told by how they begin."""
    return F.contains(content, F.lit("<")) | content.rlike(BEGINS)


def marked_lines(blocks: DataFrame, *more: str) -> DataFrame:
    """doc_id, pos, content, is_heading, level, text (of headings, else empty) and `more` of `blocks`, as headings() says without a label: patterns are only matched where may_be_heading."""
    some = F.when(may_be_heading(F.col("content")), F.col("content")).otherwise("")
    return headings(blocks.withColumn("whole", F.col("content")).withColumn("content", some), more=("whole", *more)).select("doc_id", "pos", F.col("whole").alias("content"), "is_heading", "level", "text", *more)


def headings(blocks: DataFrame, label: Column | None = None, profile: Column | None = None, centered: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """`blocks` (doc_id, pos, page, idx, content, and `more`) with is_heading, level, text, confidence, role and pattern of each.

    label: the block's kind, by default text; profile: en, zh or mixed, by default en. Level -1 means attached to the heading before. Each step is
    a projection of its own, so that no pattern is matched twice.
    """
    label, profile = F.lit("text") if label is None else label, F.lit("en") if profile is None else profile
    keep = ["doc_id", "pos", "page", "idx", "content", *more]
    centre = F.lit(False) if centered is None else F.coalesce(centered, F.lit(False))
    rows = blocks.select(*keep, F.lower(F.trim(label)).isin("title", "doc_title", "paragraph_title").alias("titled"), profile.alias("profile"), centre.alias("centred"), X.without_tags(F.col("content")).alias("clean"))
    rows = rows.withColumn("marks", F.regexp_extract("clean", MARKDOWN, 1))
    rows = rows.withColumn("text", X.strip(F.regexp_replace(F.when(F.col("marks") != "", F.regexp_extract("clean", MARKDOWN, 2)).otherwise(F.col("clean")), r"\s+", " "))).drop("clean")
    rows = rows.withColumns({"usual": F.regexp_extract("text", DECIMAL, 1), "compact": F.regexp_extract("text", COMPACT, 1)})
    either = lambda k: F.when(F.col("usual") != "", F.regexp_extract("text", DECIMAL, k)).otherwise(F.regexp_extract("text", COMPACT, k))
    rows = rows.withColumns({"number": either(1), "mark": either(2), "tail": either(3)}).drop("usual", "compact")
    rows = settled(rows)
    text, number, marks, kind = F.col("text"), F.col("number"), F.col("marks"), F.col("kind")
    plain = ~number.contains(".")
    body = plain & (F.col("mark") != ")") & ((F.length(text) > 72) | (F.length("tail") > 64) | F.col("tail").rlike("[。！？!?；;]"))
    chapter = text.rlike(CHAPTER_ZH) | text.rlike(CHAPTER) | text.rlike(APPENDIX)
    attached = text.rlike(ENUMERATION) | text.rlike(TRAILING) | text.rlike(SCENE)
    rows = rows.withColumn(
        "kind",
        F.when((number != "") & body, "numbered_body").when((number != "") & plain, "attached").when(number != "", "decimal")
        .when(chapter, "chapter").when(text.rlike(COMMON), "common").when(attached, "attached").when(marks != "", "markdown").otherwise("none"),
    )
    level = (
        F.when(kind == "numbered_body", F.lit(None).cast("int")).when(kind == "attached", -1).when(kind == "decimal", F.least(F.regexp_count(number, F.lit(r"\.")) + 1, F.lit(6)))
        .when(kind.isin("chapter", "common"), 1).when(marks != "", F.length(marks))
    )
    points = F.lit(0.0)
    for name, value in KIND_POINTS.items():
        points = F.when(kind == name, value).otherwise(points)
    given = lambda when, name, other=0.0: F.when(when, POINTS[name]).otherwise(other)
    score = given(marks != "", "marked") + points + given(F.col("titled"), "titled") + given(F.length(text) <= SHORT_CHARS, "short", POINTS["long"]) + POINTS["few_lines"] + given(F.col("centred"), "centred")
    score = score + given(F.col("profile").isin("zh", "mixed") & text.rlike("[一-鿿]"), "language") + given(F.col("profile").isin("en", "mixed") & text.rlike("[A-Za-z]"), "language")
    rows = rows.withColumns({"found": F.when(F.col("titled"), F.coalesce(level, F.lit(1))).otherwise(level), "confidence": F.when(text == "", 0.0).otherwise(F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6))})
    rows = settled(rows)
    rows = rows.withColumn("is_heading", (text != "") & (F.col("confidence") >= LEAST_CONFIDENCE) & F.col("found").isNotNull())
    yes = F.col("is_heading")
    return rows.select(
        *keep,
        "is_heading",
        F.when(yes, F.col("found")).cast("int").alias("level"),
        F.when(yes, text).otherwise("").alias("text"),
        "confidence",
        F.when(yes & (F.col("found") < 0), "attached_subheading").when(yes, "formal_section").otherwise("text").alias("role"),
        F.when(text == "", "empty").when(F.col("titled") & (kind == "none"), "source_label").otherwise(kind).alias("pattern"),
    )


def fill_sections(marked: DataFrame, *more: Column) -> DataFrame:
    """doc_id, pos, section_pos: the position of the last heading at or before each block; null before the first. more: further columns of `marked`."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("doc_id", "pos", "page", "idx", "content", "is_heading", F.last(F.when(F.col("is_heading"), F.col("pos")), ignorenulls=True).over(w).alias("section_pos"), *more)


def fold_levels(levels: list[int]) -> list[tuple[int, int | None]]:
    """(level, index of the parent) of headings in order. A level L closes all at L or deeper. -1, an attached heading, closes attached ones
    that end the stack and takes the level below what is left, 6 at most."""
    open_at: list[tuple[int, int, bool]] = []  # level, index, attached
    out = []
    for k, level in enumerate(levels):
        if level < 0:
            while open_at and open_at[-1][2]:
                open_at.pop()
            own = min((open_at[-1][0] if open_at else 0) + 1, 6)
        else:
            while open_at and open_at[-1][0] >= level:
                open_at.pop()
            own = level
        out.append((own, open_at[-1][1] if open_at else None))
        open_at.append((own, k, level < 0))
    return out


def section_tree(marked: DataFrame) -> DataFrame:
    """doc_id, pos, level, parent_pos, depth, path (titles from the top) of each heading: a fold over one document's headings at a time."""

    def fold(rows):
        found, depth, paths, out = fold_levels([r[2] for r in rows]), [], [], []
        for (level, parent), r in zip(found, rows):
            depth.append(1 if parent is None else depth[parent] + 1)
            paths.append([r[3]] if parent is None else [*paths[parent], r[3]])
            out.append((r[0], r[1], level, None if parent is None else rows[parent][1], depth[-1], paths[-1]))
        return out

    return fold_groups(marked.where("is_heading").select("doc_id", "pos", "level", "text"), ["doc_id"], ["pos"], fold, "doc_id long, pos long, level int, parent_pos long, depth int, path array<string>")


def document_graph(marked: DataFrame, tree: DataFrame) -> DataFrame:
    """`contains` edges (src, tgt): document or parent section to section, section or document to each block that isn't a heading."""
    doc = F.concat(F.lit("doc_"), F.col("doc_id"))
    section = lambda c: F.concat(F.lit("sec_"), F.col("doc_id"), F.lit("_"), F.col(c))
    up = tree.select(F.coalesce(section("parent_pos"), doc).alias("src"), section("pos").alias("tgt"))
    down = fill_sections(marked).where("not is_heading").select(F.coalesce(section("section_pos"), doc).alias("src"), F.concat(F.lit("blk_"), F.col("doc_id"), F.lit("_"), F.col("pos")).alias("tgt"))
    return up.unionByName(down).withColumn("relation", F.lit("contains"))


def line_features(text: Column, x1: Column, x2: Column) -> Column:
    """(n_lines, n_chars, is_short, is_centered) of a block's text and the left and right of its box, as shares of the page."""
    lines = F.size(F.filter(F.split(text, r"\r\n|\r|\n"), lambda t: X.strip(t) != ""))
    middle = F.when(x2 != 0, (x1 + x2) / 2).otherwise(0.0)
    return F.struct(
        lines.cast("long").alias("n_lines"), F.length(text).cast("long").alias("n_chars"), ((F.length(text) <= 140) & (lines <= 2)).alias("is_short"),
        (middle.between(0.35, 0.65) & (F.greatest(F.lit(0.0), x2 - x1) <= 0.78)).alias("is_centered"),
    )


def strict_headings(blocks: DataFrame, kind: Column, least: float = 0.68, most: int = 80) -> tuple[DataFrame, DataFrame]:
    """headings of each block's first line, none of tables, images, formulas, captions and code, and the `most` headings of each document that are under `least` sure, in order."""
    first = blocks.withColumn("content", F.split(X.strip(F.coalesce("content", F.lit(""))), "\n")[0])
    found = headings(first.withColumn("content", F.when(kind.isin("table", "image", "formula", "caption", "code"), "").otherwise(F.col("content"))))
    doubtful = found.where(F.col("is_heading") & (F.col("confidence") < least)).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long"))
    return found, doubtful.where(F.col("place") <= most)


def structure_rollup(marked: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_blocks, n_sections, roles (headings by role)."""
    n = lambda role: F.count_if(F.col("role") == role)
    return marked.groupBy("doc_id").agg(
        F.count_distinct("page").alias("n_pages"), F.count(F.lit(1)).alias("n_blocks"), F.count_if("is_heading").alias("n_sections"),
        F.create_map(F.lit("formal_section"), n("formal_section"), F.lit("attached_subheading"), n("attached_subheading")).alias("roles"),
    )


def named_sections(chunks: DataFrame) -> DataFrame:
    """doc_id, section_id, name, title, level, path: sections of `chunks` (doc_id, pos, section_name) by name, whose parts are divided by :::, in the order in which they begin."""
    name = X.strip(F.coalesce("section_name", F.lit("Document")))
    first = chunks.select("doc_id", "pos", F.when(name == "", "Document").otherwise(name).alias("name")).groupBy("doc_id", "name").agg(F.min("pos").alias("first"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "name")) - 1
    parts = F.filter(F.transform(F.split("name", ":::"), X.strip), lambda p: p != "")
    path = F.when(F.size(parts) > 0, parts).otherwise(F.array("name"))
    return first.select("doc_id", F.concat(F.lit("sec_"), F.lpad(number.cast("string"), 4, "0")).alias("section_id"), "name", F.element_at(path, -1).alias("title"), F.greatest(F.lit(1), F.least(F.size(parts), F.lit(6))).alias("level"), path.alias("path"))
