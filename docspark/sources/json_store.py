"""JSON documents as tables: schema on read with defaults, whole-file JSON and Parquet out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A parsed page block as it is stored; a page holds its blocks.
BLOCK = "struct<chunkId:string,pageNo:int,index:int,label:string,content:string,normalizedContent:string,bboxNorm:struct<x1:double,y1:double,x2:double,y2:double>>"
CHUNKS = f"docId string, docName string, pageCount int, pages array<struct<pageNo:int,chunks:array<{BLOCK}>>>"
#: Papers with parallel arrays of sections, paragraphs and questions.
PAPERS = "id string, title string, abstract string, full_text struct<section_name:array<string>,paragraphs:array<array<string>>>, qas struct<question:array<string>,question_id:array<string>>"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each file; a file that doesn't parse has nulls in all columns but `path`. Fields beginning with an underscore are left out by the schema."""
    return spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("path", F.input_file_name()).drop("_corrupt")


def blocks_of(documents: DataFrame) -> DataFrame:
    """doc_id, page, idx, label, content and the box of each block of stored documents; blocks without an id are dropped, missing fields have defaults."""
    page = documents.select(F.col("docId").alias("doc_id"), F.explode("pages").alias("p")).select("doc_id", F.col("p.pageNo").alias("page"), F.posexplode("p.chunks").alias("k", "c"))
    return page.where("coalesce(trim(c.chunkId), '') != ''").select(
        "doc_id", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("c.index", "k").alias("idx"), F.col("c.chunkId").alias("chunk_id"), F.coalesce("c.label", F.lit("text")).alias("label"),
        F.coalesce("c.normalizedContent", "c.content", F.lit("")).alias("content"), F.length(F.coalesce("c.normalizedContent", "c.content", F.lit(""))).alias("n_chars"), F.col("c.bboxNorm").alias("box"),
    )


def prefer_structured(plain: DataFrame, structured: DataFrame) -> DataFrame:
    """Blocks of each document from `structured` if its status there is ready, else from `plain`; both have doc_id, structured also status."""
    ready = structured.where("status = 'ready'").drop("status")
    return ready.unionByName(plain.join(ready.select("doc_id").distinct(), "doc_id", "left_anti"), allowMissingColumns=True)


def paragraphs_of(papers: DataFrame) -> DataFrame:
    """paper_id, section, paragraph, chunk_id, section_name, text; empty paragraphs are left out, ragged arrays padded with nulls."""
    zipped = F.arrays_zip(F.col("full_text.section_name").alias("section_name"), F.col("full_text.paragraphs").alias("paragraphs"))
    section = papers.select(F.col("id").alias("paper_id"), F.posexplode(zipped).alias("section", "s")).select("paper_id", "section", "s.section_name", F.posexplode("s.paragraphs").alias("paragraph", "text"))
    name = F.concat(F.lit("s"), F.lpad(F.col("section").cast("string"), 3, "0"), F.lit("_p"), F.lpad(F.col("paragraph").cast("string"), 3, "0"))
    return section.where("trim(text) != ''").withColumn("chunk_id", name)


def write_json(df: DataFrame, path: str) -> None:
    df.select(*[c for c in df.columns if not c.startswith("_")]).write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


META = "id string, name string, summary string, createdAt string"


def read_projects(spark: SparkSession, root: str) -> DataFrame:
    """id, name, summary, created_at of each folder of `root` that has a meta.json that parses; id and name default to the folder's. Sort by id for a listing."""
    found = read_documents(spark, f"{root}/*/meta.json", META)
    folder = F.element_at(F.split("path", "/"), -2)
    return found.where("id is not null or name is not null or summary is not null or createdAt is not null").select(
        F.coalesce("id", folder).alias("id"), F.coalesce("name", folder).alias("name"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("createdAt", F.lit("")).alias("created_at")
    )


def read_collection(spark: SparkSession, plain: str, structured: str) -> DataFrame:
    """Blocks (blocks_of) of the chunk files that match two patterns, whose folders are documents; folders beginning with an underscore are left out, structured files stand for
    plain ones of the same document where their status is ready. blocks.pack_blocks takes the result with pos counted over the document."""
    own = lambda df: blocks_of(df.where(~F.element_at(F.split("path", "/"), -2).startswith("_")))
    made = read_documents(spark, structured, CHUNKS + ", status string")
    status = made.select(F.col("docId").alias("doc_id"), "status")
    both = prefer_structured(own(read_documents(spark, plain, CHUNKS)), own(made).join(status, "doc_id"))
    by = Window.partitionBy("doc_id").orderBy("page", "idx")
    return both.withColumn("pos", F.row_number().over(by).cast("long") - 1)


def read_pages(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, page (from 0, by name, in its folder), content (bytes) and n_bytes of image files; the first `most` of each folder if given, as a page limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    numbered = files.select("path", F.col("length").alias("n_bytes"), "content", F.row_number().over(Window.partitionBy(folder).orderBy("path")).cast("long").alias("n"))
    kept = numbered if most is None else numbered.where(F.col("n") <= most)
    return kept.select("path", (F.col("n") - 1).alias("page"), "n_bytes", "content")


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str = PAPERS) -> DataFrame:
    """Papers of several splits, JSON or Parquet by the end of each path, with the name of the split."""
    out = None
    for split, path in paths.items():
        rows = (spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else spark.read.schema(schema).option("multiLine", True).json(path)).withColumn("split", F.lit(split))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no split is named")
    return out


#: Questions of a paper, with their answers, as parallel arrays.
ANSWER = "struct<unanswerable:boolean,extractive_spans:array<string>,yes_no:boolean,free_form_answer:string,evidence:array<string>,highlighted_evidence:array<string>>"
QUESTIONS = f"id string, qas struct<question:array<string>,question_id:array<string>,answers:array<struct<answer:array<{ANSWER}>>>>"


def questions_of(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """paper_id, question_id, question, gold (answers), answerable, evidence (ids of the chunks that hold any evidence, in order) of each question; ragged arrays are padded.

    Gold is the free answers, or the question without any; a question is answerable unless all its answers say it isn't. chunks: paragraphs_of.
    """
    zipped = F.arrays_zip(F.col("qas.question").alias("question"), F.col("qas.question_id").alias("question_id"), F.col("qas.answers").alias("answers"))
    each = papers.select(F.col("id").alias("paper_id"), F.posexplode(zipped).alias("n", "q"))
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    none = F.array().cast(f"array<{ANSWER}>")
    answers = F.filter(F.coalesce("q.answers.answer", none), lambda a: a.isNotNull())
    solid = lambda texts: F.filter(F.transform(texts, clean), lambda t: t != "")
    texts = F.flatten(F.transform(answers, lambda a: F.concat(F.coalesce(a["evidence"], F.array().cast("array<string>")), F.coalesce(a["highlighted_evidence"], F.array().cast("array<string>")))))
    free = solid(F.transform(answers, lambda a: a["free_form_answer"]))
    name = F.coalesce("q.question_id", F.concat(F.lit("q"), F.lpad(F.col("n").cast("string"), 4, "0")))
    made = each.select(
        "paper_id", name.alias("question_id"), clean(F.col("q.question")).alias("question"), F.when(F.size(free) > 0, free).otherwise(F.array(clean(F.col("q.question")))).alias("gold"),
        ((F.size(answers) == 0) | F.exists(answers, lambda a: ~F.coalesce(a["unanswerable"], F.lit(False)))).alias("answerable"), F.array_distinct(solid(texts)).alias("texts"),
    )
    own = chunks.select("paper_id", "chunk_id", clean(F.col("text")).alias("text"))
    held = made.select("paper_id", "question_id", F.explode("texts").alias("t")).join(own, "paper_id").where(F.contains("text", F.col("t")))
    found = held.groupBy("paper_id", "question_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("evidence"))
    return made.drop("texts").join(found, ["paper_id", "question_id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (item_id, v) as Parquet: exact search reads them as they are, so there is no index object."""
    vectors.select("item_id", "v").write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A table of results as JSON lines, and beside it as a Markdown table of its first 1,000 rows."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    cells = lambda values: "| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in values) + " |"
    shown = [cells(rows.columns), cells("---" for _ in rows.columns), *[cells(r) for r in rows.limit(1000).collect()]]
    rows.sparkSession.createDataFrame([(k, t) for k, t in enumerate(shown)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(f"{path}/report")


def stored_name(name: Column, uid: Column) -> Column:
    """The name under which an uploaded file is kept."""
    return F.concat(uid, F.lit("_"), F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)[^\w.\-]", "_"))
