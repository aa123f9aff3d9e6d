"""Routing of questions, and conversations as tables of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Substrings that mark a kind of question, tried in this order.
MARKERS = {
    "comparison_qa": ["compare", "comparison", "baseline", "better than", "versus", "vs", "different from", "区别", "对比", "比较", "优于"],
    "method_qa": ["method", "model", "approach", "architecture", "algorithm", "training", "experiment setup", "方法", "模型", "算法", "训练", "实验设置"],
    "dataset_qa": ["dataset", "benchmark", "corpus", "data set", "split", "metric", "evaluation set", "数据集", "基准", "语料", "指标"],
    "multi_evidence_qa": ["list", "which", "what are", "how many", "哪些", "多少", "列出"],
}
#: Which retrieval answers a kind of question.
ROUTES = {"fact_qa": "lad", "local_evidence_qa": "lad"}


def classify(question: Column, n_selected: Column | None = None) -> Column:
    """The kind of a question; one with selected evidence is local, one of ten words or fewer without a marker asks for a fact."""
    low = F.lower(F.coalesce(question, F.lit("")))
    out = F.when(n_selected > 0, "local_evidence_qa") if n_selected is not None else F.when(F.lit(False), "")
    for kind, marks in MARKERS.items():
        has = F.lit(False)
        for m in marks:
            has = has | low.contains(m)
        out = out.when(has, kind)
    return out.when(F.regexp_count(low, F.lit(r"[\p{L}\p{N}_]+")) <= 10, "fact_qa").otherwise("multi_evidence_qa")


#: How a model is asked for a kind of question: mode, temperature, top_p, max_tokens; any other kind is asked as balanced.
MODELS = {
    "fact_qa": ("fact_stable", 0.1, 0.8, 384), "local_evidence_qa": ("local_evidence_stable", 0.1, 0.8, 512), "multi_evidence_qa": ("multi_evidence_balanced", 0.2, 0.9, 900),
    "method_qa": ("method_detailed", 0.2, 0.9, 1100), "comparison_qa": ("comparison_structured", 0.25, 0.9, 1100), "dataset_qa": ("dataset_precise", 0.1, 0.85, 650),
}
BALANCED = ("balanced", 0.2, 0.9, 768)


def model_config(kind: Column) -> Column:
    """(mode, temperature, top_p, max_tokens)."""
    made = lambda c: F.struct(F.lit(c[0]).alias("mode"), F.lit(c[1]).alias("temperature"), F.lit(c[2]).alias("top_p"), F.lit(c[3]).alias("max_tokens"))
    out = F.when(F.lit(False), made(BALANCED))
    for k, c in MODELS.items():
        out = out.when(kind == k, made(c))
    return out.otherwise(made(BALANCED))


def prompts(questions: DataFrame, context: DataFrame, turns: DataFrame, overviews: DataFrame, last: int = 8, chars: int = 1200) -> DataFrame:
    """query_id, prompt, n_blocks: what a model is asked for each of `questions` (query_id, conv_id, doc_id, question): the overview of the document (doc_id, overview), the conversation's `last` turns
    (conv_id, turn, role, text) and the context's blocks (query_id, place, chunk_id, content), each at most `chars` characters."""
    near = recent(turns, last).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", F.coalesce("text", F.lit(""))).alias("line")))).alias("lines"))
    own = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("["), "chunk_id", F.lit("] "), F.substring("content", 1, chars)).alias("line")))).alias("blocks"))
    lines = lambda c: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<place:bigint,line:string>>" if c == "blocks" else "array<struct<turn:bigint,line:string>>")), lambda x: x["line"]), "\n")
    both = questions.join(near, "conv_id", "left").join(own, "query_id", "left").join(overviews, "doc_id", "left")
    parts = [("overview", F.coalesce("overview", F.lit(""))), ("history", lines("lines")), ("chunks", lines("blocks")), ("question", F.col("question"))]
    return both.select("query_id", F.concat_ws("\n\n", *[F.concat(F.lit(f"{k}:\n"), v) for k, v in parts]).alias("prompt"), F.coalesce(F.size("blocks"), F.lit(0)).cast("long").alias("n_blocks"))


def with_turns(turns: DataFrame, more: DataFrame) -> DataFrame:
    """`turns` with the rows of `more` (conv_id, role, text, order) after each conversation's last."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("order"))
    new = more.withColumn("place", place).join(last, "conv_id", "left").select("conv_id", (F.coalesce("last", F.lit(-1)) + F.col("place")).cast("long").alias("turn"), "role", "text")
    return turns.select("conv_id", "turn", "role", "text").unionByName(new)


def session_list(turns: DataFrame, compactions: DataFrame, documents: DataFrame) -> DataFrame:
    """conv_id, doc_id, title, n_turns, last_turn, compacted: sessions of `documents` (conv_id, doc_id), with the turns that a compaction (conv_id, n_turns) covers, 0 without one."""
    done = compactions.groupBy("conv_id").agg(F.max("n_turns").alias("compacted"))
    return titles(turns).join(documents, "conv_id").join(done, "conv_id", "left").select("conv_id", "doc_id", "title", "n_turns", "last_turn", F.coalesce("compacted", F.lit(0)).cast("long").alias("compacted"))


def route(kind: Column, override: Column | None = None) -> Column:
    """Which retrieval answers a kind of question; an override of lad or rag stands."""
    out = F.when(override.isin("lad", "rag"), override) if override is not None else F.when(F.lit(False), "")
    for k, r in ROUTES.items():
        out = out.when(kind == k, r)
    return out.otherwise("rag")


def recent(turns: DataFrame, n: int = 4) -> DataFrame:
    """The last n turns of each conversation."""
    return turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc())).cast("long")).where(F.col("back") <= n)


def titles(turns: DataFrame, most: int = 28) -> DataFrame:
    """conv_id, title (the first question's first characters), n_turns, last_turn."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(F.substring(F.coalesce(first, F.lit("")), 1, most).alias("title"), F.count(F.lit(1)).alias("n_turns"), F.max("turn").alias("last_turn"))


def to_compact(turns: DataFrame, least: int = 8, chars: int = 12000, most: int = 10, done: DataFrame | None = None) -> DataFrame:
    """conv_id, n_turns, n_chars of conversations of at least `least` turns that are long or have `most` turns, but for those of `done` (conv_id, n_turns)."""
    total = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("n_chars"))
    due = total.where((F.col("n_turns") >= least) & ((F.col("n_chars") >= chars) | (F.col("n_turns") >= most)))
    return due if done is None else due.join(done, ["conv_id", "n_turns"], "left_anti")
