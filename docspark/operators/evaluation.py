"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as X


def retrieval_metrics(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """For each query of `gold` (query_id, item_id): how many of its items are among `hits` (query_id, item_id, rank), recall, precision at k,
    reciprocal rank of the first."""
    both = gold.join(hits.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left").groupBy("query_id")
    out = both.agg(F.count("rank").alias("hits"), F.count(F.lit(1)).alias("n_gold"), F.min("rank").alias("first"))
    return out.select(
        "query_id", "hits", "n_gold", F.round(F.col("hits") / F.col("n_gold"), 6).alias("recall"), F.round(F.col("hits") / k, 6).alias("precision_10"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank")
    )


def grid(hits: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Mean recall and reciprocal rank for each k and, with k null, over all: one job for the whole grid."""
    both = gold.join(hits.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    within = F.col("rank") <= F.col("k")
    each = both.groupBy("k", "query_id").agg((F.count(F.when(within, 1)) / F.count(F.lit(1))).alias("recall"), F.max(F.when(within, 1 / F.col("rank")).otherwise(0.0)).alias("rr"))
    return each.rollup("k").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))


def answer_scores(answer: Column, gold: Column) -> Column:
    """(exact_match, token_recall, keyword_recall): keywords are the gold answer's first eight tokens of two characters or more."""
    a, g = F.array_distinct(X.answer_tokens(answer)), F.array_distinct(X.answer_tokens(gold))
    bare_a, bare_g = X.bare(answer), X.bare(gold)
    keys = F.slice(F.filter(X.answer_tokens(gold), lambda t: F.length(t) >= 2), 1, 8)
    hits = F.size(F.filter(keys, lambda k: F.contains(bare_a, X.bare(k))))
    return F.struct(
        ((bare_a != "") & (bare_a == bare_g)).alias("exact_match"),
        F.round(F.when(F.size(g) > 0, F.size(F.array_intersect(a, g)) / F.size(g)).otherwise(0.0), 4).alias("token_recall"),
        F.round(F.when(F.size(keys) > 0, hits / F.size(keys)).otherwise(0.0), 4).alias("keyword_recall"),
    )


# What marks the category of a case, tried in this order; measures that a round of prompts is judged by.
CATEGORIES = {"comparison": ["compare", "difference", "better", "worse", "versus"], "method": ["how", "method", "approach", "procedure"], "result": ["result", "performance", "score", "metric"], "dataset": ["dataset", "data", "corpus"]}
MEASURES = ["correctness", "relevance", "evidence_support", "format_valid", "citation_valid", "refusal_ready", "retrieval_effect_score", "prompt_control_score", "overall"]


def category(question: Column, n_evidence: Column) -> Column:
    out = F.when(n_evidence > 1, "multi_evidence")
    for kind, marks in CATEGORIES.items():
        out = out.when(X.contains_any(F.lower(question), marks), kind)
    return out.otherwise("fact")


def cases(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, doc_id, category, difficulty, n_evidence, n_sections, gold: a case for each answerable question of `questions` (query_id, doc_id, question, gold, answerable, evidence: array of
    chunk ids) that has evidence and a gold answer. chunks: (doc_id, chunk_id, section)."""
    usable = questions.where(F.col("answerable") & (F.trim("question") != "") & (F.trim("gold") != "") & (F.size("evidence") > 0))
    sections = usable.select("query_id", "doc_id", F.explode("evidence").alias("chunk_id")).join(chunks, ["doc_id", "chunk_id"]).groupBy("query_id").agg(F.count_distinct("section").alias("n_sections"))
    out = usable.join(sections, "query_id", "left").withColumn("n_sections", F.coalesce("n_sections", F.lit(0)).cast("long"))
    n = F.size("evidence").cast("long")
    return out.select("query_id", "doc_id", category(F.col("question"), n).alias("category"), F.when(F.col("n_sections") > 1, "cross_section").otherwise("single_section").alias("difficulty"), n.alias("n_evidence"), "n_sections", "gold")


def case_task(kind: Column, difficulty: Column, n_evidence: Column) -> Column:
    """The kind of question that a case stands for."""
    many = kind == "multi_evidence"
    out = F.when(kind == "method", "method_qa").when(kind == "comparison", "comparison_qa").when(kind == "dataset", "dataset_qa").when(kind == "fact", "fact_qa")
    return out.when(many & (difficulty == "single_section") & (n_evidence <= 2), "local_evidence_qa").when(many | (n_evidence > 2), "multi_evidence_qa").otherwise("local_evidence_qa")


def citation_scores(cited: Column, retrieved: Column, evidence: Column) -> Column:
    """(retrieval_hit, evidence_hit, evidence_recall, cited_support) of three arrays of ids; ids count once."""
    c, r, e = (F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))) for x in (cited, retrieved, evidence))
    both = lambda x: F.size(F.array_intersect(x, e))
    return F.struct(
        (both(r) > 0).alias("retrieval_hit"), (both(c) > 0).alias("evidence_hit"),
        F.round(F.when(F.size(e) > 0, both(r) / F.size(e)).otherwise(0.0), 4).alias("evidence_recall"), F.round(F.when(F.size(c) > 0, both(c) / F.size(c)).otherwise(0.0), 4).alias("cited_support"),
    )


def retrieval_quality(hits: DataFrame, gold: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, chunk_recall, token_recall, section_recall, precision, f1, mrr, hit of each query of `gold` (query_id, item_id). hits: (query_id, item_id, rank); items: (item_id, text, section).

    Tokens are those of all gold items together and of all hits together; only these items are looked up, and tokens are counted as rows.
    """
    wanted = items.join(hits.select("item_id").unionByName(gold.select("item_id")).distinct(), "item_id", "left_semi").select("item_id", "section", F.array_distinct(X.simple_tokens(F.col("text"))).alias("tokens"))
    kinds = {"tokens": wanted.select("item_id", F.explode("tokens").alias("value")), "sections": wanted.where("section is not null").select("item_id", F.col("section").alias("value"))}

    def share(kind: str) -> DataFrame:
        """query_id, share of the distinct values of a query's gold items that its hits have: rows of (query, value), never an item's or a query's values together."""
        own, found = (df.select("query_id", "item_id").join(kinds[kind], "item_id").select("query_id", "value").distinct() for df in (gold, hits))
        met = own.join(found.withColumn("there", F.lit(1)), ["query_id", "value"], "left")
        return met.groupBy("query_id").agg((F.count("there") / F.count(F.lit(1))).alias(kind))

    found = gold.join(hits, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("rank").alias("n_hit"), F.min("rank").alias("first"))
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"))
    out = found.join(n, "query_id", "left").join(share("tokens"), "query_id", "left").join(share("sections"), "query_id", "left")
    of = lambda kind: F.coalesce(kind, F.lit(0.0))
    p, r = F.coalesce(F.col("n_hit") / F.col("n_found"), F.lit(0.0)), F.col("n_hit") / F.col("n_gold")
    return out.select(
        "query_id", F.round(r, 4).alias("chunk_recall"), F.round(of("tokens"), 4).alias("token_recall"), F.round(of("sections"), 4).alias("section_recall"), F.round(p, 4).alias("precision"),
        F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"), (F.col("n_hit") > 0).cast("double").alias("hit"),
    )


def rescored(answers: DataFrame) -> DataFrame:
    """`answers` (question, answer, gold, cited_text) with n_facts, key_fact_f1 (share of the gold answer's facts in the answer) and groundedness (in what it cites, .7 of the
    former at least). Without facts the likeness of answer and gold counts for both, if anything is cited."""
    bare = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    facts = answers.withColumn("facts", X.gold_facts(F.col("gold"), F.col("question")))
    share = lambda text: F.size(F.filter("facts", lambda f: F.contains(text, f))) / F.size("facts")
    own, cited = share(bare(F.col("answer"))), share(bare(F.col("cited_text")))
    some = F.size("facts") > 0
    alike = likeness(F.col("answer"), F.col("gold"))
    return facts.select(
        *answers.columns, F.size("facts").cast("long").alias("n_facts"), F.round(F.when(some, own).otherwise(alike), 4).alias("key_fact_f1"),
        F.round(F.when(some, F.least(F.lit(1.0), F.greatest(cited, 0.7 * own))).when(bare(F.col("cited_text")) != "", alike).otherwise(0.0), 4).alias("groundedness"),
    )


def likeness(a: Column, b: Column) -> Column:
    """The matcher's ratio of two normalised texts, in Arrow batches."""
    from difflib import SequenceMatcher

    import pandas as pd

    ratio = lambda x, y: SequenceMatcher(None, "".join((x or "").lower().split()), "".join((y or "").lower().split())).ratio()
    return F.pandas_udf(lambda x, y: pd.Series([ratio(p, q) for p, q in zip(x, y)]), "double")(a, b)


def prompt_features(prompt: Column) -> Column:
    """What a prompt asks for: structured, citation, refusal, grounding, verification."""
    t = F.lower(F.coalesce(prompt, F.lit("")))
    has = lambda *marks: X.contains_any(t, list(marks))
    grade = lambda yes, no: F.when(yes, 1.0).otherwise(no)
    return F.struct(
        grade(has("json") & has("keys"), 0.55).alias("structured"), grade(has("cited_chunk_ids", "chunk ids", "cite"), 0.35).alias("citation"),
        grade(has("insufficient_evidence", "not directly supported", "missing"), 0.25).alias("refusal"), grade(has("only") & has("chunks", "retrieved"), 0.65).alias("grounding"), grade(has("verify", "evidence_check", "claim_evidence_map"), 0.35).alias("verification"),
    )


def generation_scores(rows: DataFrame) -> DataFrame:
    """`rows` (prompt, chunk_recall, token_recall, section_recall, mrr, hit) with the estimated MEASURES of what a model would generate."""
    f = rows.withColumn("f", prompt_features(F.col("prompt")))
    one = lambda c: F.least(F.lit(1.0), c)
    f = f.withColumn("support", one(0.55 * F.col("chunk_recall") + 0.25 * F.col("token_recall") + 0.2 * F.col("section_recall")))
    f = f.withColumns({
        "relevance": one(0.7 * F.col("token_recall") + 0.2 * F.col("hit") + 0.1 * F.col("f.grounding")), "correctness": one(0.65 * F.col("support") + 0.2 * F.col("mrr") + 0.15 * F.col("f.grounding")),
        "citation_valid": one(0.7 * F.col("support") + 0.3 * F.col("f.citation")),
    }).withColumns({
        "retrieval_effect_score": (F.col("correctness") + F.col("relevance") + F.col("support") + F.col("citation_valid")) / 4,
        "prompt_control_score": (F.col("f.structured") + F.col("f.citation") + F.col("f.refusal") + F.col("f.grounding") + F.col("f.verification")) / 5,
    })
    f = f.withColumns({"overall": 0.7 * F.col("retrieval_effect_score") + 0.3 * F.col("prompt_control_score"), "evidence_support": F.col("support"), "format_valid": F.col("f.structured"), "refusal_ready": F.col("f.refusal")})
    return f.select(*rows.columns, *MEASURES)


def averages(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Cases and mean measures of each group."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(m), 4).alias(m) for m in measures])


def round_deltas(summary: DataFrame, measures: list[str], by: list[str]) -> DataFrame:
    """`summary` (round, by, measures) with the change of each measure against the round before."""
    w = Window.partitionBy(*by).orderBy("round")
    return summary.select("round", *by, *measures, *[F.round(F.col(m) - F.lag(m).over(w), 4).alias(f"{m}_delta") for m in measures])


def mode_summary(runs: DataFrame) -> DataFrame:
    """mode, total, error_rate, format_valid_rate, citation_rate, mean_latency, mean_length of `runs` (mode, error, format_valid, cited, latency, length); all but errors are over runs without one."""
    ok = F.col("error").isNull() | (F.col("error") == "")
    n_ok = F.greatest(F.count_if(ok), F.lit(1))
    rate = lambda c: F.round(F.count_if(ok & F.col(c)) / n_ok, 4)
    mean = lambda c: F.round(F.coalesce(F.sum(F.when(ok, F.coalesce(c, F.lit(0)))), F.lit(0)) / n_ok, 2)
    return runs.groupBy("mode").agg(
        F.count(F.lit(1)).alias("total"), F.round(F.count_if(~ok) / F.count(F.lit(1)), 4).alias("error_rate"), rate("format_valid").alias("format_valid_rate"), rate("cited").alias("citation_rate"), mean("latency").alias("mean_latency"), mean("length").alias("mean_length")
    )


def first_of_each(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each split."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= n).drop("_n")
