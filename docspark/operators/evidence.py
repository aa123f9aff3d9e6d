"""Citations of answers: resolving, support of claims, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as X


def resolve(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """answer_id, doc_id, pos, found, content of `citations` (answer_id, doc_id, pos): what isn't there stays, with found false."""
    known = blocks.select("doc_id", "pos", "content", F.lit(True).alias("hit"))
    return citations.join(known, ["doc_id", "pos"], "left").select("answer_id", "doc_id", "pos", F.coalesce("hit", F.lit(False)).alias("found"), "content")


def support(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """answer_id, score (share of the claim's tokens in its evidence, 4 digits), level, of `claims` (answer_id, claim)."""
    evidence = resolved.where("found").groupBy("answer_id").agg(F.array_distinct(F.flatten(F.collect_list(X.evidence_tokens(F.col("content"))))).alias("e"))
    own = claims.select("answer_id", X.evidence_tokens(F.col("claim")).alias("c")).join(evidence, "answer_id", "left")
    score = F.when(F.size("c") == 0, 0.0).otherwise(F.coalesce(F.size(F.array_intersect("c", "e")), F.lit(0)) / F.size("c"))
    return own.select("answer_id", F.round(F.coalesce(score, F.lit(0.0)), 4).alias("score")).withColumn("level", support_level(F.col("score")))


def support_level(score: Column) -> Column:
    return F.when(score >= 0.65, "strong").when(score >= 0.35, "partial").when(score > 0, "weak").otherwise("none")


def consistency(resolved: DataFrame, supported: DataFrame) -> DataFrame:
    """For each answer: citations, how many are invalid, the share that exist, mean support."""
    cited = resolved.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_cited"), F.sum((~F.col("found")).cast("long")).alias("n_invalid"), F.round(F.avg(F.col("found").cast("double")), 4).alias("exist_rate"))
    return supported.join(cited, "answer_id", "left").select(
        "answer_id",
        F.coalesce("n_cited", F.lit(0)).cast("long").alias("n_cited"),
        F.coalesce("n_invalid", F.lit(0)).cast("long").alias("n_invalid"),
        F.coalesce("exist_rate", F.lit(0.0)).alias("exist_rate"),
        "score",
        F.col("n_cited").isNull().alias("missing_citation"),
    )


#: What a structured answer has to hold, and of which type.
PAYLOAD = {"answer": "string", "cited_chunk_ids": "list", "claim_evidence_map": "object", "follow_up_questions": "list", "insufficient_evidence": "boolean"}
TYPES = {"string": "^STRING", "list": "^ARRAY", "object": "^OBJECT", "boolean": "^BOOLEAN"}


def validate(payload: Column) -> Column:
    """(valid, missing, type_errors) of a structured answer as JSON text; what is no object misses all."""
    v = F.try_parse_json(payload)
    is_object = F.coalesce(F.schema_of_variant(v).rlike("^OBJECT"), F.lit(False))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    keys = sorted(PAYLOAD)
    absent = lambda k: ~is_object | kind(k).isNull()
    missing = F.array_compact(F.array(*[F.when(absent(k), k) for k in keys]))
    wrong = F.array_compact(F.array(*[F.when(~absent(k) & ~kind(k).rlike(TYPES[PAYLOAD[k]]), f"{k} must be {PAYLOAD[k]}") for k in keys]))
    return F.struct((F.size(missing) + F.size(wrong) == 0).alias("valid"), missing.alias("missing"), wrong.alias("type_errors"))


def claim_map(claims: Column, answer: Column, cited: Column) -> Column:
    """The claims with their ids if there are any, else the whole answer with all it cites; nothing without an answer."""
    own = F.when(F.trim(F.coalesce(answer, F.lit(""))) != "", F.create_map(F.trim(answer), cited))
    return F.when(F.coalesce(F.size(F.map_keys(claims)), F.lit(0)) > 0, claims).otherwise(F.coalesce(own, F.create_map().cast("map<string,array<string>>")))


def preview(citations: DataFrame, blocks: DataFrame, most: int = 8, chars: int = 220) -> DataFrame:
    """answer_id, place, doc_id, pos, preview: the first `most` citations (answer_id, doc_id, pos, place) of each answer, once each, with the beginning of what they cite, empty if it isn't there."""
    once = citations.groupBy("answer_id", "doc_id", "pos").agg(F.min("place").alias("place"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("place")).cast("long")).where(F.col("place") <= most)
    return ranked.join(blocks.select("doc_id", "pos", "content"), ["doc_id", "pos"], "left").select("answer_id", "place", "doc_id", "pos", F.coalesce(F.substring("content", 1, chars), F.lit("")).alias("preview"))


def task_summary(traces: DataFrame) -> DataFrame:
    """Of each kind of question: answers, rates of citations that exist and of answers without any, mean support, invalid citations. traces: consistency, with kind."""
    return traces.groupBy("kind").agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg("exist_rate"), 4).alias("exist_rate"), F.round(F.avg("score"), 4).alias("mean_support"), F.sum("n_invalid").cast("long").alias("n_invalid"),
        F.round(F.count_if("missing_citation") / F.count(F.lit(1)), 4).alias("missing_rate"),
    )
