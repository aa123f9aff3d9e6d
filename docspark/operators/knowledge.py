"""Knowledge graphs that questions drive: terms of a question and its answer, nodes and edges from events, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as X


def terms(events: DataFrame, most: int = 4) -> DataFrame:
    """event_id, label, type, score, reasons: the `most` weightiest terms of each of `events` (event_id, question, answer).

    Terms a question is about and claims of the answer weigh 3, each word of the answer 1; ties go by label. The 3 `most` weightiest are looked at.
    """
    weighed = lambda labels, weight, reason: F.transform(labels, lambda t: F.struct(t.alias("label"), F.lit(weight).alias("weight"), F.lit(reason).alias("reason")))
    stop = lambda t: t.isin(X.STOP_TERMS) | F.lower(t).isin(X.STOP_TERMS)
    focus = F.filter(F.transform(F.split(F.coalesce("question", F.lit("")), r"[，,。？?；;：:\s]+"), X.knowledge_label), lambda t: F.length(t).between(2, 18) & ~t.isin(X.STOP_TERMS))
    segments = F.filter(F.transform(F.split(F.coalesce("answer", F.lit("")), r"\([0-9]+\)|（[0-9]+）|[。；;\n]"), X.strip), lambda t: t != "")
    claims = F.filter(F.transform(segments, X.knowledge_label), lambda t: F.length(t).between(2, 24))
    words = F.flatten(F.transform(segments, lambda t: F.regexp_extract_all(t, F.lit(f"[A-Za-z][A-Za-z0-9_\\-]{{2,}}|[{X.CJK}]{{2,10}}"), F.lit(0))))
    words = F.transform(F.filter(F.transform(words, X.knowledge_label), lambda t: (t != "") & ~stop(t)), lambda t: F.substring(t, 1, 18))
    every = F.concat(weighed(F.array_distinct(F.slice(focus, 1, 3)), 3, "question_focus"), weighed(claims, 3, "answer_claim"), weighed(words, 1, "term_frequency"))
    counted = events.select("event_id", F.explode(every).alias("t")).select("event_id", "t.*").groupBy("event_id", "label").agg(F.sum("weight").alias("n"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    by = Window.partitionBy("event_id").orderBy(F.col("n").desc(), "label")
    looked = counted.withColumn("place", F.row_number().over(by)).where(F.col("place") <= 3 * most).where(~stop(F.col("label")) & (F.length("label") >= 2))
    kept = looked.withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy("place"))).where(F.col("k") <= most)
    why = lambda reason, more: F.when(F.array_contains("reasons", reason), more).otherwise(0.0)
    score = 0.35 + F.least(F.col("n"), F.lit(5)) * 0.08 + why("answer_claim", 0.18) + why("question_focus", 0.18) + F.when(F.col("label").rlike("[A-Z]{2,}|Agent|SQL|RAG"), 0.12).otherwise(0.0)
    return kept.select("event_id", "label", X.knowledge_type(F.col("label")).alias("type"), F.round(F.least(F.lit(1.0), score), 3).alias("score"), "reasons")


#: The node that all questions hang on, and the others that a graph begins with: (id, type, label, score).
ROOT = "question_graph"
FIXED = [("workbench", "System", "Workbench", 1.0), (ROOT, "Capability", "Question graph", 1.0)]


def event_nodes(events: DataFrame, found: DataFrame, fixed: list[tuple[str, str, str, float]] = FIXED) -> DataFrame:
    """id, type, label, score, n_events: the nodes of `events` (event_id, question, doc) and of their terms (event_id, label, type, score), beside the `fixed` ones.

    Every aggregate can be merged, so batch and stream share the function.
    """
    node = lambda i, t, label, score: F.struct(i.alias("id"), t.alias("type"), label.alias("label"), score.alias("score"))
    own = F.array(
        node(X.slug("doc", F.col("doc")), F.lit("Document"), F.col("doc"), F.lit(0.8)),
        node(F.concat(F.lit("question_"), F.col("event_id").cast("string")), F.lit("QuestionEvent"), F.substring(F.coalesce("question", F.lit("")), 1, 80), F.lit(1.0)),
    )
    rows = events.select("event_id", F.explode(own).alias("n")).select("event_id", "n.*")
    rows = rows.unionByName(found.select("event_id", X.slug("knowledge", F.col("label")).alias("id"), "type", "label", "score"))
    always = events.sparkSession.createDataFrame([(None, *f) for f in fixed], "event_id long, id string, type string, label string, score double")
    rows = rows.select("event_id", "id", "type", "label", F.col("score").cast("double").alias("score")).unionByName(always.select(F.col("event_id").cast(events.schema["event_id"].dataType).alias("event_id"), "id", "type", "label", "score"))
    return rows.groupBy("id").agg(F.min("type").alias("type"), F.min("label").alias("label"), F.max("score").alias("score"), F.count_distinct("event_id").alias("n_events"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def delta_graph(deltas: DataFrame) -> DataFrame:
    """id (source::relation::target), src, tgt, relation, n_sources, confidence: the edges of all deltas (source_id, src, relation, tgt), each once."""
    edge = F.concat_ws("::", "src", "relation", "tgt")
    return deltas.groupBy(edge.alias("id"), "src", "tgt", "relation").agg(F.count_distinct("source_id").alias("n_sources")).withColumn("confidence", F.lit(0.72))


#: Parts that a range of numbers is counted in.
CUTS = 1024


def nth_values(rows: DataFrame, columns: list[Column], nth: int) -> list[int]:
    """The values of whole-number `columns` of the row at place `nth`, from 0, of all `rows` sorted by them.

    Column by column, the range that holds the place is counted in CUTS parts, again and again, until it is one number. Only counts reach the driver; nothing is sorted.
    """
    found, inside, before = [], F.lit(True), 0
    for value in columns:
        low, high = rows.where(inside).select(F.min(value), F.max(value)).first()
        while low < high:
            width = -(-(high - low + 1) // CUTS)
            part = F.call_function("div", value - F.lit(low), F.lit(width))
            counts = rows.where(inside & value.between(low, high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # CUTS rows at most
            for k, n in sorted((r.part, r.n) for r in counts):
                if before + n > nth:
                    break
                before += n
            low, high = low + k * width, min(high, low + (k + 1) * width - 1)
        found.append(low)
        inside = inside & (value == low)
    return found


def later_share(rows: DataFrame, columns: list[Column], share: float) -> Column:
    """Whether a row comes after the first `share` of all `rows` by whole-number `columns` without nulls. Rows equal in all of them are on one side, with the first of them."""
    n = rows.count()
    first = int(n * share)
    if first >= n:
        return F.lit(False)
    border = nth_values(rows, columns, first)
    return F.struct(*columns) >= F.struct(*[F.lit(v).cast("long") for v in border])
