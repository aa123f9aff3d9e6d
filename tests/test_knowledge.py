"""Extraction from real sentences, Chinese included, and the graph's small parts."""

import datetime

from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import blocks, graph, knowledge, retrieval, tasks

SENTENCES = [
    "BERT uses Attention and is evaluated on SQuAD.",
    "Retrieval Augmented Generation (RAG) outperforms GPT on HotpotQA with an F1 of 80.",
    'The "knowledge base" requires FAISS.',
    "我们提出知识图谱 (KG) 方法，使用注意力机制进行微调。",
    "模型 uses 编码器 and 解码器 requires 注意力",
    "Transformer extends Transformer",
]


def blocks_of(spark):
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(SENTENCES)], "doc_id long, pos long, content string")


def test_entities_of_sentences(spark):
    found = {}
    for r in graph.rule_entities(blocks_of(spark)).collect():
        found.setdefault(r.pos, set()).add((r.name, r.type, r.source))
    assert {("BERT", "Method", "rule_acronym"), ("SQuAD", "Dataset", "rule_known_dataset")} <= found[0]
    assert {("Retrieval Augmented Generation", "Method", "rule_paren_acronym"), ("HotpotQA", "Dataset", "rule_known_dataset"), ("F1", "Metric", "rule_known_metric"), ("GPT", "Method", "rule_acronym")} <= found[1]
    assert ("knowledge base", "Concept", "rule_quoted") in found[2]
    assert {("知识图谱", "Concept", "rule_chinese_tech"), ("注意力机制", "Concept", "rule_chinese_tech"), ("微调", "Concept", "rule_chinese_tech")} <= found[3]
    assert any(name.endswith("知识图谱") and source == "rule_cn_en_pair" for name, _, source in found[3])


def test_relations_of_any_script_resolve(spark):
    relations = {tuple(r)[2:] for r in graph.verb_relations(blocks_of(spark)).collect()}
    assert {("bert", "USES", "attention"), ("模型", "USES", "编码器"), ("解码器", "DEPENDS_ON", "注意力"), ("transformer", "BASED_ON", "transformer")} <= relations
    entities = graph.rule_entities(blocks_of(spark)).unionByName(spark.createDataFrame([(1, 0, "Attention", "Method", 0.7, "x"), (1, 4, "编码器", "Concept", 0.8, "x"), (1, 4, "大模型", "Concept", 0.8, "x")], "doc_id long, pos long, name string, type string, confidence double, source string"))
    resolved = {tuple(r)[2:] for r in graph.resolved_relations(graph.verb_relations(blocks_of(spark)), entities).collect()}
    assert {("bert", "USES", "attention"), ("大模型", "USES", "编码器"), ("解码器", "DEPENDS_ON", "注意力")} <= resolved
    assert not any(a == b for a, _, b in resolved)


def test_cooccurrences(spark):
    rows = [(1, 0, "BERT", "Method"), (1, 0, "bert ", "Method"), (1, 0, "GPT", "Method"), (1, 0, "SQuAD", "Dataset"), (1, 1, "BERT", "Method"), (1, 1, "SQuAD", "Dataset"), (1, 1, "F1", "Metric"), (2, 0, "F1", "Metric"), (2, 0, "x", "Concept")]
    got = {tuple(r) for r in graph.cooccurrences(spark.createDataFrame(rows, "doc_id long, pos long, name string, type string")).collect()}
    assert got == {("bert", "squad", "EVALUATES_ON", 0.5, 2), ("gpt", "squad", "EVALUATES_ON", 0.5, 1), ("bert", "gpt", "COMPARES_WITH", 0.35, 1), ("bert", "f1", "ACHIEVES", 0.4, 1)}


def test_relations_are_cleaned(spark):
    rows = [("a", "b", "USES", 0.3), ("a", "b", "USES", 0.9), ("a", "b", "USES", 0.2), ("a", "a", "USES", 0.9), ("a", "gone", "USES", 0.9), ("doc_1", "b", "CONTAINS", 1.0), ("a", " ", "USES", 0.9), ("a", "b", "LIKES", 0.9)]
    ids = spark.createDataFrame([("a",), ("b",), (" ",)], "id string")
    got = {tuple(r) for r in graph.clean_relations(spark.createDataFrame(rows, "src string, tgt string, relation string, confidence double"), ids).collect()}
    assert got == {("a", "b", "USES", 0.9), ("doc_1", "b", "CONTAINS", 1.0)}


def test_contains_edges(spark):
    filled = spark.createDataFrame([(1, 0, None), (1, 1, 1), (1, 2, 1)], "doc_id long, pos long, section_pos long")
    assert {tuple(r)[:2] for r in graph.contains_edges(filled).collect()} == {("section_1_1", "chunk_1_1"), ("section_1_1", "chunk_1_2"), ("doc_1", "section_1_1")}


def test_terms_of_questions(spark):
    rows = [(1, "知识图谱的构建流程，RAG 如何检索？", "构建流程包括实体抽取。RAG 使用向量检索；RAG 提升召回率"), (2, None, None), (3, "", "")]
    got = {}
    for r in knowledge.terms(spark.createDataFrame(rows, "event_id long, question string, answer string")).collect():
        got.setdefault(r.event_id, {})[r.label] = (r.type, r.score, tuple(r.reasons))
    focus, claim, word = "question_focus", "answer_claim", "term_frequency"
    assert got == {1: {"RAG": ("Method", 1.0, (focus, word)), "构建流程": ("Method", 0.85, (claim, word)), "RAG 使用向量检索": ("Method", 0.89, (claim,)), "RAG 提升召回率": ("Method", 0.89, (claim,))}}


def test_deltas_and_fixed_nodes(spark):
    deltas = spark.createDataFrame([(1, "q", "USES", "k"), (2, "q", "USES", "k"), (2, "q", "USES", "m")], "source_id long, src string, relation string, tgt string")
    assert {tuple(r) for r in knowledge.delta_graph(deltas).collect()} == {("q::USES::k", "q", "k", "USES", 2, 0.72), ("q::USES::m", "q", "m", "USES", 1, 0.72)}
    events = spark.createDataFrame([(1, "what", "d")], "event_id long, question string, doc string")
    found = spark.createDataFrame([(1, "RAG", "Method", 0.7)], "event_id long, label string, type string, score double")
    assert {r.id for r in knowledge.event_nodes(events, found, [("root", "System", "Root", 1.0)]).collect()} == {"root", "doc_d", "question_1", "knowledge_rag"}
    e = spark.createDataFrame([(1, "a", "d", "c", 0.5)], "event_id long, question string, doc string, concept string, score double")
    assert {r.src for r in graph.event_edges(e, "root").collect()} == {"root", "question_a", "knowledge_c"}


def test_region_kinds(spark):
    labels = ["image", "chart", "doc_title", "table", "inline_formula", "odd", None]
    got = [r[0] for r in spark.createDataFrame([(x, k) for k, x in enumerate(labels)], "l string, k int").orderBy("k").select(X.region_kind(F.col("l"))).collect()]
    assert got == ["image", "image", "text", "table", "formula", "odd", None]


def test_manifest(spark):
    rows = [("c1", 1, "D", None, "text", "s1", "A > B", None, None), ("c2", 1, "D", 3, "", None, "", "H", "title")]
    got = {r.chunk_id: r for r in blocks.manifest(spark.createDataFrame(rows, "chunk_id string, doc_id long, doc_name string, page int, content string, section_id string, section_path string, heading string, kind string")).collect()}
    assert (got["c1"].page, got["c1"].n_chars, got["c1"].sources, got["c1"].source_sections, got["c1"].source_paths, got["c1"].source_kinds, got["c1"].heading) == (0, 4, ["c1"], ["s1"], ["A > B"], ["paragraph"], "")
    assert (got["c2"].source_sections, got["c2"].source_paths, got["c2"].source_kinds, got["c2"].heading) == ([], [], ["title"], "H")


def test_tasks(spark):
    now = datetime.datetime(2024, 1, 1)
    rows = [(1, "pending", 0, 3, None, "w", 10.0), (2, "processing", 1, 3, now - datetime.timedelta(1), "w", 50.0), (3, "processing", 3, 3, now + datetime.timedelta(1), "w", 50.0), (4, "processing", 0, 3, None, "w", 50.0), (5, "done", 0, 3, None, None, 100.0)]
    t = spark.createDataFrame(rows, "task_id long, status string, retry_count int, max_retries int, lock_expires_at timestamp, worker_id string, progress double")
    instant = F.lit("2024-01-01").cast("timestamp")
    assert {r.task_id for r in t.where(tasks.claimable(instant)).collect()} == {1, 2}
    assert [r[0] for r in spark.range(8).select(tasks.retry_delay(F.col("id"))).collect()] == [60.0, 120.0, 240.0, 480.0, 960.0, 1920.0, 3600.0, 3600.0]
    fails = spark.createDataFrame([(2, "timeout", "slow"), (3, "timeout", "slow"), (4, "not_found", "gone"), (4, "timeout", "slow"), (9, "timeout", "x")], "task_id long, error_type string, error_message string")
    got = {r.task_id: (r.status, r.retry_count, r.worker_id, r.progress, r.delay) for r in tasks.failed(t, fails, instant).collect()}
    assert got == {1: ("pending", 0, "w", 10.0, None), 2: ("pending", 2, None, 0.0, 120.0), 3: ("dead_letter", 3, "w", 50.0, None), 4: ("dead_letter", 0, "w", 50.0, None), 5: ("done", 0, None, 100.0, None)}
    small = t.select("task_id", "status")
    new = spark.createDataFrame([(1, "lost"), (6, "pending")], "task_id long, status string")
    assert {tuple(r) for r in tasks.created(small, new).collect()} == {(1, "pending"), (2, "processing"), (3, "processing"), (4, "processing"), (5, "done"), (6, "pending")}
    assert {tuple(r) for r in tasks.updated(small, spark.createDataFrame([(1, "done"), (2, None)], "task_id long, status string")).collect()} == {(1, "done"), (2, "processing"), (3, "processing"), (4, "processing"), (5, "done")}


def test_hits_are_filled_up_from_sections(spark):
    items = spark.createDataFrame([(1, "s1", "A > B"), (2, "s1", "A > B"), (3, "s2", "A > C"), (4, "s3", "AB"), (5, None, None), (6, "s4", "Z")], "item_id long, section string, path string")
    best = spark.createDataFrame([(7, 1, 0.5, 1), (7, 5, 0.4, 2), (8, 6, 0.3, 1)], "query_id long, item_id long, score double, rank long")
    got = [tuple(r) for r in retrieval.expanded(best, items, 5).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 0.5, 1, "found"), (7, 5, 0.4, 2, "found"), (7, 2, 0.0, 3, "section"), (7, 3, 0.0, 4, "related"), (7, 4, 0.0, 5, "related"), (8, 6, 0.3, 1, "found")]


def test_uncovered_pairs(spark):
    many = [f"name{k:03d}" for k in range(60)]
    rows = [(1, 0, n) for n in ("BERT", "bert", "Attention", "SQuAD", "the", "F1")] + [(2, 0, n) for n in many] + [(3, 0, "alone")]
    entities = spark.createDataFrame(rows, "doc_id long, pos long, name string")
    covered = spark.createDataFrame([(1, 0, "squad", "bert"), (1, 0, "bert", "squad"), (1, 0, "attention", "f1"), *[(2, 0, many[k], many[0]) for k in range(1, 59)]], "doc_id long, pos long, a string, b string")
    got = [tuple(r)[:4] for r in graph.uncovered_pairs(entities, covered, 3).orderBy("doc_id", "place").collect()]
    assert got[:3] == [(1, 0, "attention", "bert"), (1, 0, "attention", "squad"), (1, 0, "bert", "f1")]
    assert got[3:] == [(2, 0, many[0], many[59]), (2, 0, many[1], many[2]), (2, 0, many[1], many[3])]


def test_each_text_is_searched_once_for_a_relation(spark):
    """Against the plain pattern, with verbs that are words themselves and words that run on."""
    import random
    import re

    rng = random.Random(4)
    words = ["uses", "use", "needs", "requires", "based", "on", "模型", "a_b", "é1", "is", "part", "of", "x" * 50]
    texts = {k: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", "]) for _ in range(30)) for k in range(60)}
    found = graph.verb_relations(spark.createDataFrame([(k, 0, t) for k, t in texts.items()], "doc_id long, pos long, content string"))
    got = sorted((r.doc_id, r.source, r.relation, r.target) for r in found.collect())
    assert got == sorted((k, m[1], name, m[2]) for k, t in texts.items() for name, v in graph.VERBS.items() for m in re.finditer(rf"(\w+)\s+(?:{v})\s+(\w+)", t.lower()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == len(graph.VERBS)
