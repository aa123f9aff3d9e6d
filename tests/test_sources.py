"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from docspark.operators.graph import event_edges
from docspark.sources import json_store as J
from docspark.streaming import events as S


def test_documents_with_defaults_and_broken_files(spark, tmp_path):
    good = {"_note": "x", "docId": "d1", "pages": [{"pageNo": 1, "chunks": [{"chunkId": "p1", "index": 3, "content": "a"}, {"chunkId": " ", "content": "b"}, {"chunkId": "p2"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    docs = J.read_documents(spark, str(tmp_path), J.CHUNKS)
    assert docs.count() == 2 and docs.where("docId is null").count() == 1
    assert sorted((r.idx, r.chunk_id, r.label, r.content) for r in J.blocks_of(docs).collect()) == [(2, "p2", "text", ""), (3, "p1", "text", "a")]


def test_paragraphs_of_ragged_papers(spark):
    row = {"id": "p", "full_text": {"section_name": ["A", "B"], "paragraphs": [["x", " ", "y"]]}}
    papers = spark.createDataFrame([json.dumps(row)], "string").select(F.from_json("value", J.PAPERS).alias("r")).select("r.*")
    assert [(r.chunk_id, r.text) for r in J.paragraphs_of(papers).orderBy("chunk_id").collect()] == [("s000_p000", "x"), ("s000_p002", "y")]


def test_structured_blocks_come_first(spark):
    plain = spark.createDataFrame([("a", "x"), ("b", "x")], "doc_id string, content string")
    rich = spark.createDataFrame([("a", "y", "ready"), ("b", "y", "failed")], "doc_id string, content string, status string")
    assert sorted(tuple(r) for r in J.prefer_structured(plain, rich).collect()) == [("a", "y"), ("b", "x")]


def test_graph_round_trip(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "b")], "src string, tgt string")
    J.write_graph(nodes, edges, str(tmp_path))
    again = J.read_graph(spark, str(tmp_path))
    assert again[0].collect() == nodes.collect() and again[1].collect() == edges.collect()


def test_streamed_edges_equal_the_batch(spark, tmp_path):
    rows = [(k, f"q{k % 3}", f"d{k % 2}", f"c{k % 4}", 0.5 + k / 100) for k in range(20)]
    schema = "event_id long, question string, doc string, concept string, score double"
    for k in (0, 1):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = S.edge_stream(source).writeStream.format("memory").queryName("edges").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination(120)
    batch = event_edges(spark.createDataFrame(rows, schema))
    key = lambda df: sorted(tuple(r) for r in df.select("src", "tgt", "relation", F.round("weight", 2), "n_events").collect())
    assert key(spark.table("edges")) == key(batch)


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 2.0), ("2024-01-02 00:00:00", "a", 4.0)], "ts string, event_type string, value double")
    assert sorted((r.n, r.total) for r in S.windowed_counts(rows).collect()) == [(1, 4.0), (2, 3.0)]


def test_projects_collections_pages_and_splits(spark, tmp_path):
    for name, meta in (("b", {"id": "b1", "name": "B"}), ("a", {"summary": "s"}), ("none", None)):
        (tmp_path / "p" / name).mkdir(parents=True)
        if meta is not None:
            (tmp_path / "p" / name / "meta.json").write_text(json.dumps(meta))
    assert [(r.id, r.name, r.summary) for r in J.read_projects(spark, str(tmp_path / "p")).orderBy("id").collect()] == [("a", "a", "s"), ("b1", "B", "")]

    def stored(folder, file, doc, words, **more):
        (tmp_path / "c" / folder).mkdir(parents=True, exist_ok=True)
        chunks = [{"chunkId": f"x{k}", "content": w, "index": k} for k, w in enumerate(words)]
        (tmp_path / "c" / folder / file).write_text(json.dumps({"docId": doc, "pages": [{"pageNo": 1, "chunks": chunks}], **more}))

    stored("one", "chunks.json", "d1", ["plain"])
    stored("one", "lad.json", "d1", ["ready", "two"], status="ready")
    stored("two", "chunks.json", "d2", ["kept"])
    stored("two", "lad.json", "d2", ["draft"], status="running")
    stored("_three", "chunks.json", "d3", ["hidden"])
    got = J.read_collection(spark, str(tmp_path / "c" / "*" / "chunks.json"), str(tmp_path / "c" / "*" / "lad.json")).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.content, r.n_chars) for r in got] == [("d1", 0, "ready", 5), ("d1", 1, "two", 3), ("d2", 0, "kept", 4)]
    (tmp_path / "i").mkdir()
    for k in range(3):
        (tmp_path / "i" / f"page_{k}.png").write_bytes(bytes([k]) * (k + 1))
    assert [(r.page, r.n_bytes, bytes(r.content)) for r in J.read_pages(spark, str(tmp_path / "i"), 2).orderBy("page").collect()] == [(0, 1, b"\0"), (1, 2, b"\1\1")]
    for split in ("train", "test"):
        (tmp_path / f"{split}.json").write_text(json.dumps({"id": split, "title": "t"}))
    splits = J.read_splits(spark, {s: str(tmp_path / f"{s}.json") for s in ("train", "test")})
    assert sorted((r.id, r.split) for r in splits.collect()) == [("test", "test"), ("train", "train")]
    with pytest.raises(ValueError):
        J.read_splits(spark, {})


def test_questions_of_papers(spark, tmp_path):
    answer = lambda text, evidence, no=False: {"unanswerable": no, "free_form_answer": text, "evidence": evidence}
    paper = {
        "id": "p", "full_text": {"section_name": ["Intro"], "paragraphs": [["First  fact here.", "Second one."]]},
        "qas": {"question": ["What?", "Who?"], "question_id": ["q1"], "answers": [{"answer": [answer("yes", ["fact here."]), answer("", [], True)]}, {"answer": [answer("", [], True)]}]},
    }
    (tmp_path / "p.json").write_text(json.dumps(paper))
    schema = "id string, full_text struct<section_name:array<string>,paragraphs:array<array<string>>>, " + J.QUESTIONS.split(", ", 1)[1]
    papers = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path / "p.json"))
    got = {r.question_id: r for r in J.questions_of(papers, J.paragraphs_of(papers)).collect()}
    assert (got["q1"].gold, got["q1"].answerable, got["q1"].evidence) == (["yes"], True, ["s000_p000"])
    assert (got["q0001"].gold, got["q0001"].answerable, got["q0001"].evidence) == (["Who?"], False, [])


def test_reports_and_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, t string")
    J.write_report(rows, str(tmp_path / "r"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "r" / "report").glob("part*")))
    assert text.splitlines()[0] == "| k | t |" and "a\\|b" in text and spark.read.json(str(tmp_path / "r" / "rows")).count() == 2
    J.write_vectors(spark.createDataFrame([(1, [0.5])], "item_id long, v array<float>"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).first().v == [0.5]
