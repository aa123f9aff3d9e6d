"""Folds and functions on fixtures made by hand."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import blocks, context, evaluation, evidence, folds, graph, knowledge, layout, quality, retrieval, sessions, structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_packer_fixture():
    # a block that is too long stands alone; a chunk begins with the last blocks that fit into the overlap
    assert list(blocks.pack_ranges([300, 150, 60, 20, 600, 40], 500, 100)) == [(0, 1), (1, 3), (2, 3), (3, 3), (4, 4), (5, 5)]


def slow_pack(lengths, size, overlap):
    start = 0
    while start < len(lengths):
        end, total = start + 1, lengths[start]
        while end < len(lengths) and total + 2 + lengths[end] <= size:
            total += 2 + lengths[end]
            end += 1
        yield start, end - 1
        if end == len(lengths):
            return
        fits = [k for k in range(start, end) if sum(lengths[k:end]) + 2 * (end - k - 1) <= overlap]
        back = min([end - 1, *fits])
        start = back if back > start else min(end, start + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=25))
def test_packer_covers_all_and_moves_on(lengths):
    found = list(blocks.pack_ranges(lengths, 500, 100))
    assert found == list(slow_pack(lengths, 500, 100))
    assert {k for a, b in found for k in range(a, b + 1)} == set(range(len(lengths)))
    assert all(x[0] < y[0] for x, y in zip(found, found[1:]))


def test_section_stack():
    assert structure.fold_levels([1, 2, -1, -1, 3, 2, 1]) == [(1, None), (2, 0), (3, 1), (3, 1), (3, 1), (2, 0), (1, None)]
    assert structure.fold_levels([6, -1]) == [(6, None), (6, 0)]


def test_bands(spark):
    rows = spark.createDataFrame([("d", 0.0, 0.1), ("d", 0.1, 0.2), ("d", 0.25, 0.3), ("d", 0.05, 0.28)], "k string, a double, b double")
    assert [tuple(r) for r in blocks.merge_intervals(rows, ["k"], "a", "b").select("a", "b", "n").collect()] == [(0.0, 0.3, 4)]
    apart = spark.createDataFrame([("d", 0.0, 0.1), ("d", 0.1, 0.2), ("d", 0.25, 0.3)], "k string, a double, b double")
    assert sorted(r.n for r in blocks.merge_intervals(apart, ["k"], "a", "b").collect()) == [1, 2]


def test_search_tokens_of_chinese(spark):
    assert one(spark, X.search_tokens(F.lit("图"))) == ["图", "图"]
    assert one(spark, X.search_tokens(F.lit("知识图谱"))) == ["知识图谱", "知识", "识图", "图谱"]
    assert one(spark, X.search_tokens(F.lit("知识图谱构建方法 v2")))[:2] == ["知识", "识图"]


def test_profile_and_regions(spark):
    assert one(spark, X.profile(F.lit("知识图谱"))) == "zh"
    assert one(spark, X.profile(F.lit("知识图谱 graph of"))) == "mixed"
    assert one(spark, X.region_text(F.lit("doc_title"), F.lit("## A title"))) == "# A title"
    assert one(spark, X.region_text(F.lit("text"), F.lit("(1)one\ntwo"))) == "(1) one\n\ntwo"


def test_headings(spark):
    lines = ["# Alpha", "1.2 Beta part", "1 Gamma", "plain text that is no heading.", "References", "", "（一）丁"]
    rows = spark.createDataFrame([(1, k, 0, k, t) for k, t in enumerate(lines)], "doc_id long, pos long, page long, idx long, content string")
    got = {r.pos: (r.is_heading, r.level, r.role, r.pattern) for r in structure.headings(rows).collect()}
    assert got[0] == (True, 1, "formal_section", "markdown")
    assert got[1] == (True, 2, "formal_section", "decimal")
    assert got[2] == (True, -1, "attached_subheading", "attached")
    assert got[3][0] is False and got[5] == (False, None, "text", "empty")
    assert got[4] == (True, 1, "formal_section", "common") and got[6][2] == "attached_subheading"


def test_equal_scores_normalise_to_zero(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.1), (2, 0.3)], "q int, s double")
    assert sorted(r.x for r in rows.select(retrieval.min_max(F.col("s"), "q").alias("x")).collect()) == [0.0, 0.0, 0.0, 1.0]


def test_repeated_query_terms_count_again(spark):
    items = spark.createDataFrame([(1, "a b"), (2, "a c")], "item_id long, text string")
    queries = spark.createDataFrame([(1, "b b")], "query_id long, question string")
    twice, once = (retrieval.bm25(items, queries, repeat_terms=r).first()["score"] for r in (True, False))
    assert twice == pytest.approx(2 * once)


def test_no_k_above_twenty(spark):
    hits = spark.createDataFrame([(1, k, 1.0 / (k + 1)) for k in range(40)], "query_id long, item_id long, score double")
    cover = hits.select("query_id", "item_id", F.lit(0.0).alias("coverage"))
    assert retrieval.hybrid(hits, hits, cover, k=30).count() == 20


def test_paths_prefer_the_direct_edge(spark):
    diamond = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("x", "z")], "src string, tgt string")
    pairs = spark.createDataFrame([("a", "d"), ("x", "z")], "a string, b string")
    assert sorted("".join(r.path) for r in graph.paths(diamond, pairs).collect()) == ["abd", "acd", "xz"]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "c")], "src string, tgt string")
    ends = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "a"), ("a", "q")], "a string, b string")
    assert sorted("".join(r.path) for r in graph.paths(chain, ends, 3).collect()) == ["abcd", "axcd", "dcba", "dcxa"] and graph.paths(chain, ends, 2).count() == 0


def test_names_and_noise(spark):
    assert graph.name_likeness("NMT", "Neural Machine Translation") == 0.95
    assert graph.name_likeness("graph", "knowledge graph") == 0.9
    noise = [one(spark, graph.is_noise(F.lit(n))) for n in ("x", "ab", "AB", "12.5", "<td>", "---", "good name", "However,", "et")]
    assert noise == [True, True, False, True, True, True, False, True, True]


def slow_merge(names, least=0.85):
    group = {}
    for k, a in enumerate(names):
        if a not in group:
            group[a] = a
            for b in names[k + 1 :]:
                if b not in group and graph.name_likeness(a, b) >= least:
                    group[b] = a
    return {n: min((m for m in names if group[m] == group[n]), key=lambda m: (-len(m), m)) for n in names}


def test_names_merge_as_in_one_pass(spark):
    r = random.Random(4)
    names = {"SVM", "support vector machine", "graph", "knowledge graph", "squad", "SQuAD", "ab", "cab", "neural net", "neural nets", "neural netz", "NN"}
    names |= {"".join(r.choice("abc ") for _ in range(r.randint(1, 9))).strip() or "z" for _ in range(60)}
    names = sorted(names)
    got = {x.name: x.merged for x in graph.merge_names(spark.createDataFrame([("t", n) for n in names], "type string, name string")).collect()}
    expected = slow_merge(names)
    assert got["SVM"] == got["support vector machine"] and got["graph"] == "knowledge graph"
    assert sum(got[n] == expected[n] for n in names) >= 0.97 * len(names)


def test_names_are_searched_in_tiers(spark):
    names = spark.createDataFrame([("BERT",), ("RoBERTa",), ("knowledge graph",), ("bart",)], "name string")
    queries = spark.createDataFrame([("bert",), ("berta",), ("edge in a knowledge graph of all",), ("zzz",)], "query string")
    got = {}
    for x in graph.search_names(names, queries).collect():
        got.setdefault(x.query, set()).add((x.name, x.score))
    assert got["bert"] == {("BERT", 1.0)} and {n for n, _ in got["berta"]} == {"BERT", "RoBERTa", "bart"} and "zzz" not in got
    assert got["edge in a knowledge graph of all"] in ({("knowledge graph", 0.7)}, {("knowledge graph", 0.638298)})


def test_nodes_keep_what_they_have(spark):
    old = spark.createDataFrame([("a", None, "x"), ("b", "n", None)], "id string, name string, note string")
    new = spark.createDataFrame([("a", "m", "y"), ("c", "k", None)], "id string, name string, note string")
    assert sorted(tuple(r) for r in graph.upsert_nodes(old, new).collect()) == [("a", "m", "x"), ("b", "n", None), ("c", "k", None)]


def test_evidence(spark):
    blocks_ = spark.createDataFrame([(1, 0, "graphs need edges and nodes")], "doc_id long, pos long, content string")
    cites = spark.createDataFrame([(7, 1, 0), (7, 9, 0)], "answer_id long, doc_id long, pos long")
    claims = spark.createDataFrame([(7, "graphs have nodes")], "answer_id long, claim string")
    resolved = evidence.resolve(cites, blocks_)
    got = evidence.consistency(resolved, evidence.support(claims, resolved).select("answer_id", "score")).first()
    assert (got.n_cited, got.n_invalid, got.exist_rate, got.score, got.missing_citation) == (2, 1, 0.5, 0.6667, False)


def test_routing_and_suppression(spark):
    kinds = [one(spark, sessions.classify(F.lit(q))) for q in ("Compare A with B", "the listed method", "what is it", "which of them")]
    assert kinds == ["comparison_qa", "method_qa", "fact_qa", "multi_evidence_qa"]
    assert one(spark, sessions.classify(F.lit("x"), F.lit(1))) == "local_evidence_qa"


def slow_suppress(page):
    """page: (idx, x1, y1, x2, y2, score, label)."""
    kept = []
    for r in sorted(page, key=lambda b: (-b[5], b[0])):
        for k in kept:
            w, h = min(r[3], k[3]) - max(r[1], k[1]) + 1, min(r[4], k[4]) - max(r[2], k[2]) + 1
            both, size = max(0, w) * max(0, h), lambda q: (q[3] - q[1] + 1) * (q[4] - q[2] + 1)
            if both / (size(r) + size(k) - both) >= (0.6 if r[6] == k[6] else 0.98):
                break
        else:
            kept.append(r)
    return {r[0] for r in kept}


def test_suppression_by_rounds(spark):
    r = random.Random(4)
    pages = {}
    for p in range(12):
        at = [r.randint(0, 30) for _ in range(3)]
        pages[p] = [(k, x := r.choice(at) + r.randint(0, 3), y := r.choice(at) + r.randint(0, 3), x + r.randint(15, 19), y + r.randint(15, 19), r.randint(1, 8) / 10, r.choice("ab")) for k in range(40)]
    pages[99] = [(k, k, 0, k + 20, 20, 1 - k / 100, "a") for k in range(30)]  # a chain of boxes, each covered by the one before
    df = spark.createDataFrame([(p, *b) for p, boxes in pages.items() for b in boxes], "page int, idx int, x1 int, y1 int, x2 int, y2 int, score double, label string")
    got = {}
    for x in quality.suppress(df, ("page",)).collect():
        got.setdefault(x.page, set()).add(x.idx)
    assert got == {p: slow_suppress(boxes) for p, boxes in pages.items()}
    assert quality.suppress(df.limit(0), ("page",)).collect() == []


def test_border_by_counting(spark):
    r = random.Random(5)
    rows = [(r.choice([0, 5, 10**15, 10**15 + 1, r.randint(-(10**6), 10**12)]), k) for k in range(500)]
    df, columns = spark.createDataFrame(rows, "t long, id long"), [F.col("t"), F.col("id")]
    ordered = sorted(rows)
    for nth in (0, 1, 250, 499):
        assert tuple(knowledge.nth_values(df, columns, nth)) == ordered[nth]
    for share in (0.0, 0.5, 0.999, 1.0):
        assert {tuple(x) for x in df.where(knowledge.later_share(df, columns, share)).collect()} == set(ordered[int(500 * share) :])
    assert df.limit(0).where(knowledge.later_share(df.limit(0), columns, 0.5)).collect() == []


def test_expansion_keeps_to_its_budget(spark):
    filled = spark.createDataFrame([(1, p, 0, p, "t", p == 0, 0) for p in range(6)], "doc_id long, pos long, page long, idx long, content string, is_heading boolean, section_pos long")
    seeds = spark.createDataFrame([(1, 1, 2, 0)], "query_id long, doc_id long, pos long, seed_rank long")
    assert [r.pos for r in context.expand(filled, seeds, 3).orderBy("rank").collect()] == [1, 3, 4]
    assert [r.pos for r in context.expand(filled, seeds, 3, "neighbor_first").orderBy("rank").collect()] == [1, 3, 4]
    with pytest.raises(ValueError):
        context.expand(filled, seeds, 3, "other")


def test_evidence_of_any_length_is_found(spark):
    texts = ["alpha beta gamma delta", "xalpha betay", "", "the beta", "beta", None]
    own = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    asked = {0: "alpha beta", 1: "beta", 2: "beta gamma delta", 3: "pha beta gam", 4: "zzz", 5: "alpha beta gamma delta", 6: "a  b", 7: None}
    rows = spark.createDataFrame(list(asked.items()), "query_id long, evidence string")
    got = {(r.query_id, r.item_id) for r in retrieval.holding(own, rows).collect()}
    assert got == {(q, i) for q, e in asked.items() for i, t in enumerate(texts) if e is not None and t is not None and e in t}


def test_batched_folds(spark):
    rows = spark.createDataFrame([(k % 7, k) for k in range(500)], "g long, v long").repartition(5)
    got = {r.g: (r.n, r.first) for r in folds.fold_groups(rows, ["g"], ["v"], lambda group: [(group[0][0], len(group), group[0][1])], "g long, n long, first long").collect()}
    assert got == {g: (len(range(g, 500, 7)), g) for g in range(7)} and folds.fold_groups(rows.where("false"), ["g"], ["v"], lambda g: [], "g long").count() == 0


def test_carrying_packer():
    for lengths in ([300, 150, 60, 20, 600, 40], [10] * 80, [700, 700], [5], []):
        found = list(blocks.carry_ranges(lengths, 500, 100))
        assert {k for a, b in found for k in range(a, b + 1)} == set(range(len(lengths))) and all(a <= b for a, b in found)


def slow_loop(text, least=10, times=10):
    import re

    n = len(text) // times
    m = re.search(r"(.{%d,%d}?)\1{%d,}" % (least, n, times - 1), text, re.DOTALL) if n >= least else None
    return (m.start(), len(m.group(1))) if m else None


def test_loops_are_cut():
    r = random.Random(3)
    for _ in range(150):
        unit = "".join(r.choice("ab\n") for _ in range(r.randint(3, 25)))
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 30))) + unit * r.randint(5, 14) + "tail"
        assert X.first_loop(text) == slow_loop(text), repr(text)
    for _ in range(300):  # several loops of few letters, whose units are made of shorter ones
        text = "".join("".join(r.choice("abc") for _ in range(r.choice([1, 2, 3, 7, 9, 10, 11, 19, 20, 21, 40]))) * r.randint(1, 24) + r.choice(["", "a", "bca"]) for _ in range(r.randint(1, 4)))
        assert X.first_loop(text) == slow_loop(text), repr(text)
    began = time.perf_counter()
    half = "".join(r.choices("ab", k=60_000))
    assert X.first_loop("x" + half * 9) is None and X.first_loop("x" * 5 + half * 11) == (5, 60_000) and X.first_loop("a" * 1_000_000) == (0, 10)
    assert time.perf_counter() - began < 3
    lines = "intro\n" + "same line\n" * 20 + "end"
    assert X.without_loop(lines).count("same line") == 1 and X.without_loop("a b c") == "a b c" and X.without_loop("") == ""
    short = "intro\n" + "x\n\n" * 30
    assert X.without_loop("q\n" + "x\ny\n" * 3) == "q\n" + "x\ny\n" * 3 and X.without_loop(short) != short


def test_mojibake_is_read_again(spark):
    assert X.repaired("知识图谱".encode().decode("latin1")) == "知识图谱" and X.repaired("plain") == "plain"
    rows = spark.createDataFrame([("知识".encode().decode("latin1"),), (None,), ("ascii",)], "t string")
    assert [x.t for x in rows.select(X.repair_mojibake(F.col("t")).alias("t")).collect()] == ["知识", None, "ascii"]


def test_lines_of_boxes():
    boxes = [(0, 0, 0, 100, 20), (1, 110, 2, 200, 22), (2, 500, 0, 600, 20), (3, 0, 40, 90, 60)]
    assert layout.group_lines(boxes) == [[0, 1], [2], [3]] and layout.group_lines([]) == []


def test_merges_of_blocks(spark):
    text = lambda *parts: [(k, "text", t) for k, t in enumerate(parts)]
    assert layout.join_hyphens(text("an exam-", "ple of it", "next")) == [(0, "text", "an example of it"), (2, "text", "next")]
    assert layout.join_hyphens(text("an exam-", "Ple of it")) == text("an exam-", "Ple of it") and layout.join_hyphens(text("x-", "1y")) == text("x-", "1y")
    skipped = [(0, "text", "exam-"), (1, "table", "t"), (2, "text", "ple")]
    assert layout.join_hyphens(skipped) == [(0, "text", "example"), (1, "table", "t")]
    f = lambda t, label="formula": (label, t)
    numbered = lambda *b: [(k, label, t) for k, (label, t) in enumerate(b)]
    assert layout.tag_formulas(numbered(f("$$\nE\n$$"), f("(1)", "formula_number"))) == [(0, "formula", "$$\nE \\tag{1}\n$$")]
    assert layout.tag_formulas(numbered(f("（2）", "formula_number"), f("$$\nE\n$$"), f("x", "text"))) == [(1, "formula", "$$\nE \\tag{2}\n$$"), (2, "text", "x")]
    assert layout.tag_formulas(numbered(f("(3)", "formula_number"))) == [] and layout.tag_formulas(numbered(f("$E$"), f("4", "formula_number"))) == [(0, "formula", "$E$")]
    bullets = [(0, "text", "- a", 0.0), (1, "text", "b", 5.0), (2, "text", "- c", 0.0), (3, "text", "d", 50.0), (4, "text", "- e", 0.0)]
    assert [t for _, _, t, _ in layout.fill_bullets(bullets)] == ["- a", "- b", "- c", "d", "- e"]
    rows = spark.createDataFrame([(1, 0, 0, "text", "exam-", 0), (1, 0, 1, "text", "", 0), (1, 0, 2, "text", "ple", 0), (1, 0, 3, "formula", "$$\nE\n$$", 0), (1, 0, 4, "formula_number", "(1)", 0)], "doc_id long, page long, idx long, label string, content string, x1 int")
    got = [(r.idx, r.content) for r in layout.merged_blocks(rows).orderBy("idx").collect()]
    assert got == [(0, "exam-"), (1, "ple"), (2, "$$\nE \\tag{1}\n$$")]


def test_strict_headings(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, "1.2 Beta part\nmore"), (1, 1, 0, 1, "1.3 Table head"), (1, 2, 0, 2, "1 Gamma")], "doc_id long, pos long, page long, idx long, content string")
    found, doubtful = structure.strict_headings(rows, F.when(F.col("pos") == 1, "table").otherwise("text"), least=0.8)
    assert {r.pos: r.is_heading for r in found.collect()} == {0: True, 1: False, 2: True} and [r.pos for r in doubtful.collect()] == [2]


def test_context_groups_and_order(spark):
    hits = spark.createDataFrame([(1, k % 3, k, k + 1) for k in range(9)] + [(1, 0, 0, 10)], "query_id long, doc_id long, pos long, rank long")
    assert [r.group for r in context.split_groups(hits).orderBy("rank").collect()] == ["current"] * 4 + ["support"] * 3
    assert [(r.doc_id, r.pos, r.place) for r in context.in_document_order(hits).orderBy("place").collect()][:4] == [(0, 0, 1), (0, 3, 2), (0, 6, 3), (1, 1, 4)]


def test_rescoring(spark):
    rows = spark.createDataFrame([("q", "in 1999 there were 5 %", "1999 and 7", "5"), ("q", "abc", "abd", ""), ("q", "", "", "")], "question string, answer string, gold string, cited_text string")
    got = [(r.n_facts, r.key_fact_f1, r.groundedness) for r in evaluation.rescored(rows).collect()]
    assert got == [(2, 0.5, 0.35), (1, 0.0, 0.0), (0, 1.0, 0.0)]
