"""Search of a graph's nodes by words, against a slow version of the rule."""

import random
from difflib import SequenceMatcher

from docspark.operators import graph


def slow_search(names, word, fuzzy):
    """node -> score of one word; names: node -> name."""
    low = {i: n.lower().strip() for i, n in names.items()}
    if out := {i: 1.0 for i, n in low.items() if n == word}:
        return out
    if fuzzy and (out := {i: r for i, n in low.items() if (r := SequenceMatcher(None, word, n).ratio()) >= 0.6}):
        return out
    return {i: 0.7 for i, n in low.items() if word in n or n in word}


def slow_candidates(names, edges, query, fuzzy):
    score = {}
    for word in query.lower().split():
        if len(word) >= 2:
            for i, s in slow_search(names, word, fuzzy).items():
                score[i] = max(score.get(i, 0), round(s, 6))
    out = []
    for rank, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:10], 1):
        near = {}
        for a, b, r, c in sorted(edges, key=lambda e: (-e[3], e[2])):
            for x, y in ((a, b), (b, a)):
                if x == i and y != i:
                    near.setdefault(y, (r, c))
        first = sorted(near, key=lambda y: (-near[y][1], y))[:5]
        out += [(rank, i, score[i], k, y, *near[y]) for k, y in enumerate(first, 1)] or [(rank, i, score[i], None, None, None, None)]
    return out


def test_keyword_candidates(spark):
    rng = random.Random(1)
    words = ["bert", "BERT base", "roberta", "squad", "SQuAD 2.0", "f1", "rouge", "attention", "Self-Attention", "知识图谱", "graph", "a", "em"]
    names = {f"n{k}": rng.choice(words) + rng.choice(["", " x", "s"]) for k in range(80)}
    names["twin"] = names["n0"]
    edges = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}", rng.choice(["USES", "PART_OF"]), rng.choice([0.3, 0.5, 0.9])) for _ in range(200)]
    queries = {k: " ".join(rng.choices([*words, "berts", "squadd", "unknownword", "g"], k=4)) for k in range(20)} | {97: "", 98: "x", 99: "  squad\tSQUAD "}
    nodes = spark.createDataFrame(list(names.items()), "id string, name string")
    asked = spark.createDataFrame([*queries.items(), (100, None)], "query_id long, query string")
    links = spark.createDataFrame(edges, "src string, tgt string, relation string, confidence double")
    for fuzzy in (True, False):
        got = {}
        for r in graph.keyword_candidates(nodes, links, asked, fuzzy=fuzzy).collect():
            got.setdefault(r.query_id, set()).add((r.rank, r.id, round(r.score, 6), r.place, r.neighbour, r.relation, r.confidence))
        assert got == {k: set(e) for k, q in queries.items() if (e := slow_candidates(names, edges, q, fuzzy))}
    assert graph.keyword_candidates(nodes.limit(0), links, asked).collect() == []


def test_neighbours_of_one_relation(spark):
    links = spark.createDataFrame([("a", "b", "USES", 0.5), ("b", "a", "PART_OF", 0.9), ("a", "c", "PART_OF", 0.2), ("a", "a", "USES", 1.0), ("c", "d", "USES", 1.0)], "src string, tgt string, relation string, confidence double")
    a = spark.createDataFrame([("a",), ("a",)], "node string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(graph.neighbours(links, a)) == [("a", "b", "PART_OF", 0.9), ("a", "c", "PART_OF", 0.2)]
    assert rows(graph.neighbours(links, a, "USES")) == [("a", "b", "USES", 0.5)]


def test_centres(spark, monkeypatch):
    nodes = spark.createDataFrame([("doc_2", "Second"), ("doc_1", "second"), ("doc_10", None), ("x", "the second one")], "id string, name string")
    queries = [("SECOND ",), ("doc_1",), ("doc",), ("cond",), ("one",), ("nothing",), (" ",), (None,)]
    expected = {"SECOND ": "doc_1", "doc_1": "doc_1", "doc": "doc_1", "cond": "doc_1", "one": "x", "nothing": "root", " ": "root", None: "root"}
    for block in (1000, 2):
        monkeypatch.setattr(graph, "QUERY_BLOCK", block)
        assert {r.query: r.node for r in graph.centres(nodes, spark.createDataFrame(queries, "query string"), "root").collect()} == expected
