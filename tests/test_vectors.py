"""Exact vector search by cells, against all pairs."""

import numpy as np
import pytest

from docspark.operators import vectors as V


def frame(spark, rows, names):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in rows], f"{names[0]} long, {names[1]} array<float>").repartition(3)


def slow(rows, asked, k, cosine):
    out = {}
    unit = lambda x: x / n if (n := np.sqrt(x @ x)) else x
    for q, x in asked:
        x = np.asarray(x, np.float32).astype(float)
        scores = []
        for i, v in rows:
            v = np.asarray(v, np.float32).astype(float)
            scores.append((-round(float(unit(x) @ unit(v) if cosine else x @ v), 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("cosine", [False, True])
def test_equal_to_all_pairs(spark, cosine, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(k, centres[k % 12] * (1 if cosine else 1 + k % 3) + rng.normal(size=8) * 0.05) for k in range(900)]
    rows += [(900, np.zeros(8)), *[(901 + k, rows[5][1]) for k in range(15)]]  # a vector of length 0, and ties
    asked = [(k, rows[k * 40][1]) for k in range(20)] + [(90, np.zeros(8)), (91, rng.normal(size=8)), (92, rows[5][1])]
    monkeypatch.setattr(V, "TASK_VECTORS", 50)
    monkeypatch.setattr(V, "TASK_QUERIES", 7)
    cells = V.deal(frame(spark, [*rows, (5000, None)], ("item_id", "v")), cosine)
    found, pairs = V.search(cells, frame(spark, [*asked, (99, None)], ("query_id", "q")), 10)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, r.score))
    expected = slow(rows, asked, 10, cosine)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
    assert all(s == pytest.approx(t, abs=2e-6) for q in got for (_, s), (_, t) in zip(got[q], expected[q]))
    share = V.compared_share(cells, pairs, len(asked))
    assert share < 0.5 if cosine else share <= 1  # cells of like vectors are ruled out


def test_few_vectors(spark):
    rows, asked = [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(1, [1.0, 1.0]), (2, [2.0, 0.0])]
    one = frame(spark, rows, ("item_id", "v"))
    got = {(r.query_id, r.rank): (r.item_id, r.score) for r in V.search(V.deal(one), frame(spark, asked, ("query_id", "q")), 5)[0].collect()}
    assert got == {(1, 1): (1, 1.0), (1, 2): (2, 1.0), (2, 1): (1, 2.0), (2, 2): (2, 0.0)}
    assert V.search(V.deal(one.limit(0)), frame(spark, asked, ("query_id", "q")), 5)[0].collect() == []
    assert V.search(V.deal(one), frame(spark, asked, ("query_id", "q")).limit(0), 5)[0].collect() == []
