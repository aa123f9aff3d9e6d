"""Candidates of the matcher: no pair is passed over."""

import random
from difflib import SequenceMatcher

import pytest

from docspark.operators import graph


@pytest.mark.parametrize("least", [0.7, 0.75, 0.8, 0.85, 0.9, 0.95])
def test_alike_names_share_a_run(least):
    """The bound on runs, for pairs made alike by few letters between common blocks."""
    rng = random.Random(int(least * 100))
    size, shorter = graph.gram_sizes(least)
    tight = 0
    for _ in range(20_000):
        blocks = ["".join(rng.choices("abcdefghij", k=rng.randrange(max(1, size - 2), size + 2))) for _ in range(rng.randrange(1, 9))]
        a = b = ""
        for block in blocks:
            more = rng.choice("xyz")
            a, b = (a + block + more, b + block) if rng.random() < 0.5 else (a + block, b + block + more)
        if SequenceMatcher(None, a, b).ratio() < least:
            continue
        n = shorter.get(len(a) + len(b), size)
        run = SequenceMatcher(None, a, b).find_longest_match().size
        assert run >= n, (a, b)
        tight += run == n
    assert tight > 3 or least > 0.9  # the bound is reached


def test_gram_sizes():
    assert graph.gram_sizes(0.85) == (3, {2: 1, 4: 2, 7: 2, 9: 2, 14: 2})
    for least in (0.7, 0.8, 0.85, 0.9):
        size, shorter = graph.gram_sizes(least)
        assert all(graph.shared_run(t, least) in (0, shorter.get(t)) or graph.shared_run(t, least) >= size for t in range(2, 3000))


def names_of(rng, n):
    """Words with few letters, and names made of others by small edits, initials and parts."""
    out = set()
    while len(out) < n:
        name = " ".join("".join(rng.choices("abcde", k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4)))
        out.add(name)
        letters = list(name)
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(letters))
            letters[k : k + rng.randrange(2)] = [rng.choice("abcdexyzé 中")]
        out |= {"".join(letters).strip() or "a", "".join(w[0] for w in name.split()).upper(), name[: rng.randrange(1, len(name) + 1)].strip() or "b"}
    return sorted(out)[:n]


def greedy(names, least=0.85):
    """Groups by the likeness to their first name; the longest name stands for a group."""
    groups, used = [], set()
    for i, a in enumerate(names):
        if a in used:
            continue
        group = [a] + [b for b in names[i + 1 :] if b not in used and graph.name_likeness(a, b) >= least]
        used |= set(group)
        groups.append(group)
    return {n: min(g, key=lambda x: (-len(x), x)) for g in groups for n in g}


def test_name_merge_equals_all_pairs(spark):
    names = names_of(random.Random(3), 2000)
    rows = spark.createDataFrame([("t", n) for n in names] + [("u", n) for n in names[:50]], "type string, name string")
    links = {(r.a, r.b) for r in graph.like_names(rows).where("type = 't'").collect()}
    assert links == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if graph.name_likeness(a, b) >= 0.85}
    assert {r.name: r.merged for r in graph.merge_names(rows).where("type = 't'").collect()} == greedy(names)


def test_names_with_a_common_end(spark, monkeypatch):
    """Nearly all names share runs of letters: pairs are bounded within blocks, and few come to the matcher."""
    monkeypatch.setattr(graph, "LIKE_BLOCK", 100)
    rng = random.Random(6)
    names = sorted({" ".join("".join(rng.choices("aeioumnrst", k=rng.randrange(2, 9))) for _ in range(rng.randrange(1, 3))).title() + " Neural Net" for _ in range(400)} | {"NN", "x" * 70, "x" * 69 + "y", "z" * 300})
    asked = []
    matcher = graph.name_likeness
    expected = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if matcher(a, b) >= 0.85}
    monkeypatch.setattr(graph, "name_likeness", lambda a, b: asked.append(1) or matcher(a, b))
    assert {(names[i], names[j]) for i, j in graph.like_pairs(names, None, 0.85)} == expected
    assert len(asked) < 3 * len(expected) + 1000 < len(names) ** 2 / 20
    monkeypatch.setattr(graph, "name_likeness", matcher)
    got = [(r.a, r.b) for r in graph.like_names(spark.createDataFrame([("t", n) for n in names], "type string, name string")).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_node_search_equals_all_pairs(spark, monkeypatch):
    names = names_of(random.Random(4), 2000)
    asked = [*names_of(random.Random(5), 60), names[7].upper(), " " + names[9], "", "zzzz", None]
    for limits in ((20_000, 1000), (300, 20)):
        monkeypatch.setattr(graph, "NAMES_BLOCK", limits[0])
        monkeypatch.setattr(graph, "QUERY_BLOCK", limits[1])
        got = {(r.query, r.name): r.score for r in graph.search_names(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), spark.createDataFrame([(q,) for q in asked], "query string")).collect()}
        expected = {}
        for q in {a.lower().strip() for a in asked if a is not None}:
            tiers = {}
            for name in names:
                low = name.lower().strip()
                ratio = 1.0 if q == low else SequenceMatcher(None, q, low).ratio()
                tiers.setdefault(0 if q == low else 1 if ratio >= 0.6 else 2 if q in low or low in q else 3, []).append((name, ratio))
            best = min(tiers)
            if best < 3:
                expected |= {(q, name): 0.7 if best == 2 else round(ratio, 6) for name, ratio in tiers[best]}
        assert got == pytest.approx(expected)
