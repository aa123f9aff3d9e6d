"""Each operator on small tables: against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docspark.llm import attention, chat, licenses, lm, media, minhash, mixing, near_copies, packing, quality, simhash, token_counts
from docspark.llm.subwords import distinct_words, encode_words, memo, tokenizer, word_bytes, word_vocabulary

WORDS = "the of and sea ship wind harbour stone river night lamp road garden winter song letter".split()


def text_of(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


BASE = [text_of(k) for k in range(30)]
ODD = [
    (0, BASE[0], "a"), (1, BASE[0], "b"), (2, None, "a"), (3, "", None), (4, " \t\n", "b"), (5, BASE[1], None), (6, BASE[1] + " extra", "a"), (7, "Été œuvre 日本 €uro", "c"),
    (8, text_of(99, 20_000), "a"), (8, BASE[2], "a"), (8, BASE[2], "a"), (9, "one", "b"), (10, "x" * 70_000, "c"), *[(11 + k, t, "abc"[k % 3]) for k, t in enumerate(BASE[3:])],
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(*r, "clash", 1.5, "row") for r in ODD], "doc_id long, text string, source string, n_tokens string, score double, fp string")
    return rows.withColumn("place", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.mark.parametrize("seed", range(20))
def test_words_through_arrow_are_those_of_plain_splitting(seed):
    rng = random.Random(seed)
    texts = [None if rng.random() < 0.1 else "".join(rng.choices(" \t\n\x0b\x0c\r\x1cAb\u00e9\x85. ", k=rng.randrange(30))) for _ in range(rng.randrange(1, 8))]
    for column, plain in ((pa.array(texts, pa.string()), texts), (pa.array(texts, pa.string())[1:], texts[1:])):
        length, names, which = distinct_words(column)
        want, words = [(t or "").encode().lower().split() for t in plain], word_bytes(names)
        assert length.tolist() == [len(w) for w in want]
        assert [words[k] for k in which] == [w for ws in want for w in ws] and len(set(words)) == len(words)


def test_punctuation_of_all_kinds_after_letters_is_encoded_as_the_library_does():
    rng = random.Random(4)
    words = {"".join(rng.choices("abc\u00e9'\u00dfSTRE", k=rng.randrange(5))) + rng.choice(["", "s", "t", "re"]) + "".join(rng.choices("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~", k=rng.randrange(5))) for _ in range(3000)} - {""}
    known = memo(word_vocabulary())
    for word, ids in zip(words, known.packed([w.encode() for w in words])):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer(word_vocabulary()).encode(word, add_special_tokens=False).ids



def test_tokens_of_words_are_those_of_texts():
    r, letters = random.Random(1), "aAbé ̈'sS \n\t.,!1٣日ßİΣ ​|<>한"
    texts = [t or "" for _, t, _ in ODD if len(t or "") < 9000] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += ["don't <|endoftext|>x", "we're.'s 'S", "é", "ﬁn"]
    got = encode_words(memo(word_vocabulary()), [t.encode() for t in texts])
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == tokenizer(word_vocabulary()).encode(t, add_special_tokens=False).ids, t


def spliced(text, chunk, overlap):
    parts = list(token_counts.spliced(memo(word_vocabulary()), word_vocabulary(), text.encode(), chunk, overlap))
    return np.frombuffer(b"".join(b"".join(p) for p in parts), "<u4").tolist(), len(parts)


@pytest.mark.parametrize("chunk, overlap", [(16, 1), (40, 8), (400, 8), (1000, 64)])
def test_spliced_chunks_are_the_whole(chunk, overlap):
    r, letters = random.Random(chunk), "aAbé ̈'sS \n\t.,!1٣日ßİΣ ​|<>한0987"
    texts = [text_of(5, 900), "y" * 3000 + " a " + "z" * 5000, "ab " * 3000, "no-space," * 500, "x", "", "日本語" * 900, "a1" * 2000, "<|endoftext|>" * 200, "'s't" * 300, "\u0301" * 50 + "1\u0301" * 99]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 300))) for _ in range(300)]
    for t in texts:
        assert spliced(t, chunk, overlap)[0] == tokenizer(word_vocabulary()).encode(t, add_special_tokens=False).ids, t
    assert spliced(text_of(5, 900), chunk, overlap)[1] > len(text_of(5, 900)) / chunk - 1


def test_work_on_text_without_boundaries_is_in_proportion(monkeypatch):
    done = []
    real = token_counts.encoded
    monkeypatch.setattr(token_counts, "encoded", lambda words, path, chunk: done.append(len(chunk)) or real(words, path, chunk))
    for t in ("qz" * 30_000, "qz" * 20_000 + " and " + "zq" * 20_000, "Ab3+/x9" * 30_000):
        done.clear()
        assert spliced(t, 4096, 128)[0] == tokenizer(word_vocabulary()).encode(t, add_special_tokens=False).ids
        assert sum(done) < 8 * len(t)


@pytest.mark.parametrize("chunk, overlap", [(1, 1), (100, 0), (100, 51), (100, -1)])
def test_chunks_that_cannot_be_spliced_are_refused(odd, chunk, overlap):
    with pytest.raises(ValueError):
        token_counts.count_tokens(odd, chunk=chunk, overlap=overlap)


def test_token_counts(odd, none):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd).collect())
    expected = Counter()
    for i, t, _ in ODD:
        n = len(tokenizer(word_vocabulary()).encode(t or "", add_special_tokens=False).ids)
        expected[(i, len((t or "").encode()), n, n > 2048)] += 1
    assert got == expected and token_counts.count_tokens(none).count() == 0


def test_license_templates():
    made = [licenses.compile_template(n, t, w) for n, (w, t) in licenses.TEMPLATES.items()]

    def labels(text):
        words = licenses.words_of(text.encode())
        return [m[0] for m in licenses.find_licenses(words, b" " + b" ".join(words) + b" ", made)]

    assert labels("This is LICENSED under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("licensed under the GNU Lesser General Public License 3") == []
    assert labels("Licensed under CC BY-NC-SA 4.0 and released under the MIT License") == ["cc-by-nc-4.0", "mit-notice"]
    whole = licenses.TEMPLATES["mit"][1].replace("<<var holder 1-12>>", "the authors").replace("<<optional>>", "").replace("<<end>>", "")
    assert labels(whole) == ["mit"] and labels(whole.replace("WARRANTY", "PROMISE")) == []
    for bad in ("<<optional>>a", "a<<end>>", "<<var x 0-2>> a", ""):
        with pytest.raises(ValueError):
            licenses.compile_template("bad", bad)


def test_license_scan(spark, none):
    texts = ["GNU general PUBLIC license. cc by cc by", None, "", "the mit-license; Apache License", "nocc by", "é cc\nBY"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, sorted((b.word, b.label) for b in r.base)) for r in licenses.scan_licenses(rows).collect()}
    assert got == {0: (8, [(0, "gpl"), (4, "cc-by"), (6, "cc-by")]), 1: (0, []), 2: (0, []), 3: (5, [(1, "mit"), (3, "apache")]), 4: (2, []), 5: (3, [(1, "cc-by")])}
    assert licenses.scan_licenses(none).count() == 0


def test_quality(spark, odd, none):
    good, bad = [text_of(k) for k in range(200)], [" ".join(w + "!!" for w in text_of(k).split()) for k in range(200)]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(good)] + [(1000 + k, t, 2) for k, t in enumerate(bad)] + [(5000, None, 1), (5001, "", 1)], "doc_id long, text string, held_out int")
    marks = spark.createDataFrame([(k, 1) for k in range(200)] + [(1000 + k, 0) for k in range(200)] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    got = quality.score_quality(rows, quality.fit_quality(rows, marks)).collect()
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(held) > 50
    assert sum((r.score > 0.5) == (r.doc_id < 1000) for r in held) / len(held) > 0.98
    assert len({r.score for r in got if r.doc_id >= 5000}) == 1
    empty = quality.fit_quality(none, marks)
    assert empty.constant and {r.score for r in quality.score_quality(odd, empty).collect()} == {0.5}


def test_dual_coordinate_descent_finds_the_least_loss():
    """No small step from the solution lowers the regularised hinge loss; ratios are log ratios of smoothed counts."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 30, rng.integers(2, 9))) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    ratio = rng.standard_normal(30)
    weight, bias = quality.dual_coordinate_descent(rows, y, ratio, 1.0, 2000)

    def loss(w, b):
        margins = np.array([w[r] @ (ratio[r] / np.linalg.norm(ratio[r])) + b for r in rows])
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * margins).sum()

    least = loss(weight, bias)
    for scale in (1e-3, 1e-2, 0.1):
        for _ in range(200):
            step = rng.standard_normal(31) * scale
            assert loss(weight + step[:30], bias + step[30]) > least - 2e-3
    model = quality.Model([np.array([k % 7, 9]) for k in range(80)], np.array([k % 7 < 3 for k in range(80)], float))
    fit = [k for k in range(80) if k % 4 != 3]
    count = lambda f, good: 1 + sum((k % 7 == f or f == 9) and (k % 7 < 3) == good for k in fit)
    total = {good: sum(2 for k in fit if (k % 7 < 3) == good) + (1 << quality.BITS) for good in (True, False)}
    expected = math.log(count(2, True) / total[True]) - math.log(count(2, False) / total[False])
    assert model.square[2] == pytest.approx(expected**2, rel=1e-4) and model.square[1000] == 0


def test_quality_and_licenses_of_odd_rows(odd):
    model = quality.Model([np.array([k % 7]) for k in range(80)], np.array([k % 2 for k in range(80)], float))
    scored = quality.score_quality(odd, model, keep=("score", "place")).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 and r.kept.score == 1.5 for r in scored)
    found = licenses.scan_licenses(odd).collect()
    words = lambda t: len([w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t or "").split()])
    assert Counter((r.doc_id, r.n_words) for r in found if r.doc_id != 7) == Counter((i, words(t)) for i, t, _ in ODD if i != 7)


def brute_simhash(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    prints = {}
    for i, t, _ in ODD:
        prints.setdefault(brute_simhash(t), []).append(i)
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((i, brute_simhash(t)) for i, t, _ in ODD)
    root = roots(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    smallest = {}
    for p, ids in prints.items():
        smallest[root[p]] = min(smallest.get(root[p], 10**9), min(ids))
    assert all(r.component_id == smallest[root[r.fp % 2**64]] for r in got)
    assert simhash.near_duplicates(none).count() == 0


def test_ball_links_lose_no_connection(spark):
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(20)]
    values = set(seeds)
    for s in seeds:
        for _ in range(15):
            v = s
            for b in r.sample(range(64), r.randint(1, 4)):
                v ^= 1 << b
            values.add(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = simhash.ball_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    found = {r.node: r.root for r in simhash.components(links).collect()}
    root = roots(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2])
    groups, mine = {}, {}
    for v in signed:
        groups.setdefault(root[v], set()).add(v)
        mine.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_chain(spark):
    ids = list(range(60))
    random.Random(5).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {r.root for r in simhash.components(links).collect()} == {0}


def test_one_of_each_group_stays(spark, odd):
    words = text_of(50, 300).split()
    near = words[:]
    near[100] = "changed"
    rows = spark.createDataFrame([(5, " ".join(words), "a"), (3, " ".join(near), "b"), (4, text_of(51, 300), "c"), (4, text_of(51, 300), "d"), (9, None, "e"), (None, "", "f")], "doc_id long, text string, tag string")
    got = near_copies.without_near_duplicates(rows).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 3), (False, 4), (True, 0)]
    kept = near_copies.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({t or "" for _, t, _ in ODD if (t or "").strip()} - {BASE[1] + " extra"}) + 1


def shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def altered(r, words, kind, share):
    """The words with about `share` of their length cut, appended, replaced as a block, or replaced here and there."""
    fresh, n = lambda k: [f"new{r.randint(0, 10**9)}" for _ in range(k)], len(words)
    k = max(1, round(n * share))
    if kind == "cut":
        return words[: n - k]
    if kind == "append":
        return words + fresh(k)
    if kind == "block":
        at = r.randint(0, n - k)
        return words[:at] + fresh(k) + words[at + k :]
    out = words[:]
    for at in r.sample(range(n), max(1, k // 5)):
        out[at] = fresh(1)[0]
    return out


def test_near_duplicates_of_all_kinds_of_edits_are_found_and_no_others(spark):
    r, rows, pairs = random.Random(7), [], {}
    jaccard = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    for k in range(240):
        kind, words = ("cut", "append", "block", "scattered")[k % 4], text_of(1000 + k, r.randint(80, 500)).split()
        one, two = " ".join(words), " ".join(altered(r, words, kind, r.uniform(0.02, 0.22)))
        rows += [(2 * k, one), (2 * k + 1, two)]
        pairs[k] = kind, jaccard(one, two)
    kept = {x.doc_id for x in near_copies.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in pairs)
    for kind in ("cut", "append", "block", "scattered"):
        alike = [k for k, (x, j) in pairs.items() if x == kind and 0.8 <= j <= 0.9]
        assert len(alike) >= 10 and sum(2 * k + 1 not in kept for k in alike) >= 0.98 * len(alike), kind
    assert all(2 * k + 1 in kept for k, (_, j) in pairs.items() if j < 0.8)


def test_rows_are_told_apart_by_more_than_their_id(spark):
    texts = [text_of(3000 + k, 80) for k in range(4)]
    rows = [(None, texts[0], "x"), (None, texts[1], "x"), (7, texts[2], "x"), (7, texts[3], "x"), (8, texts[3], "y"), (9, texts[0], "z"), (7, texts[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = [tuple(r) for r in near_copies.without_near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(rows[:4], key=str)
    assert near_copies.without_near_duplicates(df.where("false")).collect() == []


@pytest.mark.parametrize("pairs", [0, 50, 10**9])
def test_near_copies_that_no_centre_joins_are_linked(spark, monkeypatch, pairs):
    """One value holds 40 texts that have nothing else in common, among them pairs of near copies, none of which is the group's centre."""
    monkeypatch.setattr(near_copies, "GROUP_PAIRS", pairs)
    texts = [text_of(2000 + k, 120) for k in range(40)]
    for a, b in ((5, 30), (6, 31), (6, 32), (39, 1)):
        texts[b] = texts[a] + f" and more {b}"
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "id long, row long, text string")
    marked = near_copies.signatures(rows).withColumn("bands", F.transform("bands", lambda x, k: F.when(k == 0, F.lit(7).cast("long")).otherwise(x)))
    number = {r.node: r.id for r in marked.collect()}
    links = near_copies.similar_links(marked.select("node", "row", "size", "bands"), rows).collect()
    found = roots(range(40), [(number[x.a], number[x.b]) for x in links])
    expected = roots(range(40), [(30, 5), (31, 6), (32, 6), (39, 1)])
    same = lambda of: {(a, b) for a in range(40) for b in range(a) if of[a] == of[b]}
    assert same(found) == same(expected)


def test_near_copies_against_all_pairs(spark):
    """Groups of copies of copies, so that links chain: components are those of all pairs 0.8 alike."""
    r, texts = random.Random(11), []
    for k in range(12):
        own = [text_of(4000 + k, r.randint(60, 200)).split()]
        for _ in range(12):
            own.append(altered(r, r.choice(own), r.choice(("cut", "append", "block", "scattered")), r.uniform(0.02, 0.2)))
        texts += [" ".join(w) for w in own]
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = set(roots(range(len(texts)), links).values())
    got = {x.doc_id for x in near_copies.without_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert expected <= got and len(got - expected) <= 1


def test_fingerprints(odd, none):
    got = minhash.fingerprint_documents(odd).collect()
    rows = sorted(((i, t or "") for i, t, _ in ODD), key=lambda r: (r[0], r[1].encode()))
    after = [rows[(k + 1) % len(rows)][1] for k in range(len(rows))]
    expected = Counter()
    likeness = {}
    for (i, t), n in zip(rows, after):
        half = len(t) // 2
        new = t[: len(t) - half] + n[:half]
        digest = hashlib.sha256(new.encode()).hexdigest()
        expected[(i, len(t), digest)] += 1
        likeness[(i, digest)] = len(shingles(t) & shingles(new)) / len(shingles(t) | shingles(new))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    assert all(abs(r.near_edited - likeness[(r.doc_id, r.edited_sha256)]) < 0.2 for r in got)
    prints = {(r.doc_id, r.n_chars): r.fingerprint for r in got}
    assert prints[(0, len(BASE[0]))] == prints[(1, len(BASE[0]))] and prints[(2, 0)] == prints[(3, 0)] and len({len(p) for p in prints.values()}) == 1
    assert minhash.fingerprint_documents(none).count() == 0
    alone = minhash.fingerprint_documents(odd.where("doc_id = 9")).first()
    assert alone.near_next == 1.0


def spark_hash(*values):
    """What xxhash64 gives, as an unsigned number."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True), h)
    return h


def brute_fingerprint(text, bins=256):
    """One permutation, smallest hash of each bin; an empty bin looks along its order until it meets a full one."""
    words = (text or "").lower().encode().split()
    hashes = {spark_hash(*words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    full = {}
    for h in sorted(hashes, reverse=True):
        full[h // (2**64 // bins)] = h & 255
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    out = []
    for i in range(bins):
        step, j = signed(spark_hash(i, "step")) % (bins // 2) * 2 + 1, signed(spark_hash(i, "begin")) % bins
        own = i
        while own not in full:
            own, j = j, (j + step) % bins
        out.append(full[own])
    return bytes(out).hex()


def test_fingerprints_against_brute_force(spark):
    texts = [None, "", "one", "a b c d e f", *[text_of(k, n) for k, n in enumerate((7, 12, 20, 40, 90, 300, 2000))]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.f for r in rows.select("doc_id", minhash.fingerprint(F.coalesce("text", F.lit(""))).alias("f")).collect()}
    assert got == {k: brute_fingerprint(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["{}", "doc-{:07d}", "é{:x}"])
def test_next_document_over_many_ranges(spark, name):
    ids = [name.format(i) for i in random.Random(2).sample(range(10**6), 500)]
    if name == "{}":
        ids = list(map(int, ids))
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], f"doc_id {'long' if name == '{}' else 'string'}, text string").repartition(4)
    got = {r.doc_id: r.next_text for r in minhash.with_next(rows, ["text"], range_docs=40).collect()}
    ordered = sorted(ids, key=lambda i: i if isinstance(i, int) else i.encode())
    assert got == {a: f"t{b}" for a, b in zip(ordered, ordered[1:] + ordered[:1])}


def brute_targets(sizes):
    sources = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)}
    left, total, out = set(sources), float(sum(sizes.values())), {}
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in left}
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= over
    return out


def test_mixing(spark, odd, none):
    got = mixing.mix_sources(odd).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in ODD)
    sizes = Counter()
    for _, t, s in ODD:
        sizes[s] += size(t)
    want = brute_targets(dict(sizes))
    by_size = {v: k for k, v in sizes.items()}
    assert all(r.target == pytest.approx(want[by_size[r.source_size]]) and sum(d.words for d in r.draws) <= 3 * r["size"] for r in got)
    again = mixing.mix_sources(odd.repartition(5)).collect()
    key = lambda rows: sorted((r.doc_id, r["size"], str(r.draws)) for r in rows)
    assert key(got) == key(again) and mixing.mix_sources(none).count() == 0


def mixed_rows(spark, seed, n=3000):
    r = random.Random(seed)
    return spark.createDataFrame([(k, " ".join(["w"] * r.randint(0, 60)), f"s{min(k % 9, 4)}") for k in range(n)], "doc_id long, text string, source string")


def test_a_mix_is_what_its_shards_draw(spark):
    rows = mixed_rows(spark, 4)
    got = mixing.mix_sources(rows, levels=2, block_words=300).join(rows.select("doc_id", "source"), "doc_id").collect()
    shards, cut = Counter(), Counter()
    for x in got:
        for d in x.draws:
            shards[x.source, d.shard] += d.words
            cut[x.source, d.shard] += d.words < x["size"]
        assert len({d["pass"] for d in x.draws}) == len(x.draws) and len({d.shard for d in x.draws}) <= 1  # shards are disjoint
    assert {s for _, s in shards} == {0, 1, 2, 3} and max(cut.values()) <= 1
    for source in {x.source for x in got}:
        target = next(x.target for x in got if x.source == source)
        assert abs(sum(n for (s, _), n in shards.items() if s == source) - target) <= 4
    # without the tree other documents are taken
    taken = lambda rows: {x.doc_id: sum(d.words for d in x.draws) for x in rows}
    assert taken(got) != taken(mixing.mix_sources(rows, levels=0, block_words=300).collect())


def test_splitting_tree_is_exact_and_fair(spark):
    quota = {f"1s{k}": n for k, n in enumerate((1, 7, 40, 200, 333))}
    table = spark.createDataFrame(list(quota.items()), "key string, quota long")
    got = mixing.split_blocks(table, 3).collect()
    assert all(sum(r.n for r in got if r.key == k) == n for k, n in quota.items())
    per_shard = Counter()
    for r in got:
        per_shard[r.shard] += r.n
        assert r.before == sum(x.n for x in got if x.key == r.key and x.shard < r.shard)
    assert set(per_shard) == set(range(8)) and max(per_shard.values()) - min(per_shard.values()) <= 3
    # over many nodes the left half's share of a source that lies in the line from 290 to 490 is hypergeometric: its mean and its variance
    at = lambda x: mixing.went_left(F.col("id"), F.lit(781), F.lit(390), F.lit(x))
    n = [r.n for r in spark.range(400).select((at(490) - at(290)).alias("n")).collect()]
    variance = 390 * (200 / 781) * (581 / 781) * (391 / 780)
    assert abs(np.mean(n) - 200 * 390 / 781) < 4 * (variance / 400) ** 0.5 and 0.75 < np.var(n) / variance < 1.3


def test_prefix_sums(spark):
    values = random.Random(3).sample(range(10**6), 300)
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    got = {r.v: r.s for r in mixing.prefix_sums(rows, [F.col("v")], {"s": F.col("v")}).collect()}
    assert got == {v: sum(w for w in values if w < v) for v in values}


def test_shards_decide_the_layout(spark, odd, none):
    rows = mixed_rows(spark, 8, 900)
    draws = mixing.mix_sources(rows, block_words=300).select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.*").collect()
    out = mixing.mixed_texts(rows, block_words=300).collect()
    ordered = sorted(draws, key=lambda x: (x.shard, x.place))
    assert [(x.doc_id, len(x.text.split())) for x in out] == [(x.doc_id, x.words) for x in ordered]
    whole = mixing.mixed_texts(odd)
    assert whole.columns == odd.columns and whole.where("fp = 'row' and score = 1.5").count() == whole.count() > 0
    assert mixing.mixed_texts(none).count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([(" a  b\tc ", 2), ("a b", 0), ("é 日本\n x", 2), ("a", 5)], "t string, n int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == [" a  b", "", "é 日本", "a"]


def test_hypergeometric_draws(spark):
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    drawn = [r.x for r in u.select(mixing.hypergeometric(F.lit(60), F.lit(25), F.lit(20), F.col("u")).alias("x")).collect()]
    exact = {k: math.comb(25, k) * math.comb(35, 20 - k) / math.comb(60, 20) for k in range(21)}
    share = Counter(drawn)
    assert all(abs(share[k] / 4000 - p) < 0.001 for k, p in exact.items())


def test_chat(spark):
    rows = [(1, 0, "message", "user", "hi <|im_end|>\n\\ <\\|"), (1, 1, "message", "assistant", "fir"), (1, 2, "delta", None, "st"), (1, 3, "regenerate", None, None), (1, 4, "message", "assistant", "sec"),
            (1, 5, "delta", "", "ond"), (1, 6, "edit", None, "third"), (1, 7, "delta", None, "!"), (2, 0, "delta", None, "lost"), (2, 1, None, "assistant", None), (2, 1, "message", "a\nb\\", "é"), (3, 0, "delta", "user", "x")]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, text string")
    final = chat.fold_events(events)
    rendered = chat.render(final)
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rendered.select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert turns == {1: [("user", "hi <|im_end|>\n\\ <\\|"), ("assistant", "third!")], 2: [("a\nb\\", "é"), ("assistant", "")]}
    back = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    assert back[1].loss_chars == 6 and back[1].loss_sha256 == hashlib.sha256(b"third!").hexdigest()
    assert back[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and back[2].n_turns == 2
    assert back[1].turns_sha256 == hashlib.sha256("user\nhi <|im_end|>\n\\ <\\|\nassistant\nthird!\n".encode()).hexdigest()
    assert chat.render(chat.fold_events(events.where("false"))).count() == 0


def test_folding_against_brute_force(spark):
    r, rows, expected = random.Random(9), [], {}
    for conv in range(60):
        final = []  # role, text, dropped
        for seq in range(r.randint(1, 25)):
            kind, role, text = r.choice(("message", "message", "delta", "delta", "edit", "regenerate")), r.choice(("user", "assistant", "Assistant")), f"t{seq}é<|"
            rows.append((conv, seq, kind, role, text))
            if kind == "message":
                final.append([role, text, False])
            elif final and kind == "delta":
                final[-1][1] += text
            elif final and kind == "edit":
                final[-1][1] = text
            elif final and final[-1][0] == "assistant":
                final[-1][2] = True
        expected[conv] = [(role, text) for role, text, dropped in final if not dropped]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, text string").repartition(3)
    got = {k: [] for k in expected}
    for x in sorted(chat.fold_events(events).collect(), key=lambda x: x.place):
        got[x.conv_id].append((x.role, x.text))
    assert got == expected


def test_a_long_conversation(spark):
    turns = [(5, k, "user" if k % 2 else "assistant", f"é{k} <|im_end|> \\ " + "x" * 200) for k in range(6000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit("clash"), "kind": F.lit("clash"), "place": F.lit(0)})
    got = chat.read_back(chat.render(chat.fold_events(chat.message_events(df)))).first()
    loss = "".join(t for _, _, role, t in turns if role == "assistant")
    whole = "".join(f"{role}\n{t}\n" for _, _, role, t in turns)
    assert (got.n_turns, got.loss_chars, got.loss_sha256, got.turns_sha256) == (6000, len(loss), hashlib.sha256(loss.encode()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest())


def test_packing(odd, none):
    got = packing.pack_documents(odd, shard_docs=10, with_ids=True).collect()
    tokens = {}
    for i, t, _ in ODD:
        tokens.setdefault(i, []).append(tokenizer(word_vocabulary()).encode(t or "", add_special_tokens=False).ids + [1])
    assert sum(r.length for r in got) == sum(len(x) for v in tokens.values() for x in v)
    for r in got:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert any(x[r.start : r.start + r.length] == own and len(x) == r.doc_tokens for x in tokens[r.doc_id]) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack_documents(none).count() == 0


def test_packing_brings_like_documents_together():
    rng = np.random.default_rng(0)
    topic = [rng.integers(100 * k, 100 * k + 100, 700).astype("<u4") for k in range(8) for _ in range(6)]
    order = rng.permutation(len(topic))
    sequences = packing.pack_shard(np.full(len(topic), 700), [topic[k] for k in order], 2048)
    pure = [len({order[p[0]] // 6 for p in s}) for s in sequences if len(s) > 1]
    assert np.mean(np.array(pure) <= 2) > 0.7


def test_bm25_index_against_brute_force():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60, rng.integers(5, 40)) for _ in range(30)]
    index, mean = packing.Index(docs), np.mean([len(d) for d in docs])
    for seed in range(5):
        expected = np.zeros(30)
        for t in set(docs[seed].tolist()):
            df = sum(t in d for d in docs)
            idf = max(0, math.log((30 - df + 0.5) / (df + 0.5)))
            for k, d in enumerate(docs):
                tf = int((d == t).sum())
                expected[k] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(index.scores(seed), expected)


def brute_cut(data, least, most, bits):
    """Byte by byte."""
    out, begin, value = [], 0, 0
    for k, b in enumerate(data):
        value = (value << 1) + int(media.GEAR[b]) & 0xFFFFFFFF
        if (k + 1 - begin >= least and value >> (32 - bits) == 0) or k + 1 - begin == most or k + 1 == len(data):
            out.append(data[begin : k + 1])
            begin = k + 1
    return out


def test_chunks():
    rng = random.Random(6)
    data = bytes(rng.randrange(97, 123) for _ in range(60_000))
    parts = media.cut(data)
    assert parts == brute_cut(data, media.LEAST, media.MOST, media.LOG2_MEAN) and len(parts) > 50
    for size, least, most, bits in ((5000, 10, 60, 5), (3000, 64, 100, 3), (700, 1, 2000, 4)):
        assert media.cut(data[:size], least, most, bits) == brute_cut(data[:size], least, most, bits)
    moved = media.cut(b"inserted" + data)
    assert len({*parts} & {*moved}) >= len(parts) - 3
    assert media.cut(bytes(200_000))[0] == bytes(media.MOST) and media.cut(b"") == [b""]
    with pytest.raises(ValueError):
        media.from_wav(media.to_wav(b"abc")[:-1])


def test_like_files_share_chunks(spark):
    """Near copies: what they have in common is in the store once, and is not in their own lists; unlike files share nothing."""
    base = text_of(70, 3000)
    texts = [base, base.replace(text_of(70, 3000).split()[1500], "changed", 1), base + " and a tail", text_of(71, 3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    chunks = [media.cut(media.to_wav(media.payload_of(t.encode()))) for t in texts]
    places = Counter(c for parts in chunks for c in parts)
    table = spark.sparkContext.broadcast(media.shared_table(media.chunk_lists(df)))
    store = {bytes(r.digest) for r in media.stored(df, table, True).collect()}
    assert store == {media.digest_of(c) for c, n in places.items() if n > 1} and len(store) > 20
    lists = {bytes(r.media_id): list(r.parts) for r in media.stored(df, table, False).collect()}
    held = sum(d is not None for parts in lists.values() for d in parts) + len(store)
    assert held == len(places) < 0.6 * sum(places.values())
    whole = {bytes(r.media_id): len(r.parts) for r in media.whole_files(df).collect()}
    assert whole == {m: len(p) for m, p in lists.items()}


def test_media(odd, none):
    got = media.media_columns(odd).collect()
    expected = Counter()
    for i, t, _ in ODD:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        whole = media.to_wav(payload)
        expected[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest(), media.sample_features(payload))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == expected
    assert media.media_columns(none).count() == 0


def test_windows_hold_each_target_once():
    for n in (0, 1, 23, 24, 25, 100):
        ids = np.arange(10, 10 + n, dtype=np.int32)
        inputs, targets = attention.windows_of(ids, 1, 2)
        assert targets[targets >= 0].tolist() == [*ids, 2]
        both = lm.batch_windows(np.concatenate([ids, ids]), np.array([n, n]))
        assert (both[1][both[1] >= 0].tolist() == [*ids, lm.END_ID] * 2) and both[0].shape[0] == 2 * len(inputs)


def small_model(seed, n_ids, length):
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 50, n_ids).astype(float)
    inputs, targets = attention.windows_of(rng.integers(0, n_ids, length).astype(np.int32), 0, 1)
    pairs = attention.Pairs(np.empty(0, np.int64), np.empty(0), counts, np.zeros(n_ids, bool))
    return attention.Attention(counts, pairs, inputs, targets), inputs, targets


def test_attention_looks_back_only_and_sums_to_one():
    model, inputs, targets = small_model(2, 300, 400)
    own = model.attend(inputs, targets)
    changed = inputs.copy()
    changed[:, -1] = 7
    again = model.attend(changed, targets)
    keep = np.ones(targets.shape, bool)
    keep[:, -1] = False
    keep = keep.reshape(-1)[targets.reshape(-1) >= 0]
    assert np.allclose(own[keep], again[keep], rtol=1e-4) and not np.allclose(own, again, rtol=1e-4)
    one = np.repeat(inputs[3:4], 300, 0)
    every = np.full((300, attention.SCORED), -1)
    every[:, 10] = np.arange(300)
    own, other, _ = model.parts(one, every)
    assert own.sum() == pytest.approx(1, abs=1e-3) and other.sum() == pytest.approx(1, abs=1e-3)


def test_gradients_against_differences():
    model, inputs, targets = small_model(3, 40, 60)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        keep, model.p = model.p, {k: v.astype(np.float32) for k, v in model.p.items()}
        model.prepare()
        own = model.attend(inputs, targets)
        model.p = keep
        return -np.mean(np.log(own) - model.inside[targets[targets >= 0]])

    found = model.gradients(inputs, targets)
    for name, (rows, g) in found.items():
        at = tuple(int(k) for k in np.unravel_index(np.abs(g).argmax(), g.shape))
        place = at if isinstance(rows, slice) else (int(rows[at[0]]), *at[1:])
        value, step = model.p[name][place], 0.05
        model.p[name][place] = value + step
        up = loss()
        model.p[name][place] = value - step
        down = loss()
        model.p[name][place] = value
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.15, abs=2e-3), name


def test_training_in_tasks_lowers_the_loss(spark, monkeypatch):
    monkeypatch.setattr(lm, "TASK_TEXTS", 20)
    monkeypatch.setattr(attention, "BATCH", 8)
    monkeypatch.setattr(lm, "TRAIN_RATE", 8e-3)
    texts = [text_of(k, 80) for k in range(60)]
    known = memo(word_vocabulary())
    ids = [np.frombuffer(i, "<u4").astype(np.int32) for i in encode_words(known, [t.encode() for t in texts])]
    both = [attention.windows_of(i, lm.BEGIN_ID, lm.END_ID) for i in ids]
    inputs, targets = (np.concatenate([b[k] for b in both]) for k in (0, 1))
    counts = np.bincount(np.concatenate(ids), minlength=lm.END_ID + 1).astype(float)
    model = attention.Attention(counts, attention.Pairs(np.empty(0, np.int64), np.empty(0), counts, np.zeros(len(counts), bool)), inputs[:20], targets[:20])
    before = np.log(model.attend(inputs, targets)).mean()
    lm.trained(model, spark.createDataFrame([(t,) for t in texts], "text string"), word_vocabulary())
    assert np.log(model.attend(inputs, targets)).mean() > before + 0.02


def brute_scores(model, counts, total, texts, words_of_text):
    """Sum over words, and the end, of the logarithm of the mean of the attention model's product and the add-one share."""
    floor = total + len(counts) + 1 + 1
    ids, sizes = [], []
    for w in words_of_text:
        own = tokenizer(word_vocabulary()).encode(w.decode(), add_special_tokens=False).ids
        ids += own
        sizes.append(len(own))
    own, other, inner = model.parts(*attention.windows_of(np.array(ids, np.int32), lm.BEGIN_ID, lm.END_ID))
    p = model.mix[inner] * own + (1 - model.mix[inner]) * other
    out, at = 0.0, 0
    for w, n in zip([*words_of_text, None], [*sizes, 1]):
        share = (counts.get(w, 0) + 1 if w is not None else texts + 1) / floor
        out += math.log10((math.prod(p[at : at + n].tolist()) + share) / 2)
        at += n
    return out


@pytest.mark.parametrize("hot", [2e-6, 0.01, 2.0])
def test_scores_against_brute_force_whatever_is_broadcast(odd, monkeypatch, hot):
    """All words by their exact counts, whether they are broadcast or joined."""
    made = []
    real = attention.Attention.fit_mix
    monkeypatch.setattr(lm, "HOT_SHARE", hot)
    monkeypatch.setattr(attention.Attention, "fit_mix", lambda self, *w: made.append(self) or real(self, *w))
    texts = [(i, t) for i, t, _ in ODD if len(t or "") < 5000]
    df = odd.where("text is null or length(text) < 5000")
    got = Counter((r.doc_id, round(r.score, 2)) for r in lm.score_texts(df).collect())
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in texts if not held(i) for w in (t or "").encode().lower().split())
    n = sum(not held(i) for i, _ in texts)
    expected = Counter((i, round(brute_scores(made[0], counts, counts.total() + n, n, (t or "").encode().lower().split()), 2)) for i, t in texts)
    assert sum((got & expected).values()) >= len(texts) - 2  # but for a last digit


def test_scores(odd, none):
    got = lm.score_texts(odd).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words, texts = Counter(), 0
    for i, t, _ in ODD:
        if not held(i):
            words.update((t or "").encode().lower().split())
            texts += 1
    n, v = words.total() + texts, len(words) + 1
    expected = Counter()
    for i, t, _ in ODD:
        own = (t or "").encode().lower().split()
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own) + math.log10((texts + 1) / (n + v + 1))
        expected[(i, held(i), len(own) + 1, sum(w in words for w in own) + 1, n, round(base, 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(r.score < 0 for r in got) and lm.score_texts(none).count() == 0


def test_rows_whose_nulls_are_shifted_stay(spark):
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(3, text, None), (7, None, text), (7, text, None), (8, "another text altogether with several words", None)]
    kept = near_copies.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in kept if r.text) == sorted([(3, text, None), (8, rows[3][1], None)])
    assert (7, None, text) in [tuple(r) for r in kept] and len(kept) == 3
    # maps, arrays and structs count too
    schema = "doc_id long, text string, m map<string,int>, a array<int>, s struct<x:int,y:int>"
    odd = [(1, None, {"k": 1}, [None, 1], (None, 1)), (1, None, {"k": 2}, [None, 1], (None, 1)), (1, None, {"k": 1}, [1, None], (None, 1)), (1, None, {"k": 1}, [None, 1], (1, None))]
    df = spark.createDataFrame(odd, schema)
    assert df.select(near_copies.row_hash(df)).distinct().count() == 4


def pipeline_tables(spark, folder, rows, labels, extra=""):
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long{extra}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_runs(spark, tmp_path):
    """Nulls, repeated rows, near copies, a column with an operator's own name, a text of some megabytes."""
    import corpus_pipeline

    rng = random.Random(11)
    good = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    for k in range(240):
        bad = k % 2
        text = " ".join(rng.choices(["WIN!!!", "$$$", "click", "NOW", "www"], k=60)) + str(rng.random()) if bad else good(60)
        rows.append((k, text, "en", f"s{k % 3}" if k % 5 else None, len(text)))
        labels.append((k, 1 - bad, 0))
    copies = [rows[k] for k in range(0, 40, 2)]
    longs = [(8000 + k, good(100_000), "en", "s1", 0) for k in range(4)]
    labels += [(r[0], 1, 0) for r in longs]
    rows += copies + [(1000 + r[0], r[1] + " tail", None, r[3], None) for r in copies] + [(None, None, None, None, None), (7000, "", "en", "s1", 0), (7001, None, "fr", None, None), *longs]
    pipeline_tables(spark, tmp_path, [(*r, "x", 5) for r in rows], labels, ", row string, size int")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept.append([tuple(r) for r in docs.collect()])
    ids = [{r[0] for r in k} for k in kept]
    assert {k for k in range(0, 240, 2)} | {8000, 8001, 8002, 8003} <= ids[0] and not {k for k in range(1, 240, 2)} & ids[0]
    assert {k for k in range(0, 240, 2)} | {8000, 8001, 8002, 8003} <= ids[1] and not {1000 + k for k in range(0, 40, 2)} & ids[1]
    assert len(kept[1]) == len(set(kept[1]))
    assert ids[2] <= ids[1] and len(ids[2]) > 60
    assert {r[0] for r in kept[3]} == ids[2]
    per_sequence = Counter()
    for r in kept[3]:
        per_sequence[r[5]] += r[2]
    assert all(n == 2048 or n & (n - 1) == 0 for n in per_sequence.values())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, whole.select("doc_id", "doc_tokens").distinct().collect())) == Counter({(r[0], r[4]): 1 for r in kept[3]})


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    pipeline_tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def slow_fill(fragments, window):
    """Greedy packing by BM25 over all fragments, a score at a time."""
    n = len(fragments)
    counts = [Counter(f.tolist()) for f in fragments]
    df = Counter(t for c in counts for t in c)
    mean = sum(map(len, fragments)) / n
    weight = lambda t, k: max(0.0, np.log((n - df[t] + 0.5) / (df[t] + 0.5))) * counts[k][t] * 2.2 / (counts[k][t] + 1.2 * (1 - 0.75 + 0.75 * len(fragments[k]) / mean))
    left, start, out = [len(f) for f in fragments], [0] * n, []
    for seed in range(n):
        while left[seed] and sum(left) >= window:
            score = {k: sum(weight(t, k) for t in sorted(counts[seed]) if counts[k][t]) - k * 1e-12 for k in range(n) if left[k]}
            score[seed] = np.inf
            room, pieces = window, []
            for k in sorted(score, key=lambda k: -score[k]):
                take = min(room, left[k])
                if take:
                    pieces.append((k, start[k], take))
                    start[k], left[k], room = start[k] + take, left[k] - take, room - take
            out.append(pieces)
    return out


def test_greedy_packing_equals_slow():
    rng = np.random.default_rng(3)
    for n, window in ((12, 16), (40, 32), (90, 32)):
        fragments = [rng.integers(0, 40, rng.integers(1, window)).astype(np.uint32) ** 2 % 61 for _ in range(n)]
        got = packing.pack_fragments(fragments, window)
        expected = slow_fill(fragments, window)
        assert got[: len(expected)] == expected
        assert all((m := sum(p[2] for p in s)) & (m - 1) == 0 and m < window for s in got[len(expected) :])


def test_packing_holds_fragments_only(spark):
    """Long and short documents, shards smaller than a partition: pieces are those of the documents' ids, once each."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.choice([0, 3, 60, 700])))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(df, window=64, shard_docs=7, with_ids=True).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(whole.get(r.doc_id, b"")) // 4 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole[r.doc_id] = whole.get(r.doc_id, b"") + r.ids
    words = memo(word_vocabulary())
    assert whole == {k: ids + np.array([1], "<u4").tobytes() for (k, _), ids in zip(rows, encode_words(words, [t.encode() for _, t in rows]))}
    size = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == size[r.sequence_id] and r.doc_tokens == len(whole[r.doc_id]) // 4
        size[r.sequence_id] += r.length
    assert all(n == 64 or n & (n - 1) == 0 for n in size.values()) and sum(n < 64 for n in size.values()) <= 7 * 10


def test_pairs_on_rare_shingles_lose_none(spark):
    """All pairs 0.8 alike share a rarest shingle, among texts that have much in common."""
    rng = random.Random(12)
    common = [f"common{k}" for k in range(40)]
    texts = []
    for k in range(120):
        own = texts[rng.randrange(len(texts))].split() if texts and rng.random() < 0.6 else common + [f"w{rng.randrange(200)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(3)] = [f"n{rng.randrange(500)}"] * rng.randrange(2)
        texts.append(" ".join(own))
    texts += ["one two", "one two", "one"]
    rows = spark.createDataFrame([(k, k % 100, t) for k, t in enumerate(texts)], "node long, root long, text string").repartition(3)
    got = {tuple(r) for r in near_copies.sharing_rare(rows).collect()}
    sets = [set(near_copies.shingle_hashes(t.encode()).tolist()) for t in texts]
    alike = {(a, b) for a in range(len(texts)) for b in range(a) if a % 100 != b % 100 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert alike <= got and len(alike) > 50


def test_automata_equal_every_way_to_read_a_template():
    """Random templates against a slow reader that tries every end."""
    import re as regex

    rng, met = random.Random(13), 0
    for _ in range(400):
        parts, pattern = [], ""
        for k in range(rng.randrange(1, 7)):
            words = rng.choices("abc", k=rng.randrange(1, 4))
            kind = rng.random() if k else 1.0
            if kind < 0.3:
                parts.append(f"<<optional>>{' '.join(words)}<<end>>")
                pattern += f"(?:{''.join(w + ' ' for w in words)})?"
            elif kind < 0.5:
                low, high = sorted((rng.randrange(4), rng.randrange(4)))
                parts.append(f"<<var v {low}-{high}>>")
                pattern += rf"(?:\S+ ){{{low},{high}}}"
            else:
                parts.append(" ".join(words))
                pattern += "".join(w + " " for w in words)
        made = licenses.compile_template("t", " ".join(parts))
        text = [w.encode() for w in rng.choices("abcd", [4, 4, 4, 1], k=40)]
        for at in range(len(text) + 1):
            ends = [e for e in range(at, len(text) + 1) if regex.fullmatch(pattern, "".join(w.decode() + " " for w in text[at:e]))]
            assert made.match(text, at) == max(ends, default=-1), (parts, at)
            met += bool(ends)
    assert met > 500


def test_whole_licenses():
    made = [licenses.compile_template(n, t, w) for n, (w, t) in licenses.TEMPLATES.items()]
    filled = lambda n: licenses.MARK.sub(lambda m: " the holders " if m[1].startswith("var") else " ", licenses.TEMPLATES[n][1])

    def labels(text):
        words = licenses.words_of(text.encode())
        return {m[0] for m in licenses.find_licenses(words, b" " + b" ".join(words) + b" ", made)}

    for name in licenses.TEMPLATES:
        assert name in labels(f"before it {filled(name)} and after it"), name
    assert "bsd-3-clause" not in labels(filled("bsd-2-clause")) and "bsd-2-clause" not in labels(filled("bsd-3-clause"))
    assert "bsd-2-clause" not in labels(filled("bsd-2-clause").replace("must retain", "should retain"))


def test_scores_of_license_query(spark):
    from docspark.llm import queries

    rows = [(1, "Words. MIT License and CC BY"), (2, "nothing"), (3, None), (4, licenses.MARK.sub(lambda m: " x " if m[1].startswith("var") else " ", licenses.TEMPLATES["bsd-2-clause"][1])), (5, "apache license apache license")]
    spark.createDataFrame(rows, "doc_id long, text string").createOrReplaceTempView("scanned")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "table", lambda *a: spark.table("scanned"))
        got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in queries.op1_license_scan(spark, "").collect()}
    assert got[1] == (2, 1, 4, "cc-by,mit", "cc-by,mit", 0.5)
    assert got[2] == got[3] == (0, None, None, "", "", 0.0)
    assert got[4] == (0, None, None, "", "bsd-2-clause", 1.0) and got[5] == (2, 0, 2, "apache", "apache", 0.5)


def test_all_training_texts_are_learnt_from(spark, monkeypatch):
    """Classes, parameters and the mixture's weights come from every training row, not from some."""
    seen = Counter()
    real_company, real_trained, real_mix = lm.company, lm.trained, attention.Attention.fit_mix
    monkeypatch.setattr(lm, "company", lambda df, *a: (seen.update(company=df.count()), real_company(df, *a))[1])
    monkeypatch.setattr(lm, "trained", lambda m, df, p: (seen.update(trained=df.count()), real_trained(m, df, p))[1])
    monkeypatch.setattr(attention.Attention, "fit_mix", lambda self, counts: (seen.update(targets=int(counts.sum())), real_mix(self, counts))[1])
    texts = [(k, text_of(k, 30)) for k in range(300)]
    lm.score_texts(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).count()
    train = [t for k, t in texts if zlib.crc32(str(k).encode()) % 7 != 2]
    sizes = [len(i) // 4 for i in encode_words(memo(word_vocabulary()), [t.lower().encode() for t in train])]
    assert seen == {"company": len(train), "trained": len(train), "targets": sum(sizes) + len(train)}


def test_company_against_counting():
    rng = np.random.default_rng(4)
    counts = np.r_[np.arange(200, 0, -1.0), np.zeros(3)]
    streams, places = [rng.integers(0, 200, n) for n in (1, 2, 3, 50)], attention.places_of(counts)
    wide = attention.SINGLES + 1
    expected = Counter()
    for s in streams:
        for i, x in enumerate(s):
            for j in range(max(0, i - 2), min(len(s), i + 3)):
                if i != j:
                    kinds = [0] + [1] * (j == i - 1) + [2] * (j == i + 1)
                    expected.update((int(x), k, min(int(s[j]), attention.SINGLES)) for k in kinds)
    got = Counter(((int(k) // wide) // 3, (int(k) // wide) % 3, int(k) % wide) for k in attention.company_keys(streams, places, wide))
    assert got == expected


def test_near_copies_in_one_ball_are_linked_without_a_band(spark, monkeypatch):
    """The pipeline's second stage takes candidates from op3's ball hashing: copies that share no band are found by their SimHashes, and verified."""
    texts = [text_of(5000 + k, 600) for k in range(6)]
    near = lambda t, k: " ".join(w if n != k else "other" for n, w in enumerate(t.split()))
    bits = lambda a, b: bin(simhash.simhash(a.encode()) ^ simhash.simhash(b.encode())).count("1")
    copies = [next(c for c in (near(t, k) for k in range(600)) if 0 < bits(t, c) <= 2) for t in texts[:3]]
    copies += [next(c for c in (near(t, k) for k in range(600)) if bits(t, c) == 0) for t in texts[3:5]]
    real = near_copies.signatures
    monkeypatch.setattr(near_copies, "signatures", lambda rows: real(rows).withColumn("bands", F.transform("bands", lambda b, k: F.xxhash64("node", k))))
    rows = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.without_near_duplicates(rows).collect()) == list(range(6))
