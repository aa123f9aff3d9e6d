"""Packed chunks and their sources, against slow versions."""

import random

from pyspark.sql import functions as F

from docspark.operators import lineage as L
from docspark.operators.blocks import pack_ranges


def slow_pack(texts, size, overlap):
    """Chunks as lists of block numbers, by adding block after block and stepping back."""
    start, out = 0, []
    while start < len(texts):
        end, total = start, 0
        while end < len(texts):
            more = len(texts[end]) + (2 if end > start else 0)
            if end > start and total + more > size:
                break
            total, end = total + more, end + 1
        out.append(list(range(start, end)))
        if end >= len(texts):
            break
        back, held = end, 0
        while overlap > 0 and back > start:
            more = len(texts[back - 1]) + (2 if held else 0)
            if held + more > overlap and back < end:
                break
            back, held = back - 1, held + more
            if held >= overlap:
                break
        start = end if overlap <= 0 else back if back > start else min(end, start + 1)
    return out


def rows_of(rng, doc, n):
    section, rows = None, []
    for pos in range(n):
        head = rng.random() < 0.3
        section = pos if head else section
        text = rng.choice(["", "  ", "a" * rng.randrange(1, 30), "b" * rng.randrange(1, 200)])
        kind = "title" if head else rng.choice(["text", "image", "table", None])
        rows.append((doc, pos, pos // 5, pos % 5, text, head, section, kind, f"H{rng.randrange(4)}" if head else None))
    return rows


SCHEMA = "doc_id long, pos long, page long, idx long, content string, is_heading boolean, section_pos long, kind string, heading string"


def test_ranges_equal_slow_packing():
    rng = random.Random(1)
    for _ in range(300):
        texts = ["x" * rng.choice([1, 5, 40, 99, 100, 101, 300]) for _ in range(rng.randrange(1, 25))]
        size, overlap = rng.choice([50, 100, 200]), rng.choice([0, 10, 60, 100])
        assert [list(range(a, b + 1)) for a, b in pack_ranges([len(t) for t in texts], size, overlap)] == slow_pack(texts, size, overlap)


def test_chunks_name_their_sources(spark):
    rng = random.Random(2)
    docs = {k: rows_of(rng, k, rng.randrange(0, 40)) for k in range(12)}
    blocks = spark.createDataFrame([r for rows in docs.values() for r in rows], SCHEMA).repartition(3)
    lineage = L.pack_lineage(blocks, 200, 60)
    got = {(r.doc_id, r.chunk): r for r in L.packed_chunks(lineage, blocks).collect()}
    once = lambda values: list(dict.fromkeys(v for v in values if v not in (None, "")))
    n = 0
    for doc, rows in docs.items():
        solid = [r for r in rows if r[7] != "image" and r[4].strip()]
        for k, chunk in enumerate(slow_pack([r[4].strip() for r in solid], 200, 60)):
            own, r = [solid[i] for i in chunk], got[doc, k]
            assert r.chunk_id == f"rag_200_60_{k:04d}" and r.content == "\n\n".join(x[4].strip() for x in own) and r.n_chars == len(r.content)
            assert r.sources == [x[1] for x in own] and r.pages == sorted({x[2] for x in own}) and r.page == r.pages[0] and r.n_sources == len(own)
            assert r.sections == once(x[6] for x in own) and r.kinds == once(x[7] for x in own) and r.heading == " | ".join(once(x[8] for x in own)[:5])
            n += 1
    assert n == len(got)
    assert L.packed_chunks(L.pack_lineage(blocks.limit(0)), blocks).collect() == []


def test_context_goes_through_sources(spark):
    heads = {0, 4, 8}
    rows = [(d, p, p // 6, p % 6, f"d{d}p{p} " + "w" * 40, p in heads, max(h for h in heads if h <= p), "text", None) for d in (1, 2) for p in range(12)]
    blocks = spark.createDataFrame(rows, SCHEMA)
    lineage = L.pack_lineage(blocks, 100, 0)  # two blocks a chunk
    hits = spark.createDataFrame([(7, 1, 2, 1), (7, 2, 0, 2), (7, 1, 2, 3), (8, 2, 5, 1)], "query_id long, doc_id long, chunk long, rank long")
    got = {}
    for r in L.packed_context(hits, lineage, blocks, budget=4).orderBy("place").collect():
        got.setdefault((r.query_id, r.part), []).append((r.doc_id, r.pos))
    assert got[7, "source"] == [(1, 4), (1, 5), (2, 0), (2, 1)]
    assert got[7, "related"] == [(1, 6), (1, 7), (2, 2), (2, 3)]  # the sections' other blocks, seed by seed
    assert got[8, "source"] == [(2, 10), (2, 11)] and got[8, "related"] == [(2, 9)]
    assert L.packed_context(hits.limit(0), lineage, blocks).collect() == []


def test_many_chunks_keep_their_names_apart(spark):
    rows = [(1, p, 0, p, "x" * 10, False, None, "text", None) for p in range(10_050)]
    ids = L.pack_lineage(spark.createDataFrame(rows, SCHEMA), 10, 0).select("chunk_id").distinct()
    assert ids.count() == 10_050 and ids.where(F.col("chunk_id") == "rag_10_0_10049").count() == 1


def test_headings_are_looked_for_once(spark):
    """What chunks, lineage and context read is a table: no pattern of headings runs again for each of them."""
    from docspark.plans.lineage_queries import structured

    for df in structured(spark, "/root/testdata/sf0.001"):
        assert "regexp" not in df._jdf.queryExecution().toString().lower()
