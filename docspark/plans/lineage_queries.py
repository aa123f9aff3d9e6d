"""Queries of packed chunks, their sources and the context found through them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import lineage as L
from docspark.operators import structure as S
from docspark.operators.checkpoints import checkpointed
from docspark.operators.scoring import Search, stored
from docspark.plans.base import BLOCKS, STRIP, bm25_sql, query, questions
from docspark.plans.block_queries import FILL, HEAD, SIDES, marked

#: pack_chunks' recursion over titled lines, and the blocks of each chunk.
PACKED = f"""pb AS (SELECT doc_id, pos, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n, l, sum(l) OVER (w ROWS UNBOUNDED PRECEDING) AS s
        FROM (SELECT doc_id, pos, length({STRIP('content')}) AS l FROM heads) WHERE l > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    pe AS (SELECT a.doc_id, a.k, max(CASE WHEN z.k = a.k OR z.s - a.s + a.l + 2 * (z.k - a.k) <= 500 THEN z.k END) AS e FROM pb a
        JOIN pb z ON a.doc_id = z.doc_id AND z.k >= a.k AND z.k <= a.k + 500 GROUP BY ALL),
    pr AS (SELECT pe.doc_id, pe.k, pe.e, any_value(pb.n) AS n, min(CASE WHEN pb.k = pe.e OR z.s - pb.s + pb.l + 2 * (z.k - pb.k) <= 100 THEN pb.k END) AS back
          FROM pe JOIN pb ON pb.doc_id = pe.doc_id AND pb.k BETWEEN pe.k AND pe.e JOIN pb z ON z.doc_id = pe.doc_id AND z.k = pe.e GROUP BY ALL),
    pc AS (SELECT doc_id, CAST(0 AS BIGINT) AS chunk, k, e, n, back FROM pr WHERE k = 1
          UNION ALL SELECT pr.doc_id, pc.chunk + 1, pr.k, pr.e, pr.n, pr.back FROM pc
        JOIN pr ON pr.doc_id = pc.doc_id AND pc.e < pc.n AND pr.k = CASE WHEN pc.back > pc.k THEN pc.back ELSE least(pc.e + 1, pc.k + 1) END),
    lineage AS (SELECT pc.doc_id, chunk, pb.pos, pb.k - pc.k AS place FROM pc JOIN pb ON pb.doc_id = pc.doc_id AND pb.k BETWEEN pc.k AND pc.e),
    packed AS (SELECT doc_id, chunk, string_agg({STRIP('content')}, chr(10) || chr(10) ORDER BY place) AS content FROM lineage
        JOIN filled USING (doc_id, pos) GROUP BY ALL)"""
LEAD = f"{BLOCKS}, {HEAD}, {FILL}, {PACKED}"


def in_order(name: str, value: str, sep: str = ",", most: int = 1 << 30) -> str:
    """Each of a chunk's values once, in the order of its blocks."""
    return f"""(SELECT doc_id, chunk, string_agg(v, '{sep}' ORDER BY first_place) AS {name}
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY first_place) AS nth
        FROM (SELECT doc_id, chunk, {value} AS v, min(place) AS first_place FROM lineage JOIN filled USING (doc_id, pos) GROUP BY doc_id, chunk, v)
        WHERE v IS NOT NULL)
        WHERE nth <= {most} GROUP BY doc_id, chunk)"""


def structured(spark, sf_dir):
    """Titled lines with sections, kinds and headings. Both tables are read several times, the patterns of headings run once."""
    whole = stored(S.fill_sections(marked(spark, sf_dir), F.when(F.col("is_heading"), F.col("text")).alias("heading")))
    return whole.drop("heading"), whole.withColumn("kind", F.when(F.col("is_heading"), "title").otherwise("text"))


@query(f"""WITH RECURSIVE {LEAD}
    SELECT doc_id, chunk, 'rag_500_100_' || lpad(CAST(chunk AS VARCHAR), 4, '0') AS chunk_id, any_value(length(packed.content)) AS n_chars,
        count(*) AS n_sources, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY place) AS sources,
           array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, coalesce(any_value(s.s), '') AS sections, any_value(k.k) AS kinds,
        coalesce(any_value(h.h), '') AS heading
    FROM lineage JOIN filled USING (doc_id, pos) JOIN packed USING (doc_id, chunk) LEFT JOIN {in_order('s', 'CAST(section_pos AS VARCHAR)')} s USING (doc_id, chunk)
    LEFT JOIN {in_order('k', "CASE WHEN is_heading THEN 'title' ELSE 'text' END")} k USING (doc_id, chunk) LEFT
        JOIN {in_order('h', "CASE WHEN is_heading AND h != '' THEN h END", ' | ', 5)} h USING (doc_id, chunk) GROUP BY doc_id, chunk""")
def chunk_lineage(spark, sf_dir):
    """Each packed chunk with what it is made of."""
    filled, blocks = structured(spark, sf_dir)
    c = L.packed_chunks(L.pack_lineage(filled), blocks)
    listed = lambda column: F.array_join(F.col(column).cast("array<string>"), ",").alias(column)
    return c.select("doc_id", "chunk", "chunk_id", "n_chars", "n_sources", listed("sources"), listed("pages"), listed("sections"), listed("kinds"), "heading")


@query(f"""WITH RECURSIVE {LEAD}, {bm25_sql('SELECT doc_id * 1000000 + chunk AS item_id, content AS text FROM packed')},
    hits AS (SELECT query_id, item_id // 1000000 AS doc_id, item_id % 1000000 AS chunk, row_number() OVER (PARTITION BY query_id ORDER BY round(score,
        6) DESC, item_id) AS rank FROM bm25 QUALIFY rank <= 5),
    seeds AS (SELECT query_id, doc_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY first_place, doc_id) AS seed_rank
        FROM (SELECT query_id, doc_id, pos, min((rank, place)) AS first_place FROM hits JOIN lineage USING (doc_id, chunk) GROUP BY ALL)), {SIDES},
    ph AS (SELECT *, 1 AS phase FROM one UNION ALL SELECT *, 2 AS phase FROM two),
    x AS (SELECT * FROM ph ANTI JOIN seeds USING (query_id, doc_id, pos) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, pos ORDER BY phase, o) = 1)
    SELECT query_id, doc_id, pos, 'source' AS part, seed_rank AS place FROM seeds
    UNION ALL (SELECT query_id, doc_id, pos, 'related', row_number() OVER (PARTITION BY query_id ORDER BY phase, o, doc_id) AS place FROM x QUALIFY place <= 6)""")
def packed_context(spark, sf_dir):
    """The five best packed chunks of each question, their source blocks and six around them."""
    filled, blocks = structured(spark, sf_dir)
    lineage = stored(L.pack_lineage(filled))
    chunks = L.packed_chunks(lineage, blocks).select((F.col("doc_id") * 1000000 + F.col("chunk")).alias("item_id"), F.col("content").alias("text"))
    best = Search(chunks, questions(spark, sf_dir)).top(5, 6, lambda s: s.bm25)
    hits = checkpointed(best.select("query_id", F.floor(F.col("item_id") / 1000000).cast("long").alias("doc_id"), (F.col("item_id") % 1000000).alias("chunk"), "rank"))
    return L.packed_context(hits, lineage, filled)
