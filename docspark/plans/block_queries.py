"""Queries over blocks: lines of documents, twenty to a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import blocks as K
from docspark.operators import context as C
from docspark.operators import layout as L
from docspark.operators import quality as Q
from docspark.operators import structure as S
from docspark.plans.base import BLOCKS, STRIP, blocks, query, table

ID = "'p' || lpad(CAST(page + 1 AS VARCHAR), 4, '0') || '_c' || lpad(CAST(idx + 1 AS VARCHAR), 3, '0')"


@query(f"""WITH {BLOCKS}, b AS (SELECT *, {ID} AS block_id FROM blocks)
    SELECT doc_id, pos, block_id, lag(block_id) OVER d AS prev_global, lead(block_id) OVER d AS next_global, lag(block_id) OVER p AS prev_page,
        lead(block_id) OVER p AS next_page
    FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY pos), p AS (PARTITION BY doc_id, page ORDER BY pos)""")
def block_links(spark, sf_dir):
    return K.links(blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS} SELECT a.doc_id, a.pos, coalesce(string_agg(CAST(b.pos AS VARCHAR), ',' ORDER BY b.pos), '') AS near
    FROM blocks a LEFT JOIN blocks b ON a.doc_id = b.doc_id AND a.page = b.page AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND b.pos != a.pos GROUP BY ALL""")
def neighbor_window(spark, sf_dir):
    return K.neighbours(blocks(spark, sf_dir), 2).select("doc_id", "pos", F.array_join(F.col("near").cast("array<string>"), ",").alias("near"))


@query(f"WITH {BLOCKS} SELECT doc_id, page, count(*) AS n_blocks, sum(length(content))::BIGINT AS n_chars FROM blocks GROUP BY ALL")
def page_summary(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("content")).cast("long").alias("n_chars"))


@query("""WITH i AS (SELECT user_id, epoch_us(ts) AS low, epoch_us(ts) + CAST(round(value * 1e6 * 3600) AS BIGINT) AS high FROM events),
    f AS (SELECT *, CASE WHEN max(high) OVER w IS NULL OR low > max(high) OVER w THEN 1 ELSE 0 END AS fresh
        FROM i WINDOW w AS (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS band FROM f)
    SELECT user_id, CAST(band AS BIGINT) AS band, min(low) AS low, max(high) AS high, count(*) AS n FROM b GROUP BY user_id, band""")
def interval_bands(spark, sf_dir):
    """Events as intervals of value hours."""
    low = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    rows = table(spark, sf_dir, "events").select("user_id", low.alias("low"), (low + F.round(F.col("value") * 1e6 * 3600).cast("long")).alias("high"))
    return K.merge_intervals(rows, ["user_id"], "low", "high")


@query(f"""WITH {BLOCKS}, s AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM blocks WHERE length(content) > 80)
    SELECT doc_id, min(pos) AS first, max(pos) AS last, min(pos) - 1 AS before, max(pos) + 1 AS after FROM s GROUP BY doc_id, run""")
def islands_neighbors(spark, sf_dir):
    return K.islands(blocks(spark, sf_dir).where(F.length("content") > 80), "doc_id", "pos")


@query(f"""WITH RECURSIVE {BLOCKS},
    b AS (SELECT doc_id, pos, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n, l, sum(l) OVER (w ROWS UNBOUNDED PRECEDING) AS s
          FROM (SELECT doc_id, pos, length({STRIP('content')}) AS l FROM blocks) WHERE l > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    e AS (SELECT a.doc_id, a.k, max(CASE WHEN z.k = a.k OR z.s - a.s + a.l + 2 * (z.k - a.k) <= 500 THEN z.k END) AS e FROM b a
        JOIN b z ON a.doc_id = z.doc_id AND z.k >= a.k AND z.k <= a.k + 500 GROUP BY ALL),
    r AS (SELECT e.doc_id, e.k, e.e, any_value(b.n) AS n, min(CASE WHEN b.k = e.e OR z.s - b.s + b.l + 2 * (z.k - b.k) <= 100 THEN b.k END) AS back
          FROM e JOIN b ON b.doc_id = e.doc_id AND b.k BETWEEN e.k AND e.e JOIN b z ON z.doc_id = e.doc_id AND z.k = e.e GROUP BY ALL),
    c AS (SELECT doc_id, CAST(0 AS BIGINT) AS chunk, k, e, n, back FROM r WHERE k = 1
          UNION ALL SELECT r.doc_id, c.chunk + 1, r.k, r.e, r.n, r.back FROM c
        JOIN r ON r.doc_id = c.doc_id AND c.e < c.n AND r.k = CASE WHEN c.back > c.k THEN c.back ELSE least(c.e + 1, c.k + 1) END)
    SELECT c.doc_id, chunk, x.pos AS first_pos, z.pos AS last_pos, e - c.k + 1 AS n_blocks, CAST(z.s - x.s + x.l + 2 * (e - c.k) AS BIGINT) AS n_chars
    FROM c JOIN b x ON x.doc_id = c.doc_id AND x.k = c.k JOIN b z ON z.doc_id = c.doc_id AND z.k = c.e""")
def pack_chunks(spark, sf_dir):
    return K.pack_blocks(blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS}, s AS (SELECT doc_id, page, pos, {STRIP('content')} AS content FROM blocks)
    SELECT doc_id, page, count(*) AS n_blocks, md5(string_agg(content, chr(10) || chr(10) ORDER BY pos)) AS digest FROM s WHERE content != '' GROUP BY ALL""")
def page_markdown(spark, sf_dir):
    return K.page_text(blocks(spark, sf_dir)).select("doc_id", "page", "n_blocks", F.md5(F.col("markdown").cast("binary")).alias("digest"))


BOX = "box AS (SELECT doc_id, page, idx, content, CAST((pos * 37) % 400 AS BIGINT) AS x1, CAST(idx * 45 AS BIGINT) AS y1, CAST((pos * 37) % 400 + 200 + length(content) % 500 AS BIGINT) AS x2, CAST(idx * 45 + 40 + length(content) % 60 AS BIGINT) AS y2 FROM blocks)"


def boxes(spark, sf_dir):
    """Boxes by arithmetic: the tables have none."""
    b = blocks(spark, sf_dir)
    x, n = (F.col("pos") * 37) % 400, F.length("content").cast("long")
    return b.select("doc_id", "page", "idx", "content", x.alias("x1"), (F.col("idx") * 45).alias("y1"), (x + 200 + n % 500).alias("x2"), (F.col("idx") * 45 + 40 + n % 60).alias("y2"))


@query(f"""WITH {BLOCKS}, {BOX}, h AS (SELECT doc_id, page, idx, least(greatest(x1 - 100, 0), 1000) AS x1, least(y1, 1000) AS y1, least(x2 - 100,
        1000) AS x2, least(y2, 1000) AS y2 FROM box)
    SELECT doc_id, page, idx, CAST(floor(x1 * 1240 / 1000 + 0.5) AS BIGINT) AS x1_px, CAST(floor(y2 * 1754 / 1000 + 0.5) AS BIGINT) AS y2_px,
        round(x1 / 1000, 6) AS x1_norm, round(y2 / 1000, 6) AS y2_norm
    FROM h WHERE x2 > x1 AND y2 > y1""")
def region_to_block(spark, sf_dir):
    moved = boxes(spark, sf_dir).withColumn("x1", F.col("x1") - 100).withColumn("x2", F.col("x2") - 100)
    return K.region_boxes(moved, 1240, 1754).select("doc_id", "page", "idx", "x1_px", "y2_px", "x1_norm", "y2_norm")


def titled(spark, sf_dir, *more):
    """Blocks, of which every seventh is numbered as a heading and every eleventh marked as one."""
    b = blocks(spark, sf_dir, *more)
    head = F.concat(F.lit("1"), F.when(F.col("pos") % 14 == 7, "").otherwise(".2"), F.lit(" "), F.col("content"))
    mark = F.concat(F.repeat(F.lit("#"), (F.col("pos") % 3 + 1).cast("int")), F.lit(" "), F.col("content"))
    return b.withColumn("content", F.when(F.col("pos") % 11 == 3, mark).when(F.col("pos") % 7 == 0, head).otherwise(F.col("content")))


HEAD = rf"""t AS (SELECT doc_id, pos, page, idx, CASE WHEN pos % 11 = 3 THEN repeat('#', CAST(pos % 3 + 1 AS INTEGER)) || ' ' || content
        WHEN pos % 7 = 0 THEN '1' || CASE WHEN pos % 14 = 7 THEN '' ELSE '.2' END || ' ' || content ELSE content END AS content FROM blocks),
    c AS (SELECT *, {STRIP(r"regexp_replace(regexp_replace(" + STRIP(r"regexp_replace(content, '[ \t]+', ' ', 'g')") + r", '<[^>]+>', chr(10), 'g'), '\n{2,}', chr(10), 'g')")} AS x FROM t),
    m AS (SELECT *, regexp_extract(x, '^\s{{0,3}}(#{{1,6}})\s+(\S.*?)\s*$', 1) AS marks,
        {STRIP(r"regexp_replace(CASE WHEN regexp_extract(x, '^\s{0,3}(#{1,6})\s+(\S.*?)\s*$', 1) != '' THEN regexp_extract(x, '^\s{0,3}(#{1,6})\s+(\S.*?)\s*$', 2) ELSE x END, '\s+', ' ', 'g')")} AS h FROM c),
    d AS (SELECT *, regexp_extract(h, '^\s*([0-9]+(?:\.[0-9]+){{0,6}})([.)])?\s+(\S.{{0,120}})$', 1) AS n1, regexp_extract(h,
        '^\s*([0-9]+\.[0-9]+(?:\.[0-9]+){{0,5}})([.)])?(\S.{{0,120}})$', 1) AS n2 FROM m),
    e AS (SELECT *, CASE WHEN n1 != '' THEN n1 ELSE n2 END AS num,
        CASE WHEN n1 != '' THEN regexp_extract(h, '^\s*([0-9]+(?:\.[0-9]+){{0,6}})([.)])?\s+(\S.{{0,120}})$', 2) ELSE regexp_extract(h,
        '^\s*([0-9]+\.[0-9]+(?:\.[0-9]+){{0,5}})([.)])?(\S.{{0,120}})$', 2) END AS mk,
        CASE WHEN n1 != '' THEN regexp_extract(h, '^\s*([0-9]+(?:\.[0-9]+){{0,6}})([.)])?\s+(\S.{{0,120}})$', 3) ELSE regexp_extract(h,
        '^\s*([0-9]+\.[0-9]+(?:\.[0-9]+){{0,5}})([.)])?(\S.{{0,120}})$', 3) END AS tail FROM d),
    k AS (SELECT *, CASE WHEN num != '' AND NOT contains(num, '.') AND mk != ')' AND (length(h) > 72 OR length(tail) > 64 OR regexp_matches(tail,
        '[。！？!?；;]')) THEN 'numbered_body'
        WHEN num != '' AND NOT contains(num, '.') THEN 'attached' WHEN num != '' THEN 'decimal'
        WHEN regexp_matches(h, '^\s*第[一-鿿0-9]+[章节篇]\s*\S.{{0,120}}$') OR regexp_matches(h,
        '(?i)^\s*(chapter|section|part)\s+[a-z0-9]+[.:\-\s]+.{{1,120}}$') OR regexp_matches(h,
        '(?i)^\s*(appendix|附录)\s*[a-z0-9一-鿿]*[.:\-\s]+.{{0,120}}$') THEN 'chapter'
        WHEN regexp_matches(h, '(?i)^\s*(abstract|introduction|background|methodology|method|methods|experiment|experiments|result|results|discussion|conclusion|references|acknowledgements?)\s*$') THEN 'common'
        WHEN regexp_matches(h, '^\s*[(（]\s*(?:[0-9]{{1,3}}|[A-Za-z]|[一-鿿]{{1,3}})\s*[)）]\s*\S.{{0,120}}$') OR regexp_matches(h,
        '^\s*(?:[0-9]{{1,3}}|[A-Za-z]|[一-鿿]{{1,3}})[)）]\s*\S.{{0,120}}$')
          OR regexp_matches(h, '(?i)^\s*(?:场景|案例|示例|步骤|阶段|任务|scenario|case|example|step|stage|task)\s*[一-鿿0-9a-z]*[:：.\-\s]\s*\S.{{0,120}}$') THEN 'attached'
        WHEN marks != '' THEN 'markdown' ELSE 'none' END AS kind FROM e),
    l AS (SELECT *, CASE kind WHEN 'numbered_body' THEN NULL WHEN 'attached' THEN -1 WHEN 'decimal' THEN least(len(regexp_extract_all(num, '\.')) + 1,
        6) WHEN 'chapter' THEN 1 WHEN 'common' THEN 1 ELSE CASE WHEN marks != '' THEN length(marks) END END AS lv,
        CASE WHEN h = '' THEN 0 ELSE round(least(greatest(CASE WHEN marks != '' THEN 0.72 ELSE 0 END + CASE kind WHEN 'numbered_body' THEN -0.2
        WHEN 'attached' THEN 0.56 WHEN 'decimal' THEN 0.78 WHEN 'chapter' THEN 0.78 WHEN 'common' THEN 0.62 ELSE 0 END
        + CASE WHEN length(h) <= 140 THEN 0.12 ELSE -0.25 END + 0.06 + CASE WHEN regexp_matches(h, '[A-Za-z]') THEN 0.03 ELSE 0 END, 0), 1), 6) END AS confidence FROM k),
    heads AS (SELECT doc_id, pos, page, idx, h, content, coalesce(h != '' AND confidence >= 0.52 AND lv IS NOT NULL, false) AS is_heading,
        CAST(lv AS INTEGER) AS lv, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN h = '' THEN 'empty' ELSE kind END AS pattern FROM l)"""


def marked(spark, sf_dir):
    return S.headings(titled(spark, sf_dir))


@query(f"WITH {BLOCKS}, {HEAD} SELECT doc_id, pos, is_heading, CASE WHEN is_heading THEN lv END AS level, confidence, pattern FROM heads")
def heading_score(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", "pos", "is_heading", "level", "confidence", "pattern")


@query(f"""WITH {BLOCKS}, {HEAD} SELECT doc_id, count(DISTINCT page) AS n_pages, count(*) AS n_blocks, count(*) FILTER (is_heading) AS n_sections,
        count(*) FILTER (is_heading AND lv > 0) AS n_formal,
    count(*) FILTER (is_heading AND lv < 0) AS n_attached FROM heads GROUP BY doc_id""")
def heading_stats(spark, sf_dir):
    r = S.structure_rollup(marked(spark, sf_dir))
    return r.select("doc_id", "n_pages", "n_blocks", "n_sections", F.col("roles")["formal_section"].alias("n_formal"), F.col("roles")["attached_subheading"].alias("n_attached"))


@query(f"""WITH {BLOCKS} SELECT doc_id, pos, CASE WHEN {STRIP('content')} = '' THEN 0 ELSE 1 END AS n_lines, length(content) AS n_chars,
        length(content) <= 140 AS is_short,
    (pos * 37 % 100 + 20) / 200 BETWEEN 0.35 AND 0.65 AND (20 - pos * 37 % 100) / 100 <= 0.78 AS is_centered FROM blocks""")
def line_features(spark, sf_dir):
    """Left sides by arithmetic, right sides at a fifth of the page."""
    f = S.line_features(F.col("content"), (F.col("pos") * 37 % 100) / 100, F.lit(0.2))
    return blocks(spark, sf_dir).select("doc_id", "pos", f.alias("f")).select("doc_id", "pos", "f.*")


@query(f"""WITH {BLOCKS}, s AS (SELECT doc_id, pos, [' Intro', 'Method ::: Data', 'Method:::Model ::: ', ''][pos % 4 + 1] AS name FROM blocks),
    f AS (SELECT doc_id, CASE WHEN trim(name) = '' THEN 'Document' ELSE trim(name) END AS name, min(pos) AS p FROM s GROUP BY ALL),
    l AS (SELECT *, list_filter(list_transform(string_split(name, ':::'), lambda x: trim(x)), lambda x: x != '') AS parts FROM f)
    SELECT doc_id, 'sec_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, name) - 1 AS VARCHAR), 4, '0') AS section_id, name,
        parts[-1] AS title, CAST(len(parts) AS INTEGER) AS level FROM l""")
def named_sections(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, (" Intro", "Method ::: Data", "Method:::Model ::: ", ""))), (F.col("pos") % 4 + 1).cast("int"))
    return S.named_sections(blocks(spark, sf_dir).withColumn("section_name", name)).drop("path")


@query(f"WITH {BLOCKS} SELECT doc_id, page, idx AS was, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) - 1 AS idx FROM blocks WHERE {STRIP('content')} != ''")
def numbered_anew(spark, sf_dir):
    return K.numbered_anew(blocks(spark, sf_dir)).select("doc_id", "page", "was", "idx")


@query(f"""WITH {BLOCKS}, c AS (SELECT doc_id, page, pos // 3 AS place, 'b' || (pos // 3) AS band, 'c' || (pos % 40) AS chunk_id FROM blocks)
        SELECT doc_id, chunk_id, first(band ORDER BY page, place, band) AS band FROM c GROUP BY ALL""")
def band_of_block(spark, sf_dir):
    """Three lines a band; ids come back every forty lines."""
    place = F.floor(F.col("pos") / 3).cast("long")
    b = blocks(spark, sf_dir).select("doc_id", "page", place.alias("place"), F.concat(F.lit("b"), place).alias("band"), F.array(F.concat(F.lit("c"), F.col("pos") % 40)).alias("chunks"))
    return K.band_of_block(b)


@query(f"""WITH {BLOCKS}, rg AS (SELECT conv_id % 7 AS who, conv_id * 100 + turn AS step, conv_id AS doc_id, 0::BIGINT AS page, turn AS low,
        turn + 2 AS high, turn % 3 = 2 AS removes FROM conversations),
    mt AS (SELECT rg.*, idx FROM rg JOIN blocks USING (doc_id, page) WHERE idx BETWEEN low AND high), wh AS (SELECT who, step FROM mt GROUP BY ALL HAVING count(*) = 3),
    la AS (SELECT who, doc_id, page, idx, max_by(removes, step) AS removes FROM mt SEMI JOIN wh USING (who, step) GROUP BY ALL)
    SELECT who, doc_id, page, idx, row_number() OVER (PARTITION BY who ORDER BY doc_id, page, idx) AS place FROM la WHERE NOT removes""")
def select_ranges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    r = c.select((F.col("conv_id") % 7).alias("who"), (F.col("conv_id") * 100 + F.col("turn")).alias("step"), F.col("conv_id").alias("doc_id"), F.lit(0).cast("long").alias("page"), F.col("turn").alias("low"), (F.col("turn") + 2).alias("high"), (F.col("turn") % 3 == 2).alias("removes"))
    return K.select_ranges(blocks(spark, sf_dir), r)


@query(f"""WITH RECURSIVE {BLOCKS},
    b AS (SELECT doc_id, pos, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n, l, sum(l) OVER (w ROWS UNBOUNDED PRECEDING) AS s
          FROM (SELECT doc_id, pos, length({STRIP('content')}) AS l FROM blocks) WHERE l > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    back AS (SELECT a.doc_id, a.k, min(z.k) AS back FROM b a JOIN b z ON z.doc_id = a.doc_id AND z.k < a.k AND z.k >= a.k - 100
             AND (z.k = a.k - 1 OR a.s - a.l - z.s + z.l + 2 * (a.k - z.k - 1) <= 100) GROUP BY ALL),
    f AS (SELECT doc_id, k, n, k AS first, CAST(l AS HUGEINT) AS total, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS z FROM b WHERE k = 1
          UNION ALL SELECT f.doc_id, x.k, f.n, CASE WHEN f.total + x.l + 2 > 500 THEN y.k ELSE f.first END,
        CASE WHEN f.total + x.l + 2 > 500 THEN x.s - x.l - y.s + y.l + 2 * (x.k - y.k - 1) ELSE f.total END + x.l + 2,
                 CASE WHEN f.total + x.l + 2 > 500 THEN f.first END, CASE WHEN f.total + x.l + 2 > 500 THEN f.k END
          FROM f JOIN b x ON x.doc_id = f.doc_id AND x.k = f.k + 1 JOIN back ON back.doc_id = x.doc_id AND back.k = x.k
        JOIN b y ON y.doc_id = x.doc_id AND y.k = greatest(f.first, back.back)),
    r AS (SELECT doc_id, a, z FROM f WHERE a IS NOT NULL UNION ALL SELECT doc_id, first, n FROM f WHERE k = n)
    SELECT r.doc_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY z) - 1 AS chunk, x.pos AS first_pos, y.pos AS last_pos, z - a + 1 AS n_blocks
    FROM r JOIN b x ON x.doc_id = r.doc_id AND x.k = a JOIN b y ON y.doc_id = r.doc_id AND y.k = z""")
def pack_carrying(spark, sf_dir):
    """An order-dependent fold."""
    return K.pack_carrying(blocks(spark, sf_dir))


FILL = "filled AS (SELECT *, last_value(CASE WHEN is_heading THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section_pos FROM heads)"


@query(f"WITH {BLOCKS}, {HEAD}, {FILL} SELECT doc_id, pos, section_pos FROM filled")
def section_fill(spark, sf_dir):
    return S.fill_sections(marked(spark, sf_dir)).select("doc_id", "pos", "section_pos")


TREE = """f AS (SELECT doc_id, pos, lv AS level FROM heads WHERE is_heading AND lv > 0),
    tree AS (SELECT a.doc_id, a.pos, a.level, max(CASE WHEN b.level < a.level THEN b.pos END) AS parent_pos FROM f a LEFT
        JOIN f b ON a.doc_id = b.doc_id AND b.pos < a.pos GROUP BY ALL)"""


def formal(spark, sf_dir):
    return marked(spark, sf_dir).withColumn("is_heading", F.col("is_heading") & (F.coalesce("level", F.lit(-1)) > 0))


@query(f"""WITH RECURSIVE {BLOCKS}, {HEAD}, {TREE}, named AS (SELECT t.*, h.h FROM tree t JOIN heads h USING (doc_id, pos)),
    walk AS (SELECT doc_id, pos, level, parent_pos, h AS path FROM named WHERE parent_pos IS NULL
             UNION ALL SELECT n.doc_id, n.pos, n.level, n.parent_pos, w.path || ' > ' || n.h FROM named n JOIN walk w ON n.doc_id = w.doc_id AND n.parent_pos = w.pos)
    SELECT doc_id, pos, level, parent_pos, md5(path) AS path FROM walk""")
def section_tree(spark, sf_dir):
    """Formal headings only, whose parent is the nearest before of a smaller level, with the titles from the top; attached ones are covered by tests."""
    return S.section_tree(formal(spark, sf_dir)).select("doc_id", "pos", "level", "parent_pos", F.md5(F.array_join("path", " > ").cast("binary")).alias("path"))


@query(f"""WITH {BLOCKS}, {HEAD}, {TREE}, g AS (SELECT * REPLACE (is_heading AND coalesce(lv, -1) > 0 AS is_heading) FROM heads),
    filled AS (SELECT *, last_value(CASE WHEN is_heading THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id
        ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section_pos FROM g)
    SELECT CASE WHEN parent_pos IS NULL THEN 'doc_' || doc_id ELSE 'sec_' || doc_id || '_' || parent_pos END AS src,
        'sec_' || doc_id || '_' || pos AS tgt, 'contains' AS relation FROM tree
    UNION ALL SELECT CASE WHEN section_pos IS NULL THEN 'doc_' || doc_id ELSE 'sec_' || doc_id || '_' || section_pos END,
        'blk_' || doc_id || '_' || pos, 'contains' FROM filled WHERE NOT is_heading""")
def doc_graph(spark, sf_dir):
    own = formal(spark, sf_dir)
    return S.document_graph(own, S.section_tree(own))


SEED = "seeds AS (SELECT doc_id // 500 AS query_id, doc_id, pos, CAST(doc_id // 50 % 10 AS BIGINT) AS seed_rank FROM heads WHERE pos = 2 AND doc_id % 50 = 0)"
SIDES = """near AS (SELECT *, [lag(pos) OVER d, lead(pos) OVER d, lag(pos) OVER p, lead(pos) OVER p] AS near
        FROM filled WINDOW d AS (PARTITION BY doc_id ORDER BY pos), p AS (PARTITION BY doc_id, page ORDER BY pos)),
    own AS (SELECT s.*, n.section_pos, n.near FROM seeds s JOIN near n USING (doc_id, pos)),
    one AS (SELECT query_id, doc_id, f.pos, min((place, f.pos)) AS o FROM (SELECT query_id, doc_id, section_pos, min(seed_rank) AS place FROM own
        GROUP BY ALL) JOIN filled f USING (doc_id, section_pos) WHERE NOT f.is_heading GROUP BY ALL),
    two AS (SELECT query_id, doc_id, pos, min((seed_rank, k)) AS o
        FROM (SELECT query_id, doc_id, seed_rank, unnest(near) AS pos, generate_subscripts(near, 1) - 1 AS k FROM own) WHERE pos IS NOT NULL
        GROUP BY ALL)"""


def expansion(first: int, second: int, half: int | None = None, seed: str = SEED, budget: int = 12, lead: str = "") -> str:
    limit = f"WHERE phase = 2 OR n <= {half}" if half else ""
    return f"""WITH {lead or BLOCKS + "," + HEAD + "," + FILL}, {seed}, {SIDES},
    a AS (SELECT *, {first} AS phase FROM one UNION ALL SELECT *, {second} AS phase FROM two),
    u AS (SELECT *, row_number() OVER (PARTITION BY query_id, phase ORDER BY o, doc_id) AS n FROM a ANTI JOIN seeds USING (query_id, doc_id, pos)),
    x AS (SELECT * FROM u {limit} QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, pos ORDER BY phase, o) = 1)
    SELECT query_id, doc_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY phase, o, doc_id) AS rank FROM x QUALIFY rank <= {budget}"""


def expanded(spark, sf_dir, strategy):
    own = titled(spark, sf_dir)
    seeds = blocks(spark, sf_dir).where("pos = 2 and doc_id % 50 = 0").select(F.floor(F.col("doc_id") / 500).cast("long").alias("query_id"), "doc_id", "pos", F.floor(F.col("doc_id") / 50 % 10).cast("long").alias("seed_rank"))
    # headings are looked for in the seeds' documents only
    return C.expand(S.fill_sections(S.headings(own.join(seeds.select("doc_id").distinct(), "doc_id", "left_semi"))), seeds, 12, strategy)


@query(expansion(1, 2))
def section_first_expand(spark, sf_dir):
    """Seeds: the third line of each document whose id is divisible by 50, ten documents to a query."""
    return expanded(spark, sf_dir, "section_first")


@query(expansion(2, 1))
def neighbor_first_expand(spark, sf_dir):
    return expanded(spark, sf_dir, "neighbor_first")


@query(expansion(1, 2, 6))
def mixed_expand(spark, sf_dir):
    return expanded(spark, sf_dir, "mixed")


@query(f"""WITH {BLOCKS}, {HEAD}, {FILL}, {SEED}, {SIDES},
    u AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY o, doc_id) AS n FROM (SELECT *, 1 AS kind FROM one UNION ALL SELECT *, 2
        FROM two) ANTI JOIN seeds USING (query_id, doc_id, pos)),
    other AS (SELECT DISTINCT s.query_id, s.doc_id, f.pos FROM seeds s JOIN filled f USING (doc_id) WHERE NOT f.is_heading AND f.section_pos IS NOT NULL),
    a AS (SELECT query_id, doc_id, pos, 1 AS phase, CAST(n AS BIGINT) AS x, CAST(kind AS BIGINT) AS y FROM u UNION ALL SELECT *, 3, 0, pos FROM other
        ANTI JOIN seeds USING (query_id, doc_id, pos)),
    x AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, pos ORDER BY phase, x, y) = 1)
    SELECT query_id, doc_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY phase, x, y, doc_id) AS rank FROM x QUALIFY rank <= 12""")
def interleaved_expand(spark, sf_dir):
    return expanded(spark, sf_dir, "interleaved")


OVER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
AREA = lambda p: f"(({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1))"
NESTED = lambda a, b: f"({a}.x1 >= {b}.x1 - 2 AND {a}.y1 >= {b}.y1 - 2 AND {a}.x2 <= {b}.x2 + 2 AND {a}.y2 <= {b}.y2 + 2 AND ({a}.x1, {a}.y1, {a}.x2, {a}.y2) != ({b}.x1, {b}.y1, {b}.x2, {b}.y2))"
PAIRS = f"""{BOX}, pairs AS (SELECT a.doc_id, a.page, count(*) FILTER ({OVER} / ({AREA('a')} + {AREA('b')} - {OVER}) > 0.5) AS heavy,
        count(*) FILTER ({NESTED('a', 'b')} OR {NESTED('b', 'a')}) AS nested
    FROM box a JOIN box b ON a.doc_id = b.doc_id AND a.page = b.page AND a.idx < b.idx GROUP BY ALL)"""


G = r"""CASE WHEN regexp_replace(content, '\s+', '', 'g') = '' THEN 0 ELSE 1 - len(regexp_extract_all(regexp_replace(content, '\s+', '', 'g'),
        '[\p{L}\p{N}.,;:!?''"()\-]')) / length(regexp_replace(content, '\s+', '', 'g')) END"""
PAGE = f"""{PAIRS}, pq AS (SELECT doc_id, page, sum(n)::BIGINT AS char_len, count(*) AS n_blocks, avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END) AS er,
        coalesce(avg(CASE WHEN n > 0 THEN g END), 1) AS gr, count(*) FILTER (n > 0) AS nl, sum(mk) AS mk,
        coalesce(any_value(heavy) / nullif(count(*) * (count(*) - 1) / 2, 0), 0) AS ov
        FROM (SELECT blocks.*, heavy, len(regexp_extract_all(content, '{'|'.join(X.MOJIBAKE)}')) AS mk, length(regexp_replace(content, '\\s+', '',
        'g')) AS n, {G} AS g FROM blocks LEFT JOIN pairs USING (doc_id, page)) GROUP BY doc_id, page),
    pages_q AS (SELECT doc_id, page, char_len, n_blocks, round(er, 4) AS empty_ratio, round(gr, 4) AS garbled_ratio, round(mk / greatest(char_len, 1),
        4) AS mojibake_ratio, round(ov, 4) AS overlap_ratio, round(greatest(0, 1 - (0.15 * least(1, 8 * mk / greatest(char_len,
        1)) + 0.15 * ov + 0.25 * CASE WHEN char_len < 20 THEN (20 - char_len) / 20 WHEN char_len > 20000 THEN least(1,
        (char_len - 20000) / 15000) ELSE 0 END
        + 0.3 * gr + 0.2 * er + 0.1 * CASE WHEN nl < 2 THEN 1 WHEN nl > 220 THEN least(1, (nl - 220) / 120) ELSE 0 END)), 4) AS score FROM pq)"""


@query(f"WITH {BLOCKS}, {PAGE} SELECT * FROM pages_q")
def page_quality(spark, sf_dir):
    return Q.page_quality(blocks(spark, sf_dir), heavy=L.pair_counts(boxes(spark, sf_dir)))


@query(f"""WITH {BLOCKS}, {PAGE} SELECT doc_id, count(*) AS n_pages, round(avg(score), 4) AS mean_score, min(score) AS worst_score,
        count(*) FILTER (score < 0.6) AS n_low FROM pages_q GROUP BY doc_id""")
def doc_quality_rollup(spark, sf_dir):
    return Q.rollup(page_quality(spark, sf_dir))


@query(r"""WITH t AS (SELECT page_id, html, list_filter(list_transform(string_split(html, chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '',
        'g')), lambda p: p != '') AS l FROM pages),
    n AS (SELECT page_id, len(regexp_extract_all(html, '<[^>\n]+>')) AS n_tags, regexp_matches(html, '(?m)^#{1,6}\s') AS h, len(list_filter(l,
        lambda p: length(p) > 500)) AS n_long,
          len(list_filter(l, lambda p: length(p) > 120 AND NOT regexp_matches(p, '[.,;:!?。，；：！？]'))) AS n_unpunctuated FROM t)
    SELECT page_id, n_tags, n_long, n_unpunctuated, round(greatest(0, 1.0::DOUBLE - (least(0.18,
        n_tags * 0.02) + CASE WHEN n_tags > 0 AND h THEN 0.08 ELSE 0 END + least(0.22, n_long * 0.08) + least(0.2, n_unpunctuated * 0.08))),
        4) AS score FROM n""")
def structure_quality(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", Q.structure_quality(F.col("html")).alias("q")).select("page_id", "q.*")


@query(f"""WITH {BLOCKS}, {BOX}, o AS (SELECT a.doc_id, a.page, a.idx AS i, b.idx AS j, {OVER} AS o, {AREA('a')} + {AREA('b')} AS s FROM box a
        JOIN box b ON a.doc_id = b.doc_id AND a.page = b.page AND a.idx < b.idx)
    SELECT doc_id, page, i, j, round(o / (s - o), 6) AS iou FROM o WHERE o > 0""")
def iou_pairs(spark, sf_dir):
    return Q.box_pairs(boxes(spark, sf_dir).drop("content"))


@query(f"""WITH {BLOCKS}, {BOX} SELECT doc_id, page, idx FROM box a WHERE NOT EXISTS (SELECT 1 FROM box b WHERE a.doc_id = b.doc_id AND a.page = b.page AND a.idx != b.idx
    AND ({AREA('b')} > {AREA('a')} OR ({AREA('b')} = {AREA('a')} AND b.idx < a.idx)) AND {OVER} >= 0.8 * {AREA('a')})""")
def containment_filter(spark, sf_dir):
    return Q.drop_contained(boxes(spark, sf_dir)).select("doc_id", "page", "idx")


@query(f"""WITH {BLOCKS}, {BOX}, g AS (SELECT *, median(y2 - y1) OVER (PARTITION BY doc_id, page) AS h, y1 - lag(y2) OVER (PARTITION BY doc_id,
        page ORDER BY y1, idx) AS gap FROM (SELECT doc_id, page, idx, y1 * 2 AS y1, y2 * 2 - y1 AS y2 FROM box)),
    f AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 0.4 * h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y1,
        idx ROWS UNBOUNDED PRECEDING) AS paragraph FROM g)
    SELECT doc_id, page, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS n_lines FROM f GROUP BY ALL""")
def paragraph_merge(spark, sf_dir):
    spaced = boxes(spark, sf_dir).select("doc_id", "page", "idx", (F.col("y1") * 2).alias("y1"), (F.col("y2") * 2 - F.col("y1")).alias("y2"))
    return Q.merge_paragraphs(spaced, factor=0.4)


SAMPLED = """r AS (SELECT doc_id, page, pos, content, row_number() OVER (PARTITION BY doc_id,
        page ORDER BY CASE pos % 5 WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END, pos) AS n FROM blocks WHERE page < 3 AND trim(content) != ''),
    sm AS (SELECT * FROM (SELECT doc_id, page, pos, content, row_number() OVER (PARTITION BY doc_id ORDER BY page, n) AS k FROM r
        WHERE n <= CASE WHEN page = 0 THEN 8 ELSE 4 END) WHERE k <= 24),
    tc AS (SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS place FROM (SELECT doc_id, trim(content) AS title, min(k) AS k
        FROM sm WHERE length(trim(content)) <= 80 GROUP BY ALL) QUALIFY place <= 5)"""


def sampled(spark, sf_dir):
    """Of five lines one counts as a title and one as a section."""
    from docspark.operators.overview import sample

    label = F.when(F.col("pos") % 5 == 1, "doc_title").when(F.col("pos") % 5 == 3, "Section").otherwise("text")
    return sample(blocks(spark, sf_dir).withColumn("label", label))


@query(f"WITH {BLOCKS}, {SAMPLED} SELECT doc_id, page, pos, k FROM sm")
def overview_sample(spark, sf_dir):
    return sampled(spark, sf_dir).drop("content")


@query(f"WITH {BLOCKS}, {SAMPLED} SELECT doc_id, place, title FROM tc")
def title_candidates(spark, sf_dir):
    from docspark.operators.overview import title_candidates as candidates

    return candidates(sampled(spark, sf_dir))


@query(f"""WITH {BLOCKS}, {SAMPLED}, o AS (SELECT doc_id, left(first(trim(content) ORDER BY k), 120) AS short, md5(string_agg(trim(content),
        chr(10) ORDER BY k) FILTER (k <= 6)) AS long FROM sm GROUP BY doc_id)
    SELECT doc_id, short, long, coalesce(keywords, '') AS keywords FROM o LEFT JOIN (SELECT doc_id, string_agg(title, '|' ORDER BY place) AS keywords
        FROM tc WHERE place <= 3 GROUP BY 1) USING (doc_id)""")
def heuristic_overview(spark, sf_dir):
    from docspark.operators.overview import heuristic

    return heuristic(sampled(spark, sf_dir)).select("doc_id", "short", F.md5(F.col("long").cast("binary")).alias("long"), F.array_join("keywords", "|").alias("keywords"))


@query("""WITH u AS (SELECT doc_id, n_chars AS v, 0 AS version FROM documents UNION ALL SELECT doc_id, quality, 1 FROM labels)
    SELECT doc_id, v, version FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, v DESC) = 1""")
def docs_index_upsert(spark, sf_dir):
    """Labels as updates of documents: the latest version of each row stays."""
    from docspark.operators.graph import first_best

    old = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("v"), F.lit(0).alias("version"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("v"), F.lit(1).alias("version"))
    return first_best(old.unionByName(new), ["doc_id"], F.col("version").desc(), F.col("v").desc())


ISSUES = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in {
    "high_empty_block_ratio": "empty > 0.25", "consecutive_empty_blocks": "longest >= 3", "high_empty_block_area_ratio": "empty_area > 0.2", "heavy_bbox_overlap": "heavy > 0.1", "nested_bbox_anomaly": "nested > 0.08",
    "low_layout_coverage": "coverage < 0.15", "high_layout_coverage": "coverage > 0.95", "layout_fragmentation": "fragments > 1.2"}.items()) + "], lambda x: x IS NOT NULL))"
LAYOUT = f"""{PAIRS}, o AS (SELECT *, trim(content) = '' AS e, sum(CASE WHEN trim(content) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id,
        page ORDER BY (y1 + y2) / 2, x1, idx ROWS UNBOUNDED PRECEDING) AS run FROM box),
    lo AS (SELECT doc_id, page, max(n) AS longest FROM (SELECT doc_id, page, run, count(*) FILTER (e) AS n FROM o GROUP BY ALL) GROUP BY ALL),
    pa AS (SELECT doc_id, page, count(*) AS n_blocks, count(*) FILTER (e) / count(*) AS empty, sum((x2 - x1) * (y2 - y1)) AS covered,
        coalesce(sum((x2 - x1) * (y2 - y1)) FILTER (e), 0) AS ea, greatest(1, (max(x2) - min(x1)) * (max(y2) - min(y1))) AS whole FROM o
        GROUP BY ALL),
    lm AS (SELECT *, n_blocks / greatest(1.0::DOUBLE, coverage * 100) AS fragments
        FROM (SELECT doc_id, page, n_blocks, longest, empty, ea / whole AS empty_area, CASE WHEN n_blocks > 1 THEN coalesce(heavy,
        0) / (n_blocks * (n_blocks - 1) / 2) ELSE 0 END AS heavy,
        CASE WHEN n_blocks > 1 THEN coalesce(nested, 0) / (n_blocks * (n_blocks - 1) / 2) ELSE 0 END AS nested, least(1.0::DOUBLE,
        covered / whole) AS coverage FROM pa JOIN lo USING (doc_id, page) LEFT JOIN pairs USING (doc_id, page))),
    layout AS (SELECT doc_id, page, n_blocks, longest, round(empty, 4) AS empty, round(empty_area, 4) AS empty_area, round(heavy, 4) AS heavy,
        round(nested, 4) AS nested, round(coverage, 4) AS coverage, round(fragments, 4) AS fragments,
        array_to_string({ISSUES}, ',') AS issues, round(greatest(0, least(1, 1 - (least(0.25::DOUBLE, empty * 0.6) + least(0.18::DOUBLE,
        empty_area * 0.6) + least(0.15::DOUBLE, longest * 0.05) + least(0.16::DOUBLE, heavy * 0.8) + least(0.12::DOUBLE, nested * 1.2)
        + CASE WHEN coverage < 0.15 OR coverage > 0.95 THEN 0.12 ELSE 0 END + least(0.16::DOUBLE, greatest(0.0::DOUBLE, fragments - 0.6) * 0.25)))),
        4) AS layout_score FROM lm)"""


@query(f"WITH {BLOCKS}, {LAYOUT} SELECT * FROM layout")
def layout_quality(spark, sf_dir):
    return L.layout_metrics(boxes(spark, sf_dir)).withColumn("issues", F.array_join("issues", ","))


@query(f"""WITH {BLOCKS}, {PAGE}, {LAYOUT.replace(PAIRS + ', ', '')}, f AS (SELECT doc_id, page,
        round(0.5::DOUBLE * score + 0.2::DOUBLE * empty_ratio + 0.3::DOUBLE * layout_score + 1e-9, 4) AS final, issues FROM pages_q
        JOIN layout USING (doc_id, page))
    SELECT doc_id, count(*) AS n_pages, round(avg(final) + 1e-9, 4) AS final, count(*) FILTER (contains(issues, 'nested_bbox_anomaly')) AS n_nested,
        count(*) FILTER (issues != '') AS n_issues FROM f GROUP BY doc_id""")
def doc_final_scores(spark, sf_dir):
    """The share of empty blocks stands in for the structure score, which needs whole pages."""
    q = page_quality(spark, sf_dir).select("doc_id", "page", F.col("score").alias("quality"), F.col("empty_ratio").alias("structure"))
    lay = layout_quality(spark, sf_dir).select("doc_id", "page", F.col("layout_score").alias("layout"), "issues")
    f = L.final_scores(q.join(lay, ["doc_id", "page"]))
    return f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.avg("final") + 1e-9, 4).alias("final"), F.count_if(F.contains("issues", F.lit("nested_bbox_anomaly"))).alias("n_nested"), F.count_if(F.col("issues") != "").alias("n_issues"))


@query(f"""WITH {BLOCKS}, {BOX} SELECT doc_id, page, idx, row_number() OVER (PARTITION BY doc_id, page ORDER BY (y1 + y2) / 2, x1, idx) - 1 AS place
        FROM box WHERE x2 > x1 AND y2 > y1""")
def reading_order(spark, sf_dir):
    return L.reading_order(boxes(spark, sf_dir)).select("doc_id", "page", "idx", "place")


@query()
def line_merge(spark, sf_dir):
    """Each box joins the first line that is near: an order-dependent fold, no SQL."""
    return L.merge_lines(boxes(spark, sf_dir))


COLUMNS = "ln AS (SELECT doc_id, page, idx AS line, x1 + (idx % 2) * 600 AS x1, y1, x2 + (idx % 2) * 600 AS x2, y2 FROM box)"


@query(f"""WITH {BLOCKS}, {BOX}, {COLUMNS}, lm AS (SELECT *, (x1 + x2) / 2 AS mid, (x1 + x2) / 2 < median((x1 + x2) / 2) OVER p AS l,
        median(y2 - y1) OVER p AS h FROM ln WINDOW p AS (PARTITION BY doc_id, page)),
    g AS (SELECT *, l != lag(l) OVER w AS turned, abs(y1 - lag(y2) OVER w) AS gap FROM lm WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
    r AS (SELECT doc_id, page, count(*) AS n, least(count(*) FILTER (l), count(*) FILTER (NOT l)) / count(*) AS balance,
        (max(mid) - min(mid)) / greatest(1, max(x2) - min(x1)) AS spread, count(*) FILTER (turned) AS turns,
        count(*) FILTER (turned AND gap <= 0.8 * h) AS close FROM g GROUP BY ALL),
    s AS (SELECT *, CASE WHEN n >= 6 AND balance >= 0.2 AND spread >= 0.35 THEN turns / greatest(n - 1, 1) ELSE 0 END AS sw,
        CASE WHEN n >= 6 AND balance >= 0.2 AND spread >= 0.35 AND turns > 0 THEN close / turns ELSE 0 END AS be FROM r)
    SELECT doc_id, page, round(sw, 4) AS switches, round(CASE WHEN n >= 6 THEN balance ELSE 0 END, 4) AS balance, round(be, 4) AS beside,
        sw > 0.45 AND be > 0.35 AS risk FROM s""")
def column_risk(spark, sf_dir):
    """Every other line is moved to a second column."""
    moved = (F.col("idx") % 2) * 600
    return L.column_risk(boxes(spark, sf_dir).select("doc_id", "page", F.col("idx").alias("line"), (F.col("x1") + moved).alias("x1"), "y1", (F.col("x2") + moved).alias("x2"), "y2"))


LABELLED = "lb AS (SELECT *, ['text', 'table', 'image'][idx % 3 + 1] AS label FROM box)"
INNER = f"inn AS (SELECT a.doc_id, a.page, a.idx AS i, b.idx AS o FROM lb a JOIN lb b ON a.doc_id = b.doc_id AND a.page = b.page AND a.idx != b.idx AND a.label != 'image' AND {AREA('a')} > 0 AND {OVER} >= 0.8 * {AREA('a')})"


def labelled(spark, sf_dir):
    return boxes(spark, sf_dir).withColumn("label", F.element_at(F.array(*map(F.lit, ("text", "table", "image"))), (F.col("idx") % 3 + 1).cast("int")))


@query(f"""WITH {BLOCKS}, {BOX}, {LABELLED}, {INNER} SELECT doc_id, page, idx, label FROM lb
        WHERE (doc_id, page, idx) NOT IN (SELECT (doc_id, page, o) FROM inn WHERE (doc_id, page, o) NOT IN (SELECT (doc_id, page, i) FROM inn))""")
def merge_small(spark, sf_dir):
    """Boxes that hold others go unless they lie in one."""
    return L.merge_boxes(labelled(spark, sf_dir), "small").select("doc_id", "page", "idx", "label")


@query(f"""WITH {BLOCKS}, {BOX}, {LABELLED}, {INNER} SELECT lb.doc_id, lb.page, lb.idx, lb.label FROM lb
        WHERE (doc_id, page, idx) NOT IN (SELECT (inn.doc_id, inn.page, i) FROM inn
        JOIN lb x ON x.doc_id = inn.doc_id AND x.page = inn.page AND x.idx = o AND x.label = 'table')""")
def merge_large_tables(spark, sf_dir):
    """Boxes that lie in a table go."""
    return L.merge_boxes(labelled(spark, sf_dir), "large", label="table").select("doc_id", "page", "idx", "label")


@query(f"""WITH {BLOCKS}, {BOX}, {LABELLED}, s AS (SELECT doc_id, page, idx, label, x1 * 2 AS x1, y1 AS y1, x2 * 3 AS x2, y2 * 8 AS y2 FROM lb),
    g AS (SELECT *, label = 'image' AND (least(greatest(x2, 0), 1000) - least(greatest(x1, 0), 1000)) * (least(greatest(y2, 0),
        1400) - least(greatest(y1, 0), 1400)) > 0.93 * 1000 * 1400 AS large FROM s)
    SELECT doc_id, page, idx, label FROM g QUALIFY NOT large OR bool_and(large) OVER (PARTITION BY doc_id, page)""")
def oversize_images(spark, sf_dir):
    wide = labelled(spark, sf_dir).select("doc_id", "page", "idx", "label", (F.col("x1") * 2).alias("x1"), "y1", (F.col("x2") * 3).alias("x2"), (F.col("y2") * 8).alias("y2"))
    return L.without_oversize(wide, 1000, 1400).select("doc_id", "page", "idx", "label")


@query(f"""WITH {BLOCKS}, {BOX}, u AS (SELECT doc_id, page, idx, least(greatest((x1 + x2) / 2 - (x2 - x1) * 1.2 / 2, 0), 900) AS x1,
        least(greatest((y1 + y2) / 2 - (y2 - y1) * 1.1 / 2, 0), 800) AS y1,
        least(greatest((x1 + x2) / 2 + (x2 - x1) * 1.2 / 2, 0), 900) AS x2, least(greatest((y1 + y2) / 2 + (y2 - y1) * 1.1 / 2, 0), 800) AS y2 FROM box)
    SELECT doc_id, page, idx, round(x1, 4) AS x1, round(y2, 4) AS y2, row_number() OVER (PARTITION BY doc_id, page ORDER BY (y1 + y2) / 2, x1,
        idx) - 1 AS place FROM u WHERE x2 > x1 AND y2 > y1""")
def unclip_boxes(spark, sf_dir):
    u = L.unclipped(boxes(spark, sf_dir).drop("content"), 1.2, 1.1, 900, 800)
    return u.select("doc_id", "page", "idx", F.round("x1", 4).alias("x1"), F.round("y2", 4).alias("y2"), "place")


@query(f"""WITH {BLOCKS}, {PAGE}, a AS (SELECT doc_id, page, 1 AS attempt, score FROM pages_q UNION ALL
        SELECT doc_id, page, 2, least(1, round(score + CASE WHEN page % 2 = 0 THEN 0.1 ELSE -0.1 END, 4)) FROM pages_q)
    SELECT doc_id, page, attempt, score FROM (SELECT *, min_by(score, attempt) OVER (PARTITION BY doc_id, page) >= 0.6 AS enough FROM a)
        QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN enough THEN -attempt ELSE score END DESC, attempt DESC) = 1""")
def better_attempt(spark, sf_dir):
    q = page_quality(spark, sf_dir).select("doc_id", "page", F.lit(1).alias("attempt"), "score")
    second = F.least(F.lit(1.0), F.round(F.col("score") + F.when(F.col("page") % 2 == 0, 0.1).otherwise(-0.1), 4))
    return L.better_attempt(q.unionByName(q.select("doc_id", "page", F.lit(2).alias("attempt"), second.alias("score"))))


@query()
def block_merge(spark, sf_dir):
    """Formula numbers, hyphens and bullets: order-dependent folds, no SQL."""
    label = F.when(F.col("idx") % 7 == 3, "formula").when(F.col("idx") % 7 == 4, "formula_number").otherwise("text")
    return L.merged_blocks(blocks(spark, sf_dir).withColumns({"label": label, "x1": F.col("idx") % 3}))
