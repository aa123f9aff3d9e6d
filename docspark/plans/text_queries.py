"""Queries of text functions, each a single pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.plans.base import BLOCKS, STRIP, TOKENS, blocks, query, table


def normal(x: str) -> str:
    return STRIP(rf"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, md5({normal('text')}) AS digest, length({normal('text')}) AS n_chars FROM documents")
def normalize_text(spark, sf_dir):
    t = X.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).cast("long").alias("n_chars"))


@query("WITH t AS (SELECT page_id, " + STRIP(rf"regexp_replace(regexp_replace({normal('html')}, '<[^>]+>', chr(10), 'g'), '\n{{2,}}', chr(10), 'g')") + " AS x FROM pages) SELECT page_id, md5(x) AS digest, length(x) AS n_chars FROM t")
def strip_html(spark, sf_dir):
    t = X.without_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).cast("long").alias("n_chars"))


@query(rf"""SELECT doc_id, len({TOKENS('text')}) AS n_search, len(list_distinct({TOKENS('text')})) AS n_distinct,
    len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+(?:''[a-z]+)?|[一-鿿]{{2,}}|[0-9]+(?:\.[0-9]+)?%?')) AS n_answer FROM documents""")
def tokenize_stats(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(X.search_tokens(t)).cast("long").alias("n_search"), F.size(F.array_distinct(X.simple_tokens(t))).cast("long").alias("n_distinct"), F.size(X.answer_tokens(t)).cast("long").alias("n_answer")
    )


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(left(coalesce(text, ''), 20000), '[一-鿿]')) AS z, len(regexp_extract_all(left(coalesce(text,
        ''), 20000), '[A-Za-z]')) AS e FROM documents)
    SELECT doc_id, CASE WHEN greatest(z, e) > 0 AND least(z, e) / greatest(z, e, 1) > 0.15 THEN 'mixed' WHEN z > e THEN 'zh' ELSE 'en' END AS profile FROM c""")
def profile_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.profile(F.col("text")).alias("profile"))


@query(r"""WITH s AS (SELECT doc_id, left(regexp_replace(regexp_replace(trim(lower(text)), '\s+', '_', 'g'), '[^a-z0-9_一-鿿-]', '', 'g'), 48) AS s FROM documents)
    SELECT doc_id, 'doc_' || CASE WHEN coalesce(s, '') = '' THEN 'unknown' ELSE s END AS slug FROM s""")
def node_slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.slug("doc", F.col("text")).alias("slug"))


@query(r"""WITH s AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS s FROM documents)
    SELECT doc_id, round(CASE WHEN s = '' THEN 0 ELSE 1 - len(regexp_extract_all(s, '[\p{L}\p{N}.,;:!?''"()\-]')) / length(s) END, 6) AS garbled,
           round(2::DOUBLE * len(regexp_extract_all(s, '[一-鿿]')) + 0.25 * len(regexp_extract_all(s, '[A-Za-z]')) - 3 * len(regexp_extract_all(s,
        '�')) - len(regexp_extract_all(s, '\?')), 6) AS health FROM s""")
def garbled_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.garbled_ratio(F.col("text")), 6).alias("garbled"), F.round(X.health(F.col("text")), 6).alias("health"))


@query(f"""WITH {BLOCKS}, n AS (SELECT doc_id, content, count(*) AS n FROM (SELECT doc_id, trim(content) AS content FROM blocks) WHERE content != '' GROUP BY ALL)
    SELECT doc_id, sum(n)::BIGINT AS n_lines, max(n) AS most, round(max(n) / sum(n), 6) AS share,
        (sum(n) >= 10 AND max(n) / sum(n) >= 0.8) AS truncated FROM n GROUP BY doc_id""")
def repeat_lines(spark, sf_dir):
    """Share of the most repeated line; from 0.8 on, of ten lines or more, the text counts as a loop."""
    n = blocks(spark, sf_dir).select("doc_id", F.trim("content").alias("content")).where("content != ''").groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.max("n").alias("most"))
    share = F.col("most") / F.col("n_lines")
    return out.select("doc_id", "n_lines", "most", F.round(share, 6).alias("share"), ((F.col("n_lines") >= 10) & (share >= 0.8)).alias("truncated"))


@query("SELECT event_id, len(json_keys(props)) AS n_keys, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def json_props(spark, sf_dir):
    found = F.map_keys(X.json_object(F.col("props"), "map<string,string>"))
    return table(spark, sf_dir, "events").select("event_id", F.size(found).cast("long").alias("n_keys"), F.array_join(F.array_sort(found), ",").alias("keys"))


@query(r"""SELECT doc_id, CAST(doc_id % 7 AS INTEGER) AS page, CAST(doc_id % 100 AS DOUBLE) AS x1, CAST(doc_id % 100 + 50 AS DOUBLE) AS x2 FROM documents""")
def image_refs(spark, sf_dir):
    """References written into each document are read back."""
    d = table(spark, sf_dir, "documents")
    p, x = (F.col("doc_id") % 7).cast("string"), F.col("doc_id") % 100
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" ![](page="), p, F.lit(",bbox=["), x.cast("string"), F.lit(", 0, "), (x + 50).cast("string"), F.lit(", 10]) end"))
    return d.select("doc_id", F.explode(X.image_refs(text)).alias("r")).select("doc_id", "r.page", F.col("r.bbox")[0].alias("x1"), F.col("r.bbox")[2].alias("x2"))


@query()
def region_format(spark, sf_dir):
    """No SQL: the pattern looks around line ends."""
    label = F.when(F.col("pos") == 0, "doc_title").otherwise("text")
    return blocks(spark, sf_dir).select("doc_id", "pos", X.region_text(label, F.col("content")).alias("markdown"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_name), 'blue')")
def name_search(spark, sf_dir):
    name = F.lower("p_name")
    return table(spark, sf_dir, "part").where(name.contains("widget") | name.contains("blue")).select("p_partkey", "p_name")


LABELS = ["Title", " heading", "figure_caption", "chart", "equation", "list_item", "paragraph", "code", "table", "seal", "", "plain_text"]
KINDS = " ".join(f"WHEN l IN ({', '.join(repr(x) for x in labels)}) THEN '{kind}'" for kind, labels in X.BLOCK_TYPES.items())


def labelled(spark, sf_dir):
    return blocks(spark, sf_dir).withColumn("label", F.element_at(F.array(*map(F.lit, LABELS)), (F.col("pos") % len(LABELS) + 1).cast("int")))


@query(f"""WITH {BLOCKS}, x AS (SELECT doc_id, pos, lower(trim(({LABELS!r})[pos % {len(LABELS)} + 1])) AS l FROM blocks)
        SELECT doc_id, pos, CASE WHEN l = '' THEN 'unknown' {KINDS} ELSE l END AS kind FROM x""")
def block_types(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", "pos", X.block_type(F.col("label")).alias("kind"))


@query(rf"""WITH {BLOCKS} SELECT doc_id, pos, md5('文档:' || doc_id || chr(10) || '页码:' || page || chr(10) || '类型:' || 'text ' || chr(10) || '章节路径:'
        || chr(10) || '标题:' || trim(left(trim(content), 20)) || chr(10) || '内容:' || trim(content)) AS digest,
    length('query: ' || trim(content)) AS n_query FROM blocks""")
def search_texts(spark, sf_dir):
    t = F.trim("content")
    made = X.search_text(F.col("doc_id"), F.col("page"), F.lit("text"), F.lit(None).cast("string"), F.lit(""), F.substring(t, 1, 20), F.col("content"))
    return blocks(spark, sf_dir).select("doc_id", "pos", F.md5(made.cast("binary")).alias("digest"), F.length(X.prefixed(F.col("content"), "query: ")).cast("long").alias("n_query"))


@query(rf"""SELECT p_partkey, CASE WHEN s = '' THEN 'item' ELSE s END AS id, regexp_matches(p_name, '^[A-Za-z0-9_-][A-Za-z0-9_.-]*$') AS valid,
        p_partkey || '_' || regexp_replace(p_name, '[^\w.\-]', '_', 'g') AS stored
    FROM (SELECT *, regexp_replace(regexp_replace(trim(p_name), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)""")
def safe_ids(spark, sf_dir):
    from docspark.sources.json_store import stored_name

    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_id(n).alias("id"), X.valid_id(n).alias("valid"), stored_name(n, F.col("p_partkey").cast("string")).alias("stored"))


@query(r"""WITH s AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？!?;；\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$',
        '', 'g')), lambda x: x != '') AS s, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?%?|[一二三四五六七八九十百千万]+') AS n FROM benchmark),
    f AS (SELECT item_id, len(s) AS n_sentences, len(n) AS n_numbers,
        list_distinct(list_filter(list_transform(CASE WHEN len(n) > 0 THEN n[:8] ELSE s[:3] END, lambda x: lower(regexp_replace(x, '\s+', '', 'g'))),
        lambda x: x != '')) AS f FROM s)
    SELECT item_id, n_sentences, n_numbers, len(f) AS n_facts, md5(array_to_string(list_sort(f), '|')) AS digest FROM f""")
def gold_facts(spark, sf_dir):
    t = F.col("text")
    f = X.gold_facts(t, F.lit("how"))
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.size(X.sentences(t)).cast("long").alias("n_sentences"), F.size(X.numbers(t)).cast("long").alias("n_numbers"), F.size(f).cast("long").alias("n_facts"), F.md5(F.array_join(F.array_sort(f), "|").cast("binary")).alias("digest")
    )


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN doc_id || '.1' ELSE '(' || doc_id END AS number FROM documents")
def formula_numbers(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    written = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" ("), d, F.lit(")"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("（"), d, F.lit(".1）"))).otherwise(F.concat(F.lit("("), d))
    return table(spark, sf_dir, "documents").select("doc_id", X.formula_number(written).alias("number"))


@query(rf"""WITH {BLOCKS}, c AS (SELECT doc_id, pos, {STRIP("regexp_replace(regexp_replace('\\t\\t' || content || ' .....', '^(\\\\t)+', ''), '(\\\\t)+$', '')")} AS t FROM blocks)
    SELECT doc_id, pos, md5({STRIP(r"regexp_replace(regexp_replace(regexp_replace(t, '\.{3,}', '...', 'g'), '·{3,}', '···', 'g'), '_{3,}', '___', 'g')")}) AS digest FROM c""")
def clean_contents(spark, sf_dir):
    """Lines with two tabs written out before and five points after."""
    t = F.concat(F.lit("\\t\\t"), "content", F.lit(" ....."))
    return blocks(spark, sf_dir).select("doc_id", "pos", F.md5(X.clean_content(t).cast("binary")).alias("digest"))


@query()
def without_loops(spark, sf_dir):
    """Loops of characters need back references: no SQL."""
    t = X.without_loops(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@query()
def mojibake_repair(spark, sf_dir):
    """Texts whose UTF-8 was read as Latin-1 are read again: no SQL."""
    broken = F.decode(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "ISO-8859-1")
    t = X.repair_mojibake(broken)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))
