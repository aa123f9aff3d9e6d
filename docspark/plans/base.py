"""What the queries share: tables, blocks of lines, and the SQL that makes the same blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.blocks import line_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return line_blocks(table(spark, sf_dir, "documents"), *more)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's whole text as a question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


BLOCKS = """blocks AS (
    SELECT doc_id, pos, pos // 20 AS page, pos % 20 AS idx, content
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content,
                 CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents)
)"""
STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

TOKENS = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+|[一-鿿]{{2,}}')"


def bm25_sql(items: str = "SELECT doc_id AS item_id, text FROM documents") -> str:
    return f"""
    docs AS (SELECT item_id, {TOKENS('text')} AS t FROM ({items})),
    whole AS (SELECT count(*) AS n, greatest(avg(len(t)), 1e-6) AS avgdl FROM docs),
    tf AS (SELECT item_id, term, dl, count(*) AS tf FROM (SELECT item_id, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY ALL),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS('text')}) AS term FROM benchmark) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    bm25 AS (
        SELECT query_id, item_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * qtf) AS score, count(*) AS matched
        FROM q JOIN tf USING (term) JOIN df USING (term), whole GROUP BY ALL
    )"""


BM25 = bm25_sql()
COSINE = """
    dw AS (SELECT *, tf / dl * ln(1 + 1 / (1 + tf)) AS w FROM tf),
    dn AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS norm FROM dw),
    qw AS (SELECT *, qtf / sum(qtf) OVER (PARTITION BY query_id) * ln(1 + 1 / (1 + qtf)) AS qw FROM q),
    qn AS (SELECT *, sqrt(sum(qw * qw) OVER (PARTITION BY query_id)) AS qnorm FROM qw),
    cosine AS (SELECT query_id, item_id, sum(w * qw) / any_value(norm) / any_value(qnorm) AS score FROM dn JOIN qn USING (term) GROUP BY ALL)"""
HYBRID = """
    v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r
        FROM (SELECT query_id, item_id, round(score, 9) AS score FROM cosine) QUALIFY r <= 60),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r
        FROM (SELECT query_id, item_id, round(score, 9) AS score FROM bm25) WHERE score > 0 QUALIFY r <= 60),
    vn AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w)
        ELSE 0 END AS s FROM v WINDOW w AS (PARTITION BY query_id)),
    bn AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w)
        ELSE 0 END AS s FROM b WINDOW w AS (PARTITION BY query_id)),
    nq AS (SELECT query_id, count(*) AS nq, list(term) AS terms FROM q GROUP BY 1),
    shape AS (SELECT doc_id AS item_id, source AS path, '' AS heading, lang AS kind FROM documents),
    hybrid AS (
        SELECT query_id, item_id, round(coalesce(1 / (60.0 + vn.r), 0) + coalesce(1 / (60.0 + bn.r), 0) + 0.72 * (0.6 * coalesce(vn.s, 0) + 0.4 * coalesce(bn.s, 0))
               + 0.18 * coalesce(matched / nq, 0) + 0.1 * CASE WHEN len(regexp_extract_all(lower(concat_ws(chr(10), path, heading, kind)), '[a-z0-9]+')) = 0 THEN 0
                   ELSE least(1.0, len(list_intersect(terms, regexp_extract_all(lower(concat_ws(chr(10), path, heading, kind)),
        '[a-z0-9]+'))) / greatest(nq, 1) + CASE WHEN contains(lower(kind), 'title') THEN 0.04 ELSE 0 END) END, 6) AS score
        FROM vn FULL JOIN bn USING (query_id, item_id) LEFT JOIN bm25 USING (query_id, item_id) LEFT JOIN nq USING (query_id) LEFT JOIN shape USING (item_id)
    )"""
