"""Queries of knowledge graphs, and folds over pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import graph as G
from docspark.operators import knowledge as N
from docspark.operators import quality as Q
from docspark.operators import structure as S
from docspark.operators.checkpoints import checkpointed
from docspark.operators.scoring import stored
from docspark.plans.base import BLOCKS, STRIP, blocks, query, table
from docspark.plans.block_queries import BOX, FILL, HEAD, boxes, marked

quoted = lambda names: ", ".join(f"'{n}'" for n in names)
KNOWN = " UNION ALL ".join(f"SELECT '{n}' AS n, '{t}' AS t, '{r}' AS r" for t, names, r in (("Dataset", G.DATASETS, "rule_known_dataset"), ("Metric", G.METRICS, "rule_known_metric")) for n in names)
#: RE2's word boundaries know ASCII only: other characters, which are letters here, stand as underscores.
ASCII = r"regexp_replace(content, '[^\x00-\x7F]', '_', 'g')"


def every(pattern: str, kind: str, conf: float, source: str, least: int = 1, text: str = "content", stop=()) -> str:
    found = f"list_distinct(list_transform(regexp_extract_all({text}, '{pattern}', 1), lambda x: {STRIP('x')}))"
    other = f" AND lower(x) NOT IN ({quoted(stop)})" if stop else ""
    return f"SELECT doc_id, pos, name, {kind} AS type, {conf} AS confidence, '{source}' AS source FROM (SELECT doc_id, pos, unnest(list_filter({found}, lambda x: length(x) >= {least}{other})) AS name FROM named)"


CASED = f"CASE WHEN lower(name) IN ({quoted(G.DATASETS)}) THEN 'Dataset' WHEN lower(name) IN ({quoted(G.METRICS)}) THEN 'Metric' WHEN lower(name) IN ({quoted(G.METHODS)}) THEN 'Method' ELSE 'Concept' END"
#: The texts know no names: frequent words stand for some.
STANDINS = [(" the ", " BERT "), (" of ", " uses "), (" and ", " \"knowledge base\" "), (" de ", " Neural Net (NN) "), (" la ", " requires ")]
spoken_sql = "content"
for _old, _new in STANDINS:
    spoken_sql = f"replace({spoken_sql}, '{_old}', '{_new}')"
NAMED = f"named AS (SELECT * REPLACE ({spoken_sql} AS content) FROM blocks)"
RULES = " UNION ALL ".join([
    every(r"([A-Z][a-zA-Z\s]{2,30})\s*\([A-Z]{2,6}\)", "'Method'", 0.9, "rule_paren_acronym"), every(r"\b([A-Z]{2,6})\b", CASED, 0.7, "rule_acronym", text=ASCII),
    every(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", "'Concept'", 0.5, "rule_capitalized", 4, ASCII), every('"([^"]{2,50})"', "'Concept'", 0.6, "rule_quoted", 3, stop=G.QUOTED_STOP),
    "SELECT doc_id, pos, substr(content, CAST(instr(lower(content), n) AS BIGINT), length(n)), t, 0.85, r FROM named JOIN known ON contains(lower(content), n)",
    every(f"({G.CHINESE_TERMS})", "'Concept'", 0.8, "rule_chinese_tech"), every("[“”「」]([^“”「」]{2,30})[“”「」]", "'Concept'", 0.6, "rule_chinese_quoted", 2),
    every(r"([一-鿿]{2,15})\s*[（(]\s*[A-Za-z][A-Za-z0-9_\-]*\s*[）)]", "'Method'", 0.85, "rule_cn_en_pair", 2),
])
ENTITIES = f"known AS ({KNOWN}), {NAMED}, entities AS (SELECT doc_id, pos, name, type, CAST(confidence AS DOUBLE) AS confidence, source FROM ({RULES}))"
CLEAN = r"""lower(regexp_replace(regexp_replace(trim(name), '\s+', ' ', 'g'), '^[.,;:!?()\[\]{}"''\-]+|[.,;:!?()\[\]{}"''\-]+$', '', 'g'))"""
DEDUP = rf"""clean AS (SELECT key, type, first(name ORDER BY confidence DESC, name) AS name, max(confidence) AS confidence, count(*) AS n
        FROM (SELECT *, {CLEAN} AS key FROM entities
        WHERE NOT (length(trim(name)) <= 1 OR (length(trim(name)) <= 2 AND NOT (trim(name) = upper(trim(name)) AND trim(name) != lower(trim(name))))
        OR regexp_matches(trim(name), '^[0-9.\-]+$') OR regexp_replace(lower(trim(name)), '^[.,;:]+|[.,;:]+$', '', 'g') IN ({quoted(G.NOISE)})
        OR length(trim(name)) > 100 OR NOT regexp_matches(name, '[\p{{L}}\p{{N}}]') OR (contains(name, '<') AND contains(name,
        '>')) OR starts_with(trim(name), '>'))) GROUP BY key, type)"""


def named(spark, sf_dir):
    content = F.col("content")
    for old, new in STANDINS:
        content = F.replace(content, F.lit(old), F.lit(new))
    return blocks(spark, sf_dir).withColumn("content", content)


def entities(spark, sf_dir):
    return G.rule_entities(named(spark, sf_dir))


def cleaned(spark, sf_dir):
    return G.dedup_entities(entities(spark, sf_dir))


@query(f"WITH {BLOCKS}, {ENTITIES} SELECT * FROM entities")
def entity_rules(spark, sf_dir):
    return entities(spark, sf_dir)


@query(f"WITH {BLOCKS}, {ENTITIES}, {DEDUP} SELECT * FROM clean")
def entity_dedup(spark, sf_dir):
    return cleaned(spark, sf_dir)


@query(f"""WITH {BLOCKS}, {ENTITIES}, {DEDUP}, a AS (SELECT 'raw' AS part, type, source FROM entities UNION ALL SELECT 'cleaned', type, NULL FROM clean),
    c AS (SELECT part, 'type' AS "by", type AS value, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT part, 'source', source, count(*) FROM a
        WHERE part = 'raw' GROUP BY ALL UNION ALL SELECT part, 'all', '', count(*) FROM a GROUP BY ALL)
    SELECT part, "by", value, n, round(n / sum(CASE WHEN "by" = 'all' THEN n END) OVER (PARTITION BY part), 4) AS share FROM c""")
def cleaning_report(spark, sf_dir):
    found = stored(entities(spark, sf_dir))  # looked for once
    return G.cleaning_report(found, G.dedup_entities(found))


@query(f"""WITH {BLOCKS}, {ENTITIES}, e AS (SELECT DISTINCT doc_id, pos, {CLEAN} AS key, type FROM entities)
    SELECT a.key AS key_a, b.key AS key_b, CASE b.type WHEN 'Dataset' THEN 'EVALUATES_ON' WHEN 'Metric' THEN 'ACHIEVES' ELSE 'COMPARES_WITH' END AS relation,
           CAST(CASE b.type WHEN 'Dataset' THEN 0.5 WHEN 'Metric' THEN 0.4 ELSE 0.35 END AS DOUBLE) AS confidence, count(*) AS n
    FROM e a JOIN e b USING (doc_id, pos) WHERE a.type = 'Method' AND (b.type IN ('Dataset', 'Metric') OR (b.type = 'Method' AND a.key < b.key)) GROUP BY ALL""")
def cooccurrence(spark, sf_dir):
    return G.cooccurrences(entities(spark, sf_dir))


def verbs(pattern: str, relation: str) -> str:
    p = rf"([\p{{L}}\p{{N}}_]+)\s+(?:{pattern})\s+([\p{{L}}\p{{N}}_]+)"
    return f"SELECT doc_id, pos, unnest(regexp_extract_all(lower(content), '{p}', 1)) AS source, '{relation}' AS relation, unnest(regexp_extract_all(lower(content), '{p}', 2)) AS target FROM named"


RELATIONS = "r AS (" + " UNION ALL ".join(verbs(p, r) for r, p in G.VERBS.items()) + ")"


def relations(spark, sf_dir):
    return G.verb_relations(named(spark, sf_dir))


@query(f"WITH {BLOCKS}, {NAMED}, {RELATIONS} SELECT * FROM r")
def relation_patterns(spark, sf_dir):
    return relations(spark, sf_dir)


RESOLVED = f"""{RELATIONS}, names AS (SELECT doc_id, pos, list_sort(list(DISTINCT lower(name))) AS names FROM entities GROUP BY ALL),
    resolved AS (SELECT * FROM (SELECT doc_id, pos, relation,
        {", ".join(f"coalesce(list_filter(names, lambda n: n = {c})[1], list_filter(names, lambda n: contains({c}, n) OR contains(n, {c}))[1]) AS {c}" for c in ("source", "target"))}
        FROM r JOIN names USING (doc_id, pos)) WHERE source != target)"""


@query(f"WITH {BLOCKS}, {ENTITIES}, {RESOLVED} SELECT doc_id, pos, source, relation, target FROM resolved")
def relation_resolve(spark, sf_dir):
    return G.resolved_relations(relations(spark, sf_dir), entities(spark, sf_dir))


NOISY = rf"""length(trim(name)) <= 1 OR (length(trim(name)) <= 2 AND NOT (trim(name) = upper(trim(name)) AND trim(name) != lower(trim(name))))
        OR regexp_matches(trim(name), '^[0-9.\-]+$') OR regexp_replace(lower(trim(name)), '^[.,;:]+|[.,;:]+$', '', 'g') IN ({quoted(G.NOISE)})
        OR length(trim(name)) > 100 OR NOT regexp_matches(name, '[\p{{L}}\p{{N}}]') OR (contains(name, '<') AND contains(name, '>')) OR starts_with(trim(name), '>')"""


@query(f"""WITH {BLOCKS}, {ENTITIES}, {RESOLVED}, e AS (SELECT DISTINCT doc_id, pos, {CLEAN} AS key, type
        FROM entities), n AS (SELECT DISTINCT doc_id, pos, {CLEAN} AS key FROM entities WHERE NOT ({NOISY})),
    cov AS (SELECT doc_id, pos, least(source, target) AS x, greatest(source, target) AS y FROM resolved
        UNION SELECT doc_id, pos, least(a.key, b.key), greatest(a.key, b.key) FROM e a JOIN e b USING (doc_id, pos)
        WHERE a.type = 'Method' AND b.type IN ('Dataset', 'Metric', 'Method') AND a.key != b.key)
    SELECT doc_id, pos, key_a, key_b, row_number() OVER (PARTITION BY doc_id, pos ORDER BY key_a, key_b) AS place
    FROM (SELECT a.doc_id, a.pos, a.key AS key_a, b.key AS key_b FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.key < b.key) p
    WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.doc_id = p.doc_id AND cov.pos = p.pos AND x = key_a AND y = key_b) QUALIFY place <= 5""")
def uncovered_pairs(spark, sf_dir):
    """Pairs of names that neither a verb nor their kinds connect."""
    found = stored(entities(spark, sf_dir))
    spoken = G.resolved_relations(relations(spark, sf_dir), found).select("doc_id", "pos", F.col("source").alias("a"), F.col("target").alias("b"))
    together = G.cooccurring(found).select("doc_id", "pos", F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    return G.uncovered_pairs(found, spoken.unionByName(together))


@query(f"""WITH {BLOCKS}, {ENTITIES}, {RESOLVED}, {DEDUP}, x AS (SELECT source AS src, target AS tgt, relation,
        CASE WHEN pos % 5 = 0 THEN 0.2 ELSE 0.7 END AS confidence FROM resolved)
    SELECT src, tgt, relation, CAST(max(confidence) AS DOUBLE) AS confidence FROM x WHERE confidence >= 0.25 AND src IN (SELECT key
        FROM clean) AND tgt IN (SELECT key FROM clean) GROUP BY ALL""")
def relation_clean(spark, sf_dir):
    """One block in five gives relations of little confidence."""
    found = stored(entities(spark, sf_dir))  # looked for once
    r = G.resolved_relations(relations(spark, sf_dir), found)
    r = r.select(F.col("source").alias("src"), F.col("target").alias("tgt"), "relation", F.when(F.col("pos") % 5 == 0, 0.2).otherwise(0.7).alias("confidence"))
    return G.clean_relations(r, G.dedup_entities(found).select(F.col("key").alias("id")))


EVENTS = "ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS question, CAST(user_id % 20 AS VARCHAR) AS doc, event_type AS concept, 0.35 + (event_id % 7) * 0.08 AS score FROM events)"


def kg_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("question"), (F.col("user_id") % 20).cast("string").alias("doc"), F.col("event_type").alias("concept"), (0.35 + (F.col("event_id") % 7) * 0.08).alias("score"))


GRAPH = f"""{EVENTS}, ed AS (SELECT event_id, '{N.ROOT}' AS src, 'question_' || question AS tgt, 'EXPANDS_FROM' AS relation, 1.0 AS w FROM ev
        UNION ALL SELECT event_id, 'question_' || question, 'doc_' || doc, 'ASKS_ABOUT', 0.8 FROM ev
    UNION ALL SELECT event_id, 'question_' || question, 'knowledge_' || concept, 'FOCUSES_ON', score FROM ev UNION ALL
        SELECT event_id, 'knowledge_' || concept, 'doc_' || doc, 'GROUNDED_IN', greatest(0.4, score - 0.1) FROM ev),
    g AS (SELECT src, tgt, relation, round(CAST(sum(round(CAST(w AS DOUBLE), 3)) AS DOUBLE), 3) AS weight, count(*) AS n_events FROM ed GROUP BY ALL),
    way AS (SELECT DISTINCT * FROM (SELECT src, tgt FROM g UNION ALL SELECT tgt, src FROM g) WHERE src != tgt)"""


def graph(spark, sf_dir):
    return G.event_edges(kg_events(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT * FROM g")
def kg_from_events(spark, sf_dir):
    return graph(spark, sf_dir)


@query(f"""WITH {EVENTS} SELECT 'question_' || question AS src, 'knowledge_' || concept AS tgt, 'FOCUSES_ON' AS relation,
        CAST(max(score) AS DOUBLE) AS confidence FROM ev GROUP BY ALL""")
def kg_upsert(spark, sf_dir):
    e = kg_events(spark, sf_dir)
    return G.upsert_edges(e.select(F.concat(F.lit("question_"), "question").alias("src"), F.concat(F.lit("knowledge_"), "concept").alias("tgt"), F.lit("FOCUSES_ON").alias("relation"), F.col("score").alias("confidence")))


#: Each neighbour once, by its heaviest edge.
NEAR = """near AS (SELECT node, neighbour, arg_min(relation, (-weight, relation)) AS relation, max(weight) AS confidence
        FROM (SELECT src AS node, tgt AS neighbour, relation, weight FROM g UNION ALL SELECT tgt, src, relation, weight FROM g) WHERE node != neighbour GROUP BY ALL)"""


def weighed(spark, sf_dir):
    return graph(spark, sf_dir).withColumnRenamed("weight", "confidence")


@query(f"WITH {GRAPH}, {NEAR} SELECT * FROM near WHERE node LIKE 'doc_%'")
def kg_neighbors(spark, sf_dir):
    edges = weighed(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("src", "tgt")).alias("node")).where("node like 'doc_%'").distinct()
    return G.neighbours(edges, nodes)


PAIRS = "p AS (SELECT DISTINCT 'question_' || a.user_id AS a, 'knowledge_' || b.event_type AS b FROM events a, (SELECT DISTINCT event_type FROM events) b)"


@query(f"""WITH {GRAPH}, {PAIRS}, d AS (SELECT a, b FROM p JOIN way ON a = src AND b = tgt)
    SELECT a, b, a || '>' || b AS path FROM d UNION ALL SELECT p.a, p.b, p.a || '>' || x.tgt || '>' || p.b FROM p ANTI JOIN d USING (a, b)
        JOIN way x ON x.src = p.a JOIN way y ON y.src = x.tgt AND y.tgt = p.b""")
def kg_paths2(spark, sf_dir):
    """From every question to every concept; concepts are a few."""
    e = table(spark, sf_dir, "events")
    a = e.select(F.concat(F.lit("question_"), F.col("user_id").cast("string")).alias("a")).distinct()
    b = e.select(F.concat(F.lit("knowledge_"), "event_type").alias("b")).distinct()
    found = G.paths(graph(spark, sf_dir), a.crossJoin(F.broadcast(b)))
    return found.select("a", "b", F.array_join("path", ">").alias("path"))


@query(f"""WITH {GRAPH}, o AS (SELECT 'doc_3' AS node UNION SELECT tgt FROM way WHERE src = 'doc_3'), t AS (SELECT node FROM o UNION SELECT tgt
        FROM way JOIN o ON src = node)
    SELECT src, tgt, relation FROM g WHERE src IN (FROM t) AND tgt IN (FROM t)""")
def kg_ego2(spark, sf_dir):
    edges = graph(spark, sf_dir)
    centre = G.centres(named_nodes(edges), spark.createDataFrame([("DOC_3 ",)], "query string"), "question_1")
    return G.ego(edges, centre.select("node")).select("src", "tgt", "relation")


@query(f"""WITH {GRAPH}, n AS (SELECT count(*) AS n_nodes FROM (SELECT src FROM g UNION SELECT tgt FROM g)), e AS (SELECT count(*) AS n_edges FROM g)
        SELECT n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1)), 9) AS density FROM n, e""")
def kg_stats(spark, sf_dir):
    return G.stats(graph(spark, sf_dir))


def named_nodes(edges):
    """The graph's nodes, named by what follows the kind."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("id")).distinct().withColumn("name", F.regexp_replace("id", "^[a-z]+_", ""))


@query(rf"""WITH {GRAPH}, {NEAR}, nd AS (SELECT DISTINCT id, regexp_replace(id, '^[a-z]+_', '') AS name FROM (SELECT src AS id FROM g UNION ALL SELECT tgt FROM g)),
    kw AS (SELECT DISTINCT query_id, word FROM (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM benchmark)
        WHERE length(word) >= 2),
    m AS (SELECT word, id, CASE WHEN lower(name) = word THEN 1.0 ELSE 0.7 END AS score FROM (SELECT DISTINCT word FROM kw)
        JOIN nd ON contains(lower(name), word) OR contains(word, lower(name)) QUALIFY score = max(score) OVER (PARTITION BY word)),
    c AS (SELECT query_id, id, CAST(max(score) AS DOUBLE) AS score FROM kw JOIN m USING (word) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c QUALIFY rank <= 10),
    five AS (SELECT node AS id, neighbour, relation, confidence, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, neighbour) AS place
        FROM near QUALIFY place <= 5)
    SELECT query_id, rank, id, score, place, neighbour, relation, confidence FROM r LEFT JOIN five USING (id)""")
def kg_candidates(spark, sf_dir):
    """Nodes that the words of each benchmark item name or hold, with their neighbours; without the matcher, which SQL doesn't have."""
    edges = weighed(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return G.keyword_candidates(named_nodes(edges), edges, asked, fuzzy=False)


@query("""WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) > (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM events) AS late FROM events),
    d AS (SELECT DISTINCT user_id AS s, event_type AS t, user_id % 97 = 5 AS structural FROM e WHERE late), n AS (SELECT user_id::VARCHAR AS id FROM e
        WHERE NOT late UNION SELECT event_type FROM e WHERE NOT late)
    SELECT s AS user_id, event_type, CASE WHEN bool_or(structural) THEN 'reject' WHEN bool_or(s::VARCHAR IN (FROM n)
        OR event_type IN (FROM n)) THEN 'merge' ELSE 'add' END AS decision
    FROM (SELECT s, t AS event_type, structural FROM d) GROUP BY ALL""")
def delta_decision(spark, sf_dir):
    """Edges of the last fifth of the events against the graph of those before: structural ones are rejected, those that touch a known node merge, others are added."""
    own = table(spark, sf_dir, "events")
    e = own.withColumn("late", N.later_share(own, [F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")], 0.8))
    known = e.where("not late").select(F.explode(F.array(F.col("user_id").cast("string"), F.col("event_type"))).alias("id"))
    delta = e.where("late").select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("tgt"), "user_id", "event_type", (F.col("user_id") % 97 == 5).alias("structural")).distinct()
    return G.delta_decisions(delta, known).select("user_id", "event_type", "decision")


@query(f"""WITH RECURSIVE {BLOCKS}, {BOX}, o AS (SELECT doc_id, page, {{'idx': idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'label': idx % 3}} AS b,
        row_number() OVER (PARTITION BY doc_id, page ORDER BY x1 DESC, idx) AS r FROM box),
    f AS (SELECT doc_id, page, r, [b] AS kept FROM o WHERE r = 1 UNION ALL
          SELECT doc_id, page, r, CASE WHEN len(list_filter(list_transform(kept, lambda k: greatest(0, least(k.x2, b.x2) - greatest(k.x1,
        b.x1) + 1) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1) + 1)
                / ((k.x2 - k.x1 + 1) * (k.y2 - k.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) - greatest(0, least(k.x2, b.x2) - greatest(k.x1,
        b.x1) + 1) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1) + 1))
                >= CASE WHEN k.label = b.label THEN 0.6 ELSE 0.98 END), lambda x: x)) = 0 THEN kept || [b] ELSE kept END
          FROM (SELECT f.doc_id, f.page, o.r, f.kept, o.b FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.r = f.r + 1))
    SELECT doc_id, page, unnest(kept).idx AS idx FROM f QUALIFY r = max(r) OVER (PARTITION BY doc_id, page)""")
def nms_boxes(spark, sf_dir):
    scored = boxes(spark, sf_dir).withColumn("score", F.col("x1") / 1000.0).withColumn("label", (F.col("idx") % 3).cast("string"))
    return Q.suppress(scored).select("doc_id", "page", "idx")


@query()
def name_merge(spark, sf_dir):
    """Greedy merging of like names within a type: the matcher has no SQL."""
    return G.merge_names(cleaned(spark, sf_dir))


QA = """qa AS (SELECT conv_id * 1000 + turn AS event_id, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer,
        CAST(conv_id % 20 AS VARCHAR) AS doc FROM conversations QUALIFY role = 'user')"""


def label_sql(x: str) -> str:
    t = rf"regexp_replace(trim(coalesce({x}, '')), '^[\s,，;；:：.\-、（(]*[0-9]+[\)）.、\s]*', '')"
    t = f"regexp_replace(regexp_replace({t}, '^(其|该|本|这个|一种|一个|项目的?|具体的?)', ''), '(包括|为|是|指|通过|用于).*$', '')"
    return f"trim(left(regexp_replace({t}, '^[ ，,;；:：。]+|[ ，,;；:：。]+$', '', 'g'), 24))"


STOPS = quoted(X.STOP_TERMS)
has = lambda c, marks: "(" + " OR ".join(f"contains({c}, '{m}')" for m in marks) + ")"
TYPE = "CASE WHEN " + has("label", X.KNOWLEDGE["Method"]) + " OR " + has("lower(label)", X.METHOD_WORDS) + " THEN 'Method' " + " ".join(f"WHEN {has('label', m)} THEN '{k}'" for k, m in list(X.KNOWLEDGE.items())[1:]) + " ELSE 'Concept' END"
TERMS = rf"""{QA}, fo AS (SELECT event_id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(question, ''),
        '[，,。？?；;：:\s]+'), lambda p: {label_sql('p')}), lambda p: length(p) BETWEEN 2 AND 18 AND p NOT IN ({STOPS}))[:3])) AS label FROM qa),
    sg AS (SELECT event_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(answer, ''), '\([0-9]+\)|（[0-9]+）|[。；;\n]'),
        lambda p: {STRIP('p')}), lambda p: p != '')) AS s FROM qa),
    cl AS (SELECT event_id, {label_sql('s')} AS label FROM sg), wd AS (SELECT event_id, {label_sql('w')} AS label
        FROM (SELECT event_id, unnest(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9_\-]{{2,}}|[一-鿿]{{2,10}}')) AS w FROM sg)),
    ev_ AS (SELECT event_id, label, 3 AS w, 'question_focus' AS r FROM fo UNION ALL SELECT event_id, label, 3, 'answer_claim' FROM cl WHERE length(label) BETWEEN 2 AND 24
        UNION ALL SELECT event_id, left(label, 18), 1, 'term_frequency' FROM wd WHERE label != '' AND label NOT IN ({STOPS}) AND lower(label) NOT IN ({STOPS})),
    ct AS (SELECT event_id, label, sum(w)::BIGINT AS n, list_sort(list(DISTINCT r)) AS reasons FROM ev_ GROUP BY ALL),
    lo AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, label) AS place FROM ct QUALIFY place <= 12),
    terms AS (SELECT event_id, label, {TYPE} AS type, round(least(1.0::DOUBLE, 0.35::DOUBLE + least(n, 5) * 0.08 + CASE WHEN list_contains(reasons,
        'answer_claim') THEN 0.18 ELSE 0 END + CASE WHEN list_contains(reasons, 'question_focus') THEN 0.18 ELSE 0 END
        + CASE WHEN regexp_matches(label, '[A-Z]{{2,}}|Agent|SQL|RAG') THEN 0.12 ELSE 0 END), 3) AS score, array_to_string(reasons, ',') AS reasons
        FROM (SELECT * FROM lo WHERE label NOT IN ({STOPS}) AND lower(label) NOT IN ({STOPS}) AND length(label) >= 2
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY place) <= 4))"""


def answered(spark, sf_dir):
    """Questions of conversations with the turn that follows."""
    c = table(spark, sf_dir, "conversations")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.withColumn("answer", following).where("role = 'user'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("text").alias("question"), "answer", (F.col("conv_id") % 20).cast("string").alias("doc"))


@query(f"WITH {TERMS} SELECT * FROM terms")
def question_terms(spark, sf_dir):
    return N.terms(answered(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


SLUG = r"CASE WHEN left(regexp_replace(regexp_replace(trim(lower(label)), '\s+', '_', 'g'), '[^a-z0-9_一-鿿-]', '', 'g'), 48) = '' THEN 'unknown' ELSE left(regexp_replace(regexp_replace(trim(lower(label)), '\s+', '_', 'g'), '[^a-z0-9_一-鿿-]', '', 'g'), 48) END"
FIXED = " UNION ALL ".join(f"SELECT NULL, '{i}', '{t}', '{label}', {score}" for i, t, label, score in N.FIXED)
NODES = f"""{TERMS}, nd AS (SELECT event_id, 'doc_' || doc AS id, 'Document' AS type, doc AS label, 0.8::DOUBLE AS score FROM qa UNION ALL
        SELECT event_id, 'question_' || event_id, 'QuestionEvent', left(coalesce(question, ''), 80), 1 FROM qa
        UNION ALL SELECT event_id, 'knowledge_' || {SLUG}, type, label, score FROM terms UNION ALL {FIXED}),
    nodes AS (SELECT id, min(type) AS type, min(label) AS label, max(score) AS score, count(DISTINCT event_id) AS n_events FROM nd GROUP BY id)"""


@query(f"WITH {NODES} SELECT * FROM nodes")
def kg_event_nodes(spark, sf_dir):
    own = answered(spark, sf_dir)
    return N.event_nodes(own, N.terms(own))


@query(f"WITH {NODES} SELECT type AS value, count(*) AS n FROM nodes GROUP BY 1")
def kg_type_histogram(spark, sf_dir):
    return N.histogram(kg_event_nodes(spark, sf_dir), "type")


@query(f"""WITH {TERMS}, d AS (SELECT event_id AS source_id, 'question_' || event_id % 50 AS src, 'FOCUSES_ON' AS relation, label AS tgt FROM terms)
    SELECT src || '::' || relation || '::' || tgt AS id, src, tgt, relation, count(DISTINCT source_id) AS n_sources, 0.72::DOUBLE AS confidence FROM d GROUP BY ALL""")
def delta_graph(spark, sf_dir):
    t = N.terms(answered(spark, sf_dir))
    src = F.concat(F.lit("question_"), (F.col("event_id") % 50).cast("string"))
    return N.delta_graph(t.select(F.col("event_id").alias("source_id"), src.alias("src"), F.lit("FOCUSES_ON").alias("relation"), F.col("label").alias("tgt")))


@query(f"""WITH {BLOCKS}, {HEAD}, {FILL}, i AS (SELECT * FROM filled WHERE section_pos IS NOT NULL)
        SELECT 'section_' || doc_id || '_' || section_pos AS src, 'chunk_' || doc_id || '_' || pos AS tgt, 'CONTAINS' AS relation,
        1.0::DOUBLE AS confidence FROM i
    UNION ALL SELECT DISTINCT 'doc_' || doc_id, 'section_' || doc_id || '_' || section_pos, 'CONTAINS', 1.0::DOUBLE FROM i""")
def contains_edges(spark, sf_dir):
    return G.contains_edges(S.fill_sections(marked(spark, sf_dir)))


@query(f"""WITH {BLOCKS}, {HEAD}, {FILL}, {ENTITIES}, {DEDUP}, nd AS (SELECT 'Document' AS type, 'doc_' || doc_id AS id FROM filled WHERE pos = 0
        UNION ALL SELECT 'Section', 'section_' || doc_id || '_' || pos FROM filled WHERE is_heading
        UNION ALL SELECT 'Chunk', 'chunk_' || doc_id || '_' || pos FROM filled UNION ALL SELECT type, 'entity_' || lower(type) || '_' || key FROM clean)
    SELECT type, count(*) AS n, count(DISTINCT id) AS n_ids FROM nd GROUP BY type""")
def graph_nodes(spark, sf_dir):
    """How many nodes of each kind."""
    n = G.graph_nodes(S.fill_sections(marked(spark, sf_dir)), cleaned(spark, sf_dir))
    return n.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query(f"""WITH {EVENTS}, o AS (SELECT DISTINCT question AS id, CASE WHEN CAST(question AS BIGINT) % 2 = 0 THEN 'q' || question END AS name
        FROM ev), n AS (SELECT DISTINCT CAST(CAST(question AS BIGINT) + 5 AS VARCHAR) AS id, 'n' || (CAST(question AS BIGINT) + 5) AS name FROM ev)
    SELECT id, coalesce(o.name, n.name) AS name FROM o FULL JOIN n USING (id)""")
def node_upsert(spark, sf_dir):
    """Half of the old nodes lack a name; the new ones are five further on."""
    q = kg_events(spark, sf_dir).select(F.col("question").cast("long").alias("n")).distinct()
    old = q.select(F.col("n").cast("string").alias("id"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("q"), F.col("n"))).alias("name"))
    new = q.select((F.col("n") + 5).cast("string").alias("id"), F.concat(F.lit("n"), F.col("n") + 5).alias("name"))
    return G.upsert_nodes(old, new)


@query(f"""WITH {GRAPH}, m AS (SELECT DISTINCT src AS name, 'group_' || length(src) AS merged FROM g WHERE src LIKE 'knowledge%')
        SELECT coalesce(a.merged, src) AS src, coalesce(b.merged, tgt) AS tgt, relation, weight FROM g LEFT JOIN m a ON a.name = src LEFT
        JOIN m b ON b.name = tgt""")
def relation_remap(spark, sf_dir):
    e = graph(spark, sf_dir)
    merged = e.where("src like 'knowledge%'").select(F.col("src").alias("name"), F.concat(F.lit("group_"), F.length("src").cast("string")).alias("merged")).distinct()
    return G.remapped(e, merged).select("src", "tgt", "relation", "weight")


@query()
def node_search(spark, sf_dir):
    """Names of cleaned entities for five words, in tiers; the matcher has no SQL."""
    asked = spark.createDataFrame([(q,) for q in ("bert", "knowlege base", "f1", "neural nets", "em")], "query string")
    return G.search_names(cleaned(spark, sf_dir), asked)
