"""Queries over conversations, evidence and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import evaluation as V
from docspark.operators import evidence as E
from docspark.operators import sessions as S
from docspark.operators import tasks as T
from docspark.plans.base import BLOCKS, blocks, query, table


def case(kinds) -> str:
    return " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in marks) + f" THEN '{kind}'" for kind, marks in kinds.items())


CLASS = f"k AS (SELECT conv_id, turn, CASE {case(S.MARKERS)} WHEN len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) <= 10 THEN 'fact_qa' ELSE 'multi_evidence_qa' END AS kind FROM conversations WHERE role = 'user')"


@query(f"WITH {CLASS} SELECT conv_id, turn, kind FROM k")
def task_classify(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", S.classify(F.col("text")).alias("kind"))


@query(f"WITH {CLASS} SELECT CASE WHEN kind IN ('fact_qa', 'local_evidence_qa') THEN 'lad' ELSE 'rag' END AS route, kind, count(*) AS n FROM k GROUP BY ALL")
def route_mix(spark, sf_dir):
    kinds = table(spark, sf_dir, "conversations").where("role = 'user'").select(S.classify(F.col("text")).alias("kind"))
    return kinds.groupBy(S.route(F.col("kind")).alias("route"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 4")
def recent_turns(spark, sf_dir):
    return S.recent(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "back")


@query("""SELECT conv_id, left(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), 28) AS title, count(*) AS n_turns, max(turn) AS last_turn
        FROM conversations GROUP BY conv_id""")
def session_titles(spark, sf_dir):
    return S.titles(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM conversations
        GROUP BY conv_id HAVING count(*) >= 6 AND (sum(length(text)) >= 2000 OR count(*) >= 8)""")
def compaction_candidates(spark, sf_dir):
    return S.to_compact(table(spark, sf_dir, "conversations"), least=6, chars=2000, most=8)


BARE = lambda x: rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
ANSWER = lambda x: rf"regexp_extract_all(lower({x}), '[a-z]+(?:''[a-z]+)?|[一-鿿]{{2,}}|[0-9]+(?:\.[0-9]+)?%?')"


@query(f"""WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
    t AS (SELECT conv_id, turn, {BARE('a')} AS ba, {BARE('g')} AS bg, list_distinct({ANSWER('a')}) AS ta, list_distinct({ANSWER('g')}) AS tg,
        list_filter({ANSWER('g')}, lambda x: length(x) >= 2)[:8] AS keys FROM p WHERE g IS NOT NULL)
    SELECT conv_id, turn, ba != '' AND ba = bg AS exact_match, round(CASE WHEN len(tg) > 0 THEN len(list_intersect(ta, tg)) / len(tg) ELSE 0 END, 4) AS token_recall,
           round(CASE WHEN len(keys) > 0 THEN len(list_filter(keys, lambda k: contains(ba, {BARE('k')}))) / len(keys) ELSE 0 END, 4) AS keyword_recall FROM t""")
def answer_metrics(spark, sf_dir):
    """Each turn as an answer, the next as gold."""
    from pyspark.sql import Window

    pairs = table(spark, sf_dir, "conversations").withColumn("gold", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("gold is not null")
    return pairs.select("conv_id", "turn", V.answer_scores(F.col("text"), F.col("gold")).alias("s")).select("conv_id", "turn", "s.exact_match", "s.token_recall", "s.keyword_recall")


PROMPT = "coalesce(text, '') || CASE conv_id % 3 WHEN 0 THEN ' Answer as JSON with keys; cite chunk ids.' WHEN 1 THEN ' Use only retrieved chunks and verify.' ELSE '' END"
GRADE = lambda yes, no: f"CASE WHEN {yes} THEN 1.0 ELSE {no} END"
IN = lambda *marks: "(" + " OR ".join(f"contains(p, '{m}')" for m in marks) + ")"


@query(f"""WITH p AS (SELECT conv_id, turn, lower({PROMPT}) AS p, (conv_id % 10) / 10 AS cr, (turn % 5) / 5 AS tr, 0.5 AS sr, 1 / (1 + turn) AS mrr,
        CAST(turn % 2 AS DOUBLE) AS hit FROM conversations),
    f AS (SELECT *, {GRADE(IN('json') + ' AND ' + IN('keys'), 0.55)} AS st, {GRADE(IN('cited_chunk_ids', 'chunk ids', 'cite'), 0.35)} AS ci,
        {GRADE(IN('insufficient_evidence', 'not directly supported', 'missing'), 0.25)} AS re,
          {GRADE(IN('only') + ' AND ' + IN('chunks', 'retrieved'), 0.65)} AS gr,
        {GRADE(IN('verify', 'evidence_check', 'claim_evidence_map'), 0.35)} AS ve, least(1, 0.55::DOUBLE * cr + 0.25 * tr + 0.2 * sr) AS es FROM p),
    g AS (SELECT *, least(1, 0.7::DOUBLE * tr + 0.2 * hit + 0.1 * gr) AS rel, least(1, 0.65::DOUBLE * es + 0.2 * mrr + 0.15 * gr) AS cor, least(1,
        0.7::DOUBLE * es + 0.3 * ci) AS cv FROM f),
    h AS (SELECT *, (cor + rel + es + cv) / 4 AS ef, (st::DOUBLE + ci + re + gr + ve) / 5 AS co FROM g)
    SELECT conv_id, turn, round(cor + 1e-9, 4) AS correctness, round(rel + 1e-9, 4) AS relevance, round(es + 1e-9, 4) AS evidence_support,
        CAST(st AS DOUBLE) AS format_valid, round(cv + 1e-9, 4) AS citation_valid, CAST(re AS DOUBLE) AS refusal_ready,
           round(ef + 1e-9, 4) AS retrieval_effect_score, round(co + 1e-9, 4) AS prompt_control_score, round(0.7::DOUBLE * ef + 0.3 * co + 1e-9, 4) AS overall FROM h""")
def prompt_scores(spark, sf_dir):
    """Turns as prompts, some told how to answer; retrieval measures by arithmetic."""
    t = table(spark, sf_dir, "conversations")
    told = F.when(F.col("conv_id") % 3 == 0, " Answer as JSON with keys; cite chunk ids.").when(F.col("conv_id") % 3 == 1, " Use only retrieved chunks and verify.").otherwise("")
    rows = t.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), told).alias("prompt"), ((F.col("conv_id") % 10) / 10).alias("chunk_recall"), ((F.col("turn") % 5) / 5).alias("token_recall"), F.lit(0.5).alias("section_recall"), (1 / (1 + F.col("turn"))).alias("mrr"), (F.col("turn") % 2).cast("double").alias("hit"))
    return V.generation_scores(rows).select("conv_id", "turn", *[F.round(F.col(m) + 1e-9, 4).alias(m) for m in V.MEASURES])


@query("""WITH r AS (SELECT conv_id % 4 AS round, role, CAST(length(text) % 100 AS DOUBLE) / 100 AS overall, CAST(turn % 3 AS DOUBLE) / 2 AS hit
        FROM conversations), s AS (SELECT round, role, count(*) AS cases, round(avg(overall), 4) AS overall, round(avg(hit), 4) AS hit FROM r
        GROUP BY ALL)
    SELECT round, role, overall, hit, round(overall - lag(overall) OVER w, 4) AS overall_delta, round(hit - lag(hit) OVER w, 4) AS hit_delta
        FROM s WINDOW w AS (PARTITION BY role ORDER BY round)""")
def round_deltas(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    rows = t.select((F.col("conv_id") % 4).alias("round"), "role", ((F.length("text") % 100).cast("double") / 100).alias("overall"), ((F.col("turn") % 3).cast("double") / 2).alias("hit"))
    return V.round_deltas(V.averages(rows, ["round", "role"], ["overall", "hit"]), ["overall", "hit"], ["role"])


@query("""WITH r AS (SELECT ['stable', 'balanced', 'exploratory'][conv_id % 3 + 1] AS mode, CASE WHEN turn = 3 THEN 'timeout' ELSE '' END AS error,
        turn % 2 = 0 AS fv, contains(text, 'a') AS ci, conv_id % 1000 AS lat, length(text) AS len FROM conversations)
    SELECT mode, count(*) AS total, round(count(*) FILTER (error != '') / count(*), 4) AS error_rate,
        round(count(*) FILTER (error = '' AND fv) / greatest(count(*) FILTER (error = ''), 1), 4) AS format_valid_rate,
        round(count(*) FILTER (error = '' AND ci) / greatest(count(*) FILTER (error = ''), 1), 4) AS citation_rate,
           round(coalesce(sum(lat) FILTER (error = ''), 0) / greatest(count(*) FILTER (error = ''), 1), 2) AS mean_latency,
        round(coalesce(sum(len) FILTER (error = ''), 0) / greatest(count(*) FILTER (error = ''), 1), 2) AS mean_length FROM r GROUP BY mode""")
def mode_summary(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    mode = F.element_at(F.array(*map(F.lit, ("stable", "balanced", "exploratory"))), (F.col("conv_id") % 3 + 1).cast("int"))
    return V.mode_summary(t.select(mode.alias("mode"), F.when(F.col("turn") == 3, "timeout").otherwise("").alias("error"), (F.col("turn") % 2 == 0).alias("format_valid"), F.contains("text", F.lit("a")).alias("cited"), (F.col("conv_id") % 1000).alias("latency"), F.length("text").alias("length")))


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 7")
def first_of_each(spark, sf_dir):
    return V.first_of_each(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 7)


CATEGORY = "CASE WHEN n > 1 THEN 'multi_evidence' " + " ".join("WHEN " + " OR ".join(f"contains(lower(question), '{m}')" for m in marks) + f" THEN '{k}'" for k, marks in V.CATEGORIES.items()) + " ELSE 'fact' END"
CASES = f"""{BLOCKS}, qu AS (SELECT conv_id AS query_id, conv_id AS doc_id, text AS question, left(text, 20) AS gold, conv_id % 9 != 0 AS answerable,
        CASE WHEN conv_id % 4 = 0 THEN [] ELSE list_transform(range(conv_id % 4), lambda k: 'c' || (k * 25)) END AS evidence FROM conversations
        WHERE turn = 0),
    us AS (SELECT *, len(evidence) AS n FROM qu WHERE answerable AND trim(question) != '' AND trim(gold) != '' AND len(evidence) > 0),
    sc AS (SELECT query_id, count(DISTINCT page) AS ns FROM (SELECT query_id, doc_id, unnest(evidence) AS chunk_id FROM us) u
        JOIN (SELECT doc_id, 'c' || pos AS chunk_id, page FROM blocks) USING (doc_id, chunk_id) GROUP BY 1),
    cases AS (SELECT query_id, doc_id, {CATEGORY} AS category, CASE WHEN coalesce(ns,
        0) > 1 THEN 'cross_section' ELSE 'single_section' END AS difficulty, n AS n_evidence, coalesce(ns, 0) AS n_sections, gold FROM us LEFT
        JOIN sc USING (query_id))"""


def built_cases(spark, sf_dir):
    """First turns as questions to the document of their number; up to three lines of it as evidence, pages as sections."""
    t, c = table(spark, sf_dir, "conversations").where("turn = 0"), F.col("conv_id")
    some = F.transform(F.sequence(F.lit(0), (c % 4).cast("int") - 1), lambda k: F.concat(F.lit("c"), k * 25))
    q = t.select(c.alias("query_id"), c.alias("doc_id"), F.col("text").alias("question"), F.substring("text", 1, 20).alias("gold"), (c % 9 != 0).alias("answerable"), F.when(c % 4 == 0, F.array().cast("array<string>")).otherwise(some).alias("evidence"))
    return V.cases(q, blocks(spark, sf_dir).select("doc_id", F.concat(F.lit("c"), "pos").alias("chunk_id"), F.col("page").alias("section")))


@query(f"WITH {CASES} SELECT * FROM cases")
def case_builder(spark, sf_dir):
    return built_cases(spark, sf_dir)


@query(f"""WITH {CASES}, k AS (SELECT CASE category WHEN 'method' THEN 'method_qa' WHEN 'comparison' THEN 'comparison_qa'
        WHEN 'dataset' THEN 'dataset_qa' WHEN 'fact' THEN 'fact_qa' ELSE CASE WHEN category = 'multi_evidence' AND difficulty = 'single_section'
        AND n_evidence <= 2 THEN 'local_evidence_qa'
        WHEN category = 'multi_evidence' OR n_evidence > 2 THEN 'multi_evidence_qa' ELSE 'local_evidence_qa' END END AS task, n_evidence FROM cases)
        SELECT task, count(*) AS cases, round(avg(n_evidence), 4) AS n_evidence FROM k GROUP BY task""")
def case_tasks(spark, sf_dir):
    c = built_cases(spark, sf_dir)
    return V.averages(c.withColumn("task", V.case_task(F.col("category"), F.col("difficulty"), F.col("n_evidence"))), ["task"], ["n_evidence"])


IDS = "['c' || conv_id % 5, 'c' || turn, 'c' || turn]"


@query("""WITH a AS (SELECT conv_id, turn, list_distinct(['c' || conv_id % 5, 'c' || turn, 'c' || turn]) AS c, list_distinct(['c' || turn % 3,
        'c' || conv_id % 4]) AS r, CASE WHEN conv_id % 6 = 0 THEN [] ELSE ['c1', 'c' || conv_id % 3] END AS e0
        FROM conversations), b AS (SELECT *, list_distinct(e0) AS e FROM a)
    SELECT conv_id, turn, len(list_intersect(r, e)) > 0 AS retrieval_hit, len(list_intersect(c, e)) > 0 AS evidence_hit,
        round(CASE WHEN len(e) > 0 THEN len(list_intersect(r, e)) / len(e) ELSE 0 END, 4) AS evidence_recall, round(len(list_intersect(c,
        e)) / len(c), 4) AS cited_support FROM b""")
def citation_scores(spark, sf_dir):
    name = lambda c: F.concat(F.lit("c"), c)
    v, t = F.col("conv_id"), F.col("turn")
    cited, found = F.array(name(v % 5), name(t), name(t)), F.array(name(t % 3), name(v % 4))
    gold = F.when(v % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("c1"), name(v % 3)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.citation_scores(cited, found, gold).alias("s")).select("conv_id", "turn", "s.*")


@query()
def answer_rescore(spark, sf_dir):
    """Facts, groundedness and likeness of each turn against the next one: the matcher has no SQL."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("gold", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("gold is not null")
    return V.rescored(rows.select("conv_id", "turn", F.lit("how").alias("question"), F.col("text").alias("answer"), "gold", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("cited_text"))).select("conv_id", "turn", "n_facts", "key_fact_f1", "groundedness")


@query("""WITH c AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS l FROM conversations) SELECT conv_id, turn, role, text FROM c UNION ALL
        SELECT DISTINCT conv_id, l + 1, 'user', 'more' FROM c UNION ALL SELECT DISTINCT conv_id, l + 2, 'assistant', 'done' FROM c
    UNION ALL SELECT -5, 0, 'user', 'more' UNION ALL SELECT -5, 1, 'assistant', 'done'""")
def turn_append(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    ids = t.select("conv_id").distinct().unionByName(spark.range(1).select(F.lit(-5).cast("long").alias("conv_id")))
    two = F.array(F.struct(F.lit("user").alias("role"), F.lit("more").alias("text"), F.lit(1).alias("order")), F.struct(F.lit("assistant").alias("role"), F.lit("done").alias("text"), F.lit(2).alias("order")))
    return S.with_turns(t, ids.select("conv_id", F.explode(two).alias("n")).select("conv_id", "n.*"))


@query("""WITH t AS (SELECT conv_id, left(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), 28) AS title, count(*) AS n_turns,
        max(turn) AS last_turn FROM conversations GROUP BY conv_id)
    SELECT conv_id, conv_id % 20 AS doc_id, title, n_turns, last_turn, CASE WHEN conv_id % 3 = 0 THEN 4 ELSE 0 END AS compacted FROM t WHERE conv_id % 20 != 7""")
def session_list(spark, sf_dir):
    """Sessions of documents, but for those of document 7; every third has been compacted."""
    t = table(spark, sf_dir, "conversations")
    ids = t.select("conv_id").distinct()
    done = ids.where("conv_id % 3 = 0").select("conv_id", F.explode(F.array(F.lit(2), F.lit(4))).alias("n_turns"))
    return S.session_list(t, done, ids.select("conv_id", (F.col("conv_id") % 20).alias("doc_id")).where("doc_id != 7"))


MODEL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{c[0]}|{c[3]}'" for k, c in S.MODELS.items()) + f" ELSE '{S.BALANCED[0]}|{S.BALANCED[3]}' END"


@query(f"""WITH {CLASS} SELECT conv_id, turn, {MODEL} AS model, CASE WHEN conv_id % 5 = 0 THEN 'rag' WHEN kind IN ('fact_qa',
        'local_evidence_qa') THEN 'lad' ELSE 'rag' END AS route FROM k""")
def model_configs(spark, sf_dir):
    """One conversation in five asks for rag itself."""
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    rows = t.select("conv_id", "turn", S.classify(F.col("text")).alias("kind"), F.when(F.col("conv_id") % 5 == 0, "rag").when(F.col("conv_id") % 5 == 1, "other").alias("wish"))
    m = S.model_config(F.col("kind"))
    return rows.select("conv_id", "turn", F.concat_ws("|", m["mode"], m["max_tokens"]).alias("model"), S.route(F.col("kind"), F.col("wish")).alias("route"))


@query(f"""WITH {BLOCKS}, n AS (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS h FROM (SELECT *
        FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8) GROUP BY 1),
    b AS (SELECT doc_id, string_agg('[' || doc_id || '_' || pos || '] ' || left(content, 1200), chr(10) ORDER BY pos) AS c, count(*) AS n FROM blocks
        WHERE pos < 3 GROUP BY 1)
    SELECT q.conv_id AS query_id, md5('overview:' || chr(10) || coalesce(lang,
        '') || chr(10) || chr(10) || 'history:' || chr(10) || h || chr(10) || chr(10) || 'chunks:' || chr(10) || coalesce(c,
        '') || chr(10) || chr(10) || 'question:' || chr(10) || q.text) AS digest, coalesce(n, 0) AS n_blocks
    FROM (SELECT * FROM conversations WHERE turn = 0) q JOIN n USING (conv_id) LEFT JOIN b ON b.doc_id = conv_id LEFT JOIN documents d ON d.doc_id = conv_id""")
def prompt_assembly(spark, sf_dir):
    """First turns as questions to the document of their number, its first three lines as context."""
    t, b = table(spark, sf_dir, "conversations"), blocks(spark, sf_dir)
    q = t.where("turn = 0").select(F.col("conv_id").alias("query_id"), "conv_id", F.col("conv_id").alias("doc_id"), F.col("text").alias("question"))
    context = b.where("pos < 3").select(F.col("doc_id").alias("query_id"), F.col("pos").alias("place"), F.concat_ws("_", "doc_id", "pos").alias("chunk_id"), "content")
    found = S.prompts(q, context, t, table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("overview")))
    return found.select("query_id", F.md5(F.col("prompt").cast("binary")).alias("digest"), "n_blocks")


PAYLOADS = ['{"answer": "a", "cited_chunk_ids": [1], "claim_evidence_map": {"x": ["1"]}, "follow_up_questions": [], "insufficient_evidence": false}', '{"answer": 5, "cited_chunk_ids": {}, "claim_evidence_map": [], "insufficient_evidence": "no"}', "[1, 2]", "no json"]
CHECKS = {"string": "VARCHAR", "list": "ARRAY", "object": "OBJECT", "boolean": "BOOLEAN"}
KEYS = sorted(E.PAYLOAD)


@query(f"""WITH p AS (SELECT conv_id, TRY_CAST(({PAYLOADS!r})[conv_id % 4 + 1] AS JSON) AS j FROM conversations
        WHERE turn = 0), o AS (SELECT conv_id, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j FROM p),
    c AS (SELECT conv_id, list_filter([{", ".join(f"CASE WHEN json_type(j, '$.{k}') IS NULL THEN '{k}' END" for k in KEYS)}],
        lambda x: x IS NOT NULL) AS m, list_filter([{", ".join(f"CASE WHEN json_type(j, '$.{k}') != '{CHECKS[E.PAYLOAD[k]]}' THEN '{k} must be {E.PAYLOAD[k]}' END" for k in KEYS)}], lambda x: x IS NOT NULL) AS t FROM o)
    SELECT conv_id, len(m) + len(t) = 0 AS valid, array_to_string(m, ',') AS missing, array_to_string(t, ',') AS type_errors FROM c""")
def payload_validation(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, PAYLOADS)), (F.col("conv_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", E.validate(text).alias("v"))
    return rows.select("conv_id", "v.valid", F.array_join("v.missing", ",").alias("missing"), F.array_join("v.type_errors", ",").alias("type_errors"))


@query("""SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'given:1' WHEN trim(coalesce(text,
        '')) != '' THEN trim(text) || ':c1,c2' ELSE '' END AS claims FROM conversations WHERE turn = 1""")
def claim_maps(spark, sf_dir):
    given = F.when(F.col("conv_id") % 2 == 0, F.create_map(F.lit("given"), F.array(F.lit("1"))))
    rows = table(spark, sf_dir, "conversations").where("turn = 1").select("conv_id", E.claim_map(given, F.col("text"), F.array(F.lit("c1"), F.lit("c2"))).alias("m"))
    return rows.select("conv_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ","))), ";").alias("claims"))


STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
EV = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+(?:''[a-z0-9]+)?|[一-鿿]{{2,}}'), lambda t: length(t) > 1 AND t NOT IN ({STOP})))"
CITED = f"""{BLOCKS}, claims AS (SELECT conv_id AS answer_id, text AS claim FROM conversations WHERE turn = 1),
    cites AS (SELECT answer_id, answer_id * 3 + k AS doc_id, CAST(k * 2 AS BIGINT) AS pos FROM claims, (SELECT unnest([0, 1, 2]) AS k) WHERE answer_id % 5 != 0),
    resolved AS (SELECT answer_id, doc_id, pos, b.content IS NOT NULL AS found, b.content FROM cites LEFT JOIN blocks b USING (doc_id, pos)),
    ev AS (SELECT answer_id, list_distinct(flatten(list({EV('content')}))) AS e FROM resolved WHERE found GROUP BY 1),
    s AS (SELECT answer_id, round(CASE WHEN len(c) = 0 THEN 0 ELSE coalesce(len(list_intersect(c, e)), 0) / len(c) END, 4) AS score
        FROM (SELECT answer_id, {EV('claim')} AS c FROM claims) LEFT JOIN ev USING (answer_id))"""


def cited(spark, sf_dir):
    """Second turns as claims; four in five cite lines 0, 2 and 4 of three documents, of which some aren't there."""
    claims = table(spark, sf_dir, "conversations").where("turn = 1").select(F.col("conv_id").alias("answer_id"), F.col("text").alias("claim"))
    k = F.explode(F.array(*map(F.lit, (0, 1, 2))))
    cites = claims.where("answer_id % 5 != 0").select("answer_id", k.alias("k")).select("answer_id", (F.col("answer_id") * 3 + F.col("k")).alias("doc_id"), (F.col("k") * 2).cast("long").alias("pos"))
    return claims, E.resolve(cites, blocks(spark, sf_dir))


@query(f"WITH {CITED} SELECT answer_id, doc_id, pos, found FROM resolved")
def citation_resolve(spark, sf_dir):
    return cited(spark, sf_dir)[1].select("answer_id", "doc_id", "pos", "found")


@query(f"""WITH {CITED} SELECT answer_id, score, CASE WHEN score >= 0.65 THEN 'strong' WHEN score >= 0.35 THEN 'partial' WHEN score > 0 THEN 'weak'
        ELSE 'none' END AS level FROM s""")
def support_score(spark, sf_dir):
    return E.support(*cited(spark, sf_dir))


@query(f"""WITH {CITED}, c AS (SELECT answer_id, count(*) AS n_cited, count(*) FILTER (NOT found) AS n_invalid, round(avg(CAST(found AS INTEGER)),
        4) AS exist_rate FROM resolved GROUP BY 1)
    SELECT answer_id, coalesce(n_cited, 0) AS n_cited, coalesce(n_invalid, 0) AS n_invalid, coalesce(exist_rate, 0) AS exist_rate, score,
        n_cited IS NULL AS missing_citation FROM s LEFT JOIN c USING (answer_id)""")
def trace_rollup(spark, sf_dir):
    claims, resolved = cited(spark, sf_dir)
    return E.consistency(resolved, E.support(claims, resolved).select("answer_id", "score"))


TASKS = "t AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'processing' END AS status, o_orderpriority AS priority, o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS lock_expires_at FROM orders)"


def tasks(spark, sf_dir):
    """Orders as tasks."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("processing")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"), status.alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("lock_expires_at")
    )


@query(f"WITH {TASKS} SELECT task_id, priority FROM t WHERE status = 'pending' ORDER BY priority DESC, created_at, task_id LIMIT 50")
def task_queue(spark, sf_dir):
    return T.queue(tasks(spark, sf_dir), 50).select("task_id", "priority")


@query(f"WITH {TASKS} SELECT task_id, status FROM t WHERE status = 'done' ORDER BY created_at DESC, task_id LIMIT 40 OFFSET 20")
def task_page(spark, sf_dir):
    return T.listing(tasks(spark, sf_dir), 20, 40, status="done").select("task_id", "status")


@query(f"WITH {TASKS} SELECT status, count(*) AS n FROM t GROUP BY status")
def task_status_counts(spark, sf_dir):
    return tasks(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TASKS} SELECT task_id FROM t WHERE status = 'processing' AND lock_expires_at < TIMESTAMP '1996-06-17'")
def task_expired(spark, sf_dir):
    return T.expired(tasks(spark, sf_dir), F.lit("1996-06-17").cast("timestamp")).select("task_id")


@query(f"WITH {TASKS} SELECT task_id, status FROM t WHERE NOT (status = 'done' AND created_at < TIMESTAMP '1997-01-01')")
def task_cleanup(spark, sf_dir):
    return T.without_old(tasks(spark, sf_dir), F.lit("1997-01-01").cast("timestamp"), ["done"]).select("task_id", "status")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def cascade_delete(spark, sf_dir):
    """Labels left when German documents go."""
    gone = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id")
    return T.delete_cascade(gone, table(spark, sf_dir, "labels"))[0].select("doc_id", "quality", "toxic")


@query(f"""WITH {CITED}, c AS (SELECT answer_id, doc_id, pos, row_number() OVER (PARTITION BY answer_id ORDER BY doc_id DESC, pos) AS place FROM cites
        QUALIFY place <= 2) SELECT answer_id, place, doc_id, pos, coalesce(left(b.content, 220), '') AS preview FROM c LEFT
        JOIN blocks b USING (doc_id, pos)""")
def evidence_preview(spark, sf_dir):
    cites = cited(spark, sf_dir)[1].select("answer_id", "doc_id", "pos", (-F.col("doc_id")).alias("place"))
    return E.preview(cites, blocks(spark, sf_dir), most=2)


@query(f"""WITH {CITED}, c AS (SELECT answer_id, count(*) FILTER (NOT found) AS n_invalid, avg(CAST(found AS INTEGER)) AS er FROM resolved
        GROUP BY 1), t AS (SELECT answer_id % 3 AS kind, coalesce(n_invalid, 0) AS n_invalid, round(coalesce(er, 0), 4) AS er, score,
        er IS NULL AS missing FROM s LEFT JOIN c USING (answer_id))
    SELECT kind, count(*) AS total, round(avg(er), 4) AS exist_rate, round(avg(score), 4) AS mean_support, sum(n_invalid)::BIGINT AS n_invalid,
        round(count(*) FILTER (missing) / count(*), 4) AS missing_rate FROM t GROUP BY kind""")
def trace_summary(spark, sf_dir):
    return E.task_summary(trace_rollup(spark, sf_dir).withColumn("kind", F.col("answer_id") % 3))


@query(f"""WITH {TASKS}, x AS (SELECT task_id, task_id % 4 AS retry_count, 3 AS max_retries, created_at AS started_at,
        CASE WHEN status = 'done' THEN created_at + INTERVAL 90 SECOND END AS completed_at, lock_expires_at FROM t)
    SELECT task_id, lock_expires_at > TIMESTAMP '1996-06-17' AS is_locked, lock_expires_at <= TIMESTAMP '1996-06-17' AS is_expired,
        retry_count < max_retries AS can_retry, CASE WHEN completed_at IS NOT NULL THEN 90.0::DOUBLE END AS seconds FROM x""")
def task_state(spark, sf_dir):
    done = F.when(F.col("status") == "done", F.col("created_at") + F.expr("INTERVAL 90 SECOND"))
    t = tasks(spark, sf_dir).withColumns({"retry_count": F.col("task_id") % 4, "max_retries": F.lit(3), "started_at": F.col("created_at"), "completed_at": done})
    instant = lambda c: F.col(c).cast("timestamp").alias(c)
    t = t.select("task_id", "retry_count", "max_retries", instant("started_at"), instant("completed_at"), instant("lock_expires_at"))
    return T.state(t, F.lit("1996-06-17").cast("timestamp")).select("task_id", "is_locked", "is_expired", "can_retry", "seconds")


@query(f"""WITH {TASKS}, n AS (SELECT task_id, CASE WHEN task_id % 10 = 0 THEN 'cancelled' ELSE status END AS status, priority FROM t) SELECT * FROM n
        UNION ALL SELECT -1, 'pending', '1-URGENT'""")
def task_edit(spark, sf_dir):
    """A task is created, one that is there already isn't, and every tenth is cancelled."""
    t = tasks(spark, sf_dir).select("task_id", "status", "priority")
    new = t.orderBy("task_id").limit(1).select("task_id", F.lit("lost").alias("status"), F.lit("lost").alias("priority")).unionByName(spark.createDataFrame([(-1, "pending", "1-URGENT")], "task_id long, status string, priority string"))
    changes = t.where("task_id % 10 = 0").select("task_id", F.lit("cancelled").alias("status"), F.lit(None).cast("string").alias("priority"))
    return T.updated(T.created(t, new), changes)


@query(f"""WITH {TASKS} SELECT task_id, status = 'pending' OR (status = 'processing' AND lock_expires_at < TIMESTAMP '1996-06-17') AS claimable,
        least(3600.0::DOUBLE, 60.0::DOUBLE * 2 ** (task_id % 8)) AS delay FROM t""")
def task_claims(spark, sf_dir):
    return tasks(spark, sf_dir).select("task_id", T.claimable(F.lit("1996-06-17").cast("timestamp")).alias("claimable"), T.retry_delay(F.col("task_id") % 8).alias("delay"))


@query(f"""WITH {TASKS}, x AS (SELECT task_id, status, task_id % 5 AS retry_count, 3 AS max_retries, ['timeout', 'not_found', 'odd', 'invalid_input',
        NULL][task_id % 5 + 1] AS error_type FROM t WHERE status = 'processing'),
    d AS (SELECT *, retry_count < max_retries AND coalesce(error_type, '') NOT IN ('not_found', 'invalid_input') AS again FROM x)
    SELECT task_id, CASE WHEN again THEN 'pending' ELSE 'dead_letter' END AS status,
        CASE WHEN again THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN again THEN least(3600.0::DOUBLE,
        60.0::DOUBLE * 2 ** retry_count) END AS delay FROM d""")
def task_failures(spark, sf_dir):
    """All tasks that are being processed fail, by different errors."""
    t = tasks(spark, sf_dir).where("status = 'processing'").withColumns({"retry_count": F.col("task_id") % 5, "max_retries": F.lit(3), "progress": F.lit(50.0)})
    kinds = F.array(*[F.lit(k) for k in ("timeout", "not_found", "odd", "invalid_input", None)])
    failures = t.select("task_id", F.get(kinds, (F.col("task_id") % 5).cast("int")).alias("error_type"), F.lit("failed").alias("error_message"))
    return T.failed(t, failures, F.lit("1996-06-17").cast("timestamp")).select("task_id", "status", F.col("retry_count").cast("long").alias("retry_count"), "delay")
