"""Knowledge graphs: extraction by rule, cleaning, building from events, bounded queries."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as X

# Names that are known, matched as substrings; words that are no names; relations by verb; relation types that count.
DATASETS = [
    "squad", "squadv2", "squad 2", "msmarco", "natural questions", "triviaqa", "quasar", "searchqa", "hotpotqa", "narrativeqa", "qasper", "duorc",
    "race", "multirc", "record", "wmt", "iwslt", "opus", "commoncrawl", "bookscorpus", "wikipedia", "imagenet", "coco", "mnist",
    "cifar", "glue", "superglue", "blimp", "hellaswag", "arc", "mmlu",
]
METRICS = [
    "f1", "exact match", "em", "bleu", "rouge", "rouge-l", "meteor", "bleu-1", "bleu-2", "bleu-3", "bleu-4", "accuracy",
    "precision", "recall", "perplexity", "wer", "cer", "map", "ndcg", "mrr", "bertscore", "bleurt",
]
METHODS = [
    "bert", "gpt", "gpt-2", "gpt-3", "gpt-4", "transformer", "transformers", "lstm", "gru", "rnn", "cnn", "attention",
    "self-attention", "roberta", "xlnet", "albert", "distilbert", "electra", "deberta", "t5", "bart", "pegasus", "mbart", "xlm-roberta",
    "xlm", "word2vec", "glove", "fasttext", "elmo", "ulmfit", "seq2seq", "encoder-decoder", "pointer-generator", "copynet", "beam search", "greedy decoding",
    "nucleus sampling", "knowledge graph", "knowledge graph completion", "faiss", "tf-idf", "bm25", "bm25f", "rag", "retrieval-augmented generation",
]
CHINESE_TERMS = """深度学习|机器学习|自然语言处理|计算机视觉|知识图谱|向量数据库|大语言模型|注意力机制|卷积神经网络|循环神经网络|生成对抗网络|强化学习|迁移学习|预训练|微调|嵌入|分词|词向量|特征提取|模型训练|模型推理|数据增强
批归一化|Dropout|损失函数|优化器|学习率|梯度下降|反向传播|超参数|验证集|测试集|训练集|过拟合|欠拟合|正则化|注意力|编码器|解码器|自监督|对比学习|多模态|端到端""".replace("\n", "|")
COMMON = """the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought to of in for on with at by from as
into through during before after above below between out off over under again further then once here there when where why how all both each few more most other some such no nor
not only own same so than too very just this that these those it its we our you your they their he she his her which what who whom because but and or if while
figure table section equation paper work also however therefore thus furthermore moreover e.g i.e etc vs ie eg""".split()
NOISE = COMMON + ["et", "al", "fig", "tab", "sec", "eq"]
QUOTED_STOP = COMMON + ["used", "approach", "method", "model", "result", "results", "data", "set", "task"]
VERBS = {
    "USES": r"uses?|utilizes?|employs?|leverages?",
    "EVALUATES_ON": r"(?:evaluates?|evaluated|tests?|tested)\s+(?:on|against)",
    "ACHIEVES": r"achieves?|achieved|attains?|reaches?",
    "BASED_ON": r"based\s+on|builds?\s+(?:on|upon)|extends?|improves?",
    "PROPOSES": r"proposes?|proposed|introduces?|presents?",
    "BELONGS_TO": r"belongs?\s+to|is\s+(?:a|an)\s+kind\s+of|is\s+(?:a|an)\s+type\s+of",
    "DEPENDS_ON": r"depends?\s+on|requires?|needs?",
    "COMPARES_WITH": r"compares?\s+(?:with|to)|outperforms?|surpasses?|beats?",
    "CONTAINS": r"contains?|includes?|comprises?|consists?\s+of",
    "PART_OF": r"is\s+part\s+of|belongs?\s+to",
}


def rule_entities(blocks: DataFrame, title: Column | None = None) -> DataFrame:
    """doc_id, pos, name, type, confidence, source of each block, each name once for a rule: ten families of rules. title: the block's section title, if any.

    Known names count as substrings, in the case in which the text has them first.
    """
    text, low = F.col("content"), F.col("low")  # a column: in a lambda an expression is computed for each name
    entity = lambda name, kind, confidence, source: F.struct(name.alias("name"), kind.alias("type"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))
    cased = lambda n: F.when(F.lower(n).isin(DATASETS), "Dataset").when(F.lower(n).isin(METRICS), "Metric").when(F.lower(n).isin(METHODS), "Method").otherwise("Concept")
    every = lambda pattern, group: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), X.strip))

    none = F.array().cast("array<struct<name:string,type:string,confidence:double,source:string>>")
    wide = text.rlike("[^\\x00-\\x7F]")

    def rule(pattern, group, kind, confidence, source, least=1, stop=(), where=None):
        """`where`: what a text has to have for the pattern to be tried."""
        kept = F.filter(every(pattern, group), lambda n: (F.length(n) >= least) & (~F.lower(n).isin(list(stop)) if stop else F.lit(True)))
        found = F.transform(kept, lambda n: entity(n, kind(n) if callable(kind) else F.lit(kind), confidence, source))
        return found if where is None else F.when(where, found).otherwise(none)

    def known(names, kind, source):
        there = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(low, n))
        return F.transform(there, lambda n: entity(F.substring(text, F.position(n, low), F.length(n)), F.lit(kind), 0.85, source))

    found = F.concat(
        rule(r"([A-Z][a-zA-Z\s]{2,30})\s*\([A-Z]{2,6}\)", 1, "Method", 0.9, "rule_paren_acronym", where=F.contains(text, F.lit("("))),
        rule(r"\b([A-Z]{2,6})\b", 1, cased, 0.7, "rule_acronym"),
        rule(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", 1, "Concept", 0.5, "rule_capitalized", 4),
        rule('"([^"]{2,50})"', 1, "Concept", 0.6, "rule_quoted", 3, QUOTED_STOP, F.contains(text, F.lit('"'))),
        known(DATASETS, "Dataset", "rule_known_dataset"),
        known(METRICS, "Metric", "rule_known_metric"),
        rule(f"({CHINESE_TERMS})", 1, "Concept", 0.8, "rule_chinese_tech", where=wide | F.contains(text, F.lit("Dropout"))),
        rule("[“”「」]([^“”「」]{2,30})[“”「」]", 1, "Concept", 0.6, "rule_chinese_quoted", 2, where=wide),
        rule(r"([一-鿿]{2,15})\s*[（(]\s*[A-Za-z][A-Za-z0-9_\-]*\s*[）)]", 1, "Method", 0.85, "rule_cn_en_pair", 2, where=wide),
    )
    if title is not None:
        found = F.concat(found, F.when(F.length(F.trim(title)) >= 2, F.array(entity(F.trim(title), F.lit("Section"), 1.0, "rule_section"))).otherwise(none))
    return blocks.withColumn("low", F.lower("content")).select("doc_id", "pos", F.explode(found).alias("e")).select("doc_id", "pos", "e.*")


def is_noise(name: Column) -> Column:
    n = F.trim(name)
    upper = (n == F.upper(n)) & (n != F.lower(n))
    common = F.regexp_replace(F.lower(n), r"^[.,;:]+|[.,;:]+$", "").isin(NOISE)
    return (F.length(n) <= 1) | ((F.length(n) <= 2) & ~upper) | n.rlike(r"^[0-9.\-]+$") | common | (F.length(n) > 100) | ~n.rlike(r"[\p{L}\p{N}]") | (n.contains("<") & n.contains(">")) | n.startswith(">")


def clean_name(name: Column) -> Column:
    """One space between words, no punctuation at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", " "), r"""^[.,;:!?()\[\]{}"'\-]+|[.,;:!?()\[\]{}"'\-]+$""", "")


def dedup_entities(entities: DataFrame) -> DataFrame:
    """key, type, name, confidence, n: entities of one clean lower-case name and type, with the most confident's name (ties: the first by name)."""
    e = entities.where(~is_noise(F.col("name"))).withColumn("key", F.lower(clean_name(F.col("name"))))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "name"))
    return e.groupBy("key", "type").agg(best.alias("b"), F.count(F.lit(1)).alias("n")).select("key", "type", F.col("b.name").alias("name"), (-F.col("b.c")).alias("confidence"), "n")


def cooccurring(entities: DataFrame) -> DataFrame:
    """doc_id, pos, key_a, key_b, relation, confidence: methods with datasets, metrics and other methods (once, by name) of the same block. A block has few names: they meet in one row."""
    e = entities.where("type in ('Method', 'Dataset', 'Metric')").select("doc_id", "pos", F.struct("type", F.lower(clean_name(F.col("name"))).alias("key")).alias("e"))
    blocks = e.groupBy("doc_id", "pos").agg(F.collect_set("e").alias("names"))
    methods = F.filter("names", lambda a: a["type"] == "Method")
    others = lambda a: F.filter("names", lambda b: (b["type"] != "Method") | (a["key"] < b["key"]))
    pairs = F.flatten(F.transform(methods, lambda a: F.transform(others(a), lambda b: F.struct(a["key"].alias("key_a"), b["key"].alias("key_b"), b["type"].alias("type")))))
    both = blocks.where(F.size("names") > 1).select("doc_id", "pos", F.explode(pairs).alias("p")).select("doc_id", "pos", "p.*")
    relation = F.when(F.col("type") == "Dataset", "EVALUATES_ON").when(F.col("type") == "Metric", "ACHIEVES").otherwise("COMPARES_WITH")
    confidence = F.when(F.col("type") == "Dataset", 0.5).when(F.col("type") == "Metric", 0.4).otherwise(0.35)
    return both.select("doc_id", "pos", "key_a", "key_b", relation.alias("relation"), confidence.alias("confidence"))


def cooccurrences(entities: DataFrame) -> DataFrame:
    """key_a, key_b, relation, confidence, n: cooccurring pairs and in how many blocks they stand."""
    return cooccurring(entities).groupBy("key_a", "key_b", "relation", "confidence").agg(F.count(F.lit(1)).alias("n"))


def uncovered_pairs(entities: DataFrame, covered: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, pos, key_a, key_b, place: for a model outside, the first `most` pairs of a block's names (by clean lower-case name, key_a < key_b, in that order) that no relation of the
    block connects either way. covered: (doc_id, pos, a, b).

    Of a block's pairs only as many are made as could be needed: its covered ones and `most` more, so a block of many names isn't paired out.
    """
    names = entities.where(~is_noise(F.col("name"))).groupBy("doc_id", "pos").agg(F.array_sort(F.collect_set(F.lower(clean_name(F.col("name"))))).alias("names"))
    known = covered.where("a != b").groupBy("doc_id", "pos").agg(F.collect_set(F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("known"))
    both = names.where(F.size("names") > 1).join(known, ["doc_id", "pos"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<a:string,b:string>>")))
    need = F.size("known") + most
    pairs = F.flatten(F.transform(F.slice("names", F.lit(1), need), lambda a, k: F.transform(F.slice("names", k + 2, need), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    left = F.slice(F.array_except(pairs, "known"), 1, most)
    return both.select("doc_id", "pos", F.posexplode(left).alias("k", "p")).select("doc_id", "pos", F.col("p.a").alias("key_a"), F.col("p.b").alias("key_b"), (F.col("k") + 1).cast("long").alias("place"))


def verb_relations(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, source, relation, target: word, verb, word; letters of any script make words.

    A match begins where a word does, and words and blanks are taken whole: no shorter beginning or end of one could match. Each text is searched once for a relation.
    """
    low, letter = F.col("low"), r"[\p{L}\p{N}_]"

    def of(relation, verbs):
        found = F.regexp_extract_all(low, F.lit(rf"(?<!{letter}){letter}++\s++(?:{verbs})\s++{letter}++"), F.lit(0))
        word = lambda x, pattern: F.regexp_extract(x, pattern, 0)
        return F.transform(found, lambda x: F.struct(word(x, rf"^{letter}+").alias("source"), F.lit(relation).alias("relation"), word(x, rf"(?<!{letter}){letter}+$").alias("target")))

    return blocks.select("doc_id", "pos", F.lower("content").alias("low")).select("doc_id", "pos", F.explode(F.concat(*[of(r, v) for r, v in VERBS.items()])).alias("r")).select("doc_id", "pos", "r.*")


def resolved_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, pos, source, relation, target: `relations` whose words stand for entities of the block: the one of that name, else the first, by name, that
    holds the word or that the word holds. Those that stand for one entity, or for none, are dropped."""
    names = entities.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("names"))
    pick = lambda w: F.coalesce(F.get(F.filter("names", lambda n: n == F.col(w)), F.lit(0)), F.get(F.filter("names", lambda n: F.contains(F.col(w), n) | F.contains(n, F.col(w))), F.lit(0)))
    # what is picked is filtered where it is made: a filter beside it would pick again
    both = F.filter(F.array(F.struct(pick("source").alias("source"), "relation", pick("target").alias("target"))), lambda r: r["source"] != r["target"])
    return relations.join(names, ["doc_id", "pos"]).select("doc_id", "pos", F.explode(both).alias("r")).select("doc_id", "pos", "r.*")


def contains_edges(filled: DataFrame) -> DataFrame:
    """src, tgt, relation, confidence: each document's sections and each section's blocks, from structure.fill_sections."""
    section = F.concat(F.lit("section_"), F.col("doc_id"), F.lit("_"), F.col("section_pos"))
    inside = filled.where("section_pos is not null")
    blocks = inside.select(section.alias("src"), F.concat(F.lit("chunk_"), F.col("doc_id"), F.lit("_"), F.col("pos")).alias("tgt"))
    docs = inside.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("src"), section.alias("tgt")).distinct()
    return blocks.unionByName(docs).select("src", "tgt", F.lit("CONTAINS").alias("relation"), F.lit(1.0).alias("confidence"))


def clean_relations(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """src, tgt, relation, confidence: `relations` of a known type with a confidence of .25 or more between different nodes that have names and are in `ids` (id) or are
    structural; each once, with its largest confidence."""
    good = relations.where((F.col("confidence") >= 0.25) & (F.col("src") != F.col("tgt")) & (F.trim("src") != "") & (F.trim("tgt") != "") & F.col("relation").isin(list(VERBS)))
    known = ids.select("id").distinct().withColumn("there", F.lit(True))
    for end in ("src", "tgt"):
        marked = good.join(known.select(F.col("id").alias(end), "there"), end, "left")
        good = marked.where(F.col("there") | F.col(end).rlike("^(section_|chunk_|doc_)")).drop("there")
    return upsert_edges(good)


def remapped(relations: DataFrame, merged: DataFrame) -> DataFrame:
    """`relations` (src, tgt, ...) whose ends have the name that stands for their group in `merged` (name, merged)."""
    for end in ("src", "tgt"):
        of = merged.select(F.col("name").alias(end), "merged").dropDuplicates([end])
        relations = relations.join(of, end, "left").withColumn(end, F.coalesce("merged", end)).drop("merged")
    return relations


def cleaning_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """part (raw, cleaned), by (type, source, all), value, n, share: distributions of entities before and after cleaning."""
    out = None
    for part, df in (("raw", raw), ("cleaned", cleaned)):
        named = [c for c in ("type", "source") if c in df.columns]
        pairs = F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("value")) for c in named], F.struct(F.lit("all").alias("by"), F.lit("").alias("value")))
        n = df.select(F.explode(pairs).alias("p")).groupBy("p.by", "p.value").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(part))
        out = n if out is None else out.unionByName(n)
    whole = F.sum(F.when(F.col("by") == "all", F.col("n"))).over(Window.partitionBy("part"))
    return out.select("part", "by", "value", "n", F.round(F.col("n") / whole, 4).alias("share"))


def graph_nodes(filled: DataFrame, entities: DataFrame) -> DataFrame:
    """id, type, name: documents, sections and blocks of structure.fill_sections, and cleaned entities (key, type, name)."""
    d, p = F.col("doc_id").cast("string"), F.col("pos").cast("string")
    made = lambda kind, prefix, *parts: F.struct(F.concat(F.lit(prefix), *parts).alias("id"), F.lit(kind).alias("type"), F.concat(*parts).alias("name"))
    each = F.array_compact(F.array(
        F.when(F.col("pos") == 0, made("Document", "doc_", d)), F.when(F.col("is_heading"), made("Section", "section_", d, F.lit("_"), p)), made("Chunk", "chunk_", d, F.lit("_"), p),
    ))
    nodes = filled.select(F.explode(each).alias("n")).select("n.*")
    return nodes.unionByName(entities.select(F.concat(F.lit("entity_"), F.lower("type"), F.lit("_"), "key").alias("id"), "type", "name"))


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Each node once: a field that `old` has stays, missing ones are filled from `new`."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    fields = [c for c in both.columns if c not in (key, "_turn")]
    kept = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_turn")))
    return both.groupBy(key).agg(*[kept(c).alias(c) for c in fields])


def name_likeness(a: str, b: str) -> float:
    """1 for equal names, .95 for an acronym, .9 for a part, else the matcher's ratio, which depends on the order."""
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.9
    for one, many in ((a.split(), b.split()), (b.split(), a.split())):
        if len(one) == 1 and len(many) >= 2 and one[0] == "".join(w[0] for w in many):
            return 0.95
    return SequenceMatcher(None, a, b).ratio()


def shared_run(total: int, least: float) -> int:
    """The letters in a row that two names of `total` letters together have in common at least, if they are `least` alike by the matcher.

    The matcher finds m letters in blocks, in order, with 2 m / total >= least; between two blocks stands a letter of one name only, so there are total - 2 m + 1 blocks at most.
    """
    few = -int(-(least * total - 1e-9) // 2)  # the least m
    return min(-(-m // (total - 2 * m + 1)) for m in range(few, total // 2 + 1)) if 0 < few <= total // 2 else 0


def gram_sizes(least: float) -> tuple[int, dict[int, int]]:
    """(size, shorter): all names `least` alike have `size` letters in a row in common, but for those whose total length is in `shorter`, which have as many as it says."""
    size = -int(-(least / (2 * (1 - least)) - 1e-9) // 1)  # what the bound comes to for long names
    far = int((2 * size + 4) / max(least - 2 * (1 - least) * (size - 1), 1e-3)) + 1  # from here on it holds
    shorter = {t: n for t in range(2, far + 1) if 0 < (n := shared_run(t, least)) < size}
    return size, shorter


#: Names of a block: all pairs of two blocks are looked at in one task. Names longer than LETTERS are compared without a bound by their common letters in order.
LIKE_BLOCK, LETTERS = 2000, 64
#: Pairs that are bounded at once.
LIKE_PAIRS = 1 << 17


def common_in_order(x: list[str], y: list[str], i, j):
    """For each pair of x[i] and y[j], of LETTERS letters at most: the most letters that both have in the same order, as bits of one word for each pair."""
    import numpy as np

    known: dict[str, int] = {}
    codes = np.zeros((len(y), LETTERS), np.int32)  # 0: behind the end
    for row, text in zip(codes, y):
        if len(text) <= LETTERS:
            row[: len(text)] = [known.setdefault(c, len(known) + 1) for c in text]
    masks = np.zeros((len(x), len(known) + 1), np.uint64)
    for row, text in zip(masks, x):
        for at, c in enumerate(text[:LETTERS]):
            if c in known:
                row[known[c]] |= np.uint64(1 << at)
    out = np.empty(len(i), np.int64)
    for first in range(0, len(i), LIKE_PAIRS):
        a, b = i[first : first + LIKE_PAIRS], j[first : first + LIKE_PAIRS]
        left = np.full(len(a), ~np.uint64(0))
        for at in range(int(max((len(y[k]) for k in np.unique(b)), default=0))):
            met = left & masks[a, codes[b, at]]
            left = (left + met) | (left - met)
        out[first : first + LIKE_PAIRS] = np.bitwise_count(~left)
    return out


def like_pairs(x: list[str], y: list[str] | None, least: float):
    """(i, j): which x[i] and y[j] (or x[j], i < j, if y is None) are `least` alike by name_likeness, acronyms aside.

    The matcher finds no more letters than both have at all, nor than both have in order: only pairs for which that is enough are compared. A part has all its letters in the whole.
    """
    import numpy as np

    low = [[n.lower().strip() for n in side] for side in ([x] if y is None else [x, y])]
    wide = np.uint8 if max((len(n) for side in low for n in side), default=0) < 256 else np.int32
    counts = [np.ascontiguousarray(letter_counts(side).T.astype(wide)) for side in low]
    sizes = [np.array([len(n) for n in side]) for side in low]
    own, its = low[0], low[-1]
    found: list[tuple[int, int]] = []
    doubtful: list[np.ndarray] = []

    def settle():
        both = np.concatenate(doubtful, 1)
        doubtful.clear()
        i, j = both
        total = sizes[0][i] + sizes[-1][j]
        short = (sizes[0][i] <= LETTERS) & (sizes[-1][j] <= LETTERS)
        order = np.full(len(i), 1 << 30)
        order[short] = common_in_order(own, its, i[short], j[short])
        for a, b in both[:, 2 * order >= least * total - 1e-9].T.tolist():
            one, other = sorted((x[a], (x if y is None else y)[b]))
            if name_likeness(one, other) >= least:
                found.append((a, b))

    for i, name in enumerate(own):
        begin = i + 1 if y is None else 0
        common = np.zeros(len(its) - begin, wide)
        for k in np.flatnonzero(counts[0][:, i]):
            common += np.minimum(counts[-1][k, begin:], counts[0][k, i])
        n = sizes[-1][begin:]
        part = np.flatnonzero(common >= np.minimum(n, len(name)))
        held = [j for j in part.tolist() if name in its[begin + j] or its[begin + j] in name]
        found += [(i, begin + j) for j in held if name_likeness(name, its[begin + j]) >= least]
        alike = 2 * common.astype(np.int32) >= least * (n + len(name)) - 1e-9
        alike[held] = False
        near = np.flatnonzero(alike) + begin
        if len(near):
            doubtful.append(np.stack([np.full(len(near), i), near]))
        if sum(d.shape[1] for d in doubtful[-64:]) >= LIKE_PAIRS or len(doubtful) >= 64:
            settle()
    if doubtful:
        settle()
    return found


def like_names(entities: DataFrame, least: float = 0.85) -> DataFrame:
    """type, a, b, a < b: names of a type that are `least` alike, by name_likeness. No pair is passed over.

    Names that have a run in common may be nearly all of a type, so pairs are never rows: a type's names are dealt to blocks of about LIKE_BLOCK, each two blocks meet in one
    group, and bounds by counts of letters leave few pairs to the matcher. Work grows with the square of a type's names, at some nanoseconds a pair; a group's memory doesn't.
    An acronym meets the initials in an equi-join.
    """
    if not 0.7 <= least < 1:
        raise ValueError("the likeness has to be .7 or more, and less than 1")
    names = entities.select("type", "name").where(F.trim("name") != "").distinct()
    blocks = names.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / LIKE_BLOCK).cast("int").alias("blocks"))
    groups = blocks.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    placed = names.join(blocks, "type").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = other.select("type", "name", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).alias("second"))
    kind = entities.schema["type"].dataType.simpleString()

    def meet(rows):
        import pyarrow as pa

        name, second = rows.column("name").to_pylist(), rows.column("second").to_pylist()
        apart = rows.column("x")[0] != rows.column("y")[0]
        x = [n for n, s in zip(name, second) if not s]
        y = [n for n, s in zip(name, second) if s] if apart else None
        pairs = [sorted((x[i], (x if y is None else y)[j])) for i, j in like_pairs(x, y, least)]
        of = pa.array([0] * len(pairs), pa.int64())
        return pa.table({"type": rows.column("type").combine_chunks().take(of), "a": pa.array([p[0] for p in pairs], pa.string()), "b": pa.array([p[1] for p in pairs], pa.string())})

    # some tasks more than groups: groups are dealt by hash
    dealt = met.repartition(int(min(2 * groups, 4096)), "type", "x", "y")
    pairs = dealt.groupBy("type", "x", "y").applyInArrow(meet, f"type {kind}, a string, b string")
    low = F.lower(F.trim("name"))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    initials = names.where(F.size(words) >= 2).select("type", F.col("name").alias("whole"), F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "").alias("key"))
    acronyms = names.select("type", "name", low.alias("key")).join(initials, ["type", "key"]).where("name != whole")

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [r for r in batch.to_pylist() if name_likeness(r["a"], r["b"]) >= least]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    short = acronyms.select("type", F.least("name", "whole").alias("a"), F.greatest("name", "whole").alias("b")).mapInArrow(compare, f"type {kind}, a string, b string")
    return pairs.unionByName(short).distinct()


def merge_names(entities: DataFrame, least: float = 0.85) -> DataFrame:
    """type, name, merged: greedy groups by the likeness to their first name, in the order of names; the longest name (ties: the first) stands for a group.

    A name begins a group unless an earlier name that does is like it; it joins the earliest such. A round finds names whose earlier neighbours begin none, and drops all links of
    names that are like one of these: which group a name joins needn't be known for it. Links are joined, so no group or type is ever gathered.
    """
    from docspark.operators.scoring import stored

    key = ["type", "name"]
    of = lambda df, end: df.select("type", F.col(end).alias("name")).distinct()
    names = stored(entities.select("type", "name").distinct())
    links = left = stored(like_names(names, least))
    fresh = heads = stored(names.join(of(links, "b"), key, "left_anti"))
    while not fresh.isEmpty():
        joined = stored(of(left.join(fresh.withColumnRenamed("name", "a"), ["type", "a"], "left_semi"), "b"))
        open_links = left
        for end in "ab":
            open_links = open_links.join(joined.withColumnRenamed("name", end), ["type", end], "left_anti")
        open_names, left = of(left, "b").join(joined, key, "left_anti"), stored(open_links)
        fresh = stored(open_names.join(of(left, "b"), key, "left_anti"))
        heads = heads.unionByName(fresh)
    heads = stored(heads)
    first = links.join(heads.withColumnRenamed("name", "a"), ["type", "a"], "left_semi").groupBy("type", F.col("b").alias("name")).agg(F.min("a").alias("head"))
    # a name that begins a group is like no earlier one that does
    settled = stored(names.join(first, key, "left").withColumn("head", F.coalesce("head", "name")))
    best = settled.groupBy("type", "head").agg(F.min(F.struct((-F.length("name")).alias("n"), "name")).alias("best"))
    return settled.join(best, ["type", "head"]).select("type", "name", F.col("best.name").alias("merged"))


#: Names and queries that are compared with each other in one task.
NAMES_BLOCK, QUERY_BLOCK = 20_000, 1000


def letter_counts(texts: list[str]):
    """How often a text has the letters of each of 61 classes."""
    import numpy as np

    out = np.zeros((len(texts), 61), np.int16)
    for row, text in zip(out, texts):
        np.add.at(row, np.frombuffer(text.encode("utf-32-le"), np.uint32) % 61, 1)
    return out


def compared(names, queries, fuzzy: bool = True):
    """query, name, score, tier of all names and queries of a task (Arrow tables); tier 0: equal, 1: .6 alike, 2: one holds the other."""
    import numpy as np
    import pyarrow as pa

    own = queries.column("q").to_pylist()
    counts, size, out = letter_counts(own), np.array([len(q) for q in own]), []
    for batch in names.select(["name"]).to_batches(1000):
        texts = batch.column(0).to_pylist()
        lows = [t.lower().strip() for t in texts]
        for name, low, letters in zip(texts, lows, letter_counts(lows)):
            common = np.minimum(counts, letters).sum(1) if own else np.empty(0)
            may = (2 * common >= 0.6 * (size + len(low)) - 1e-9) | (common >= np.minimum(size, len(low)))
            for k in np.flatnonzero(may):
                q = own[k]
                ratio = 1.0 if q == low else SequenceMatcher(None, q, low).ratio() if fuzzy else 0.0
                tier = 0 if q == low else 1 if ratio >= 0.6 else 2 if q in low or low in q else 3
                if tier < 3:
                    out.append((q, name, ratio if tier < 2 else 0.7, tier))
    return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate({"query": pa.string(), "name": pa.string(), "score": pa.float64(), "tier": pa.int32()}.items())})


def search_names(names: DataFrame, queries: DataFrame, fuzzy: bool = True) -> DataFrame:
    """query, name, score: for each query (query) the names (name) equal to it, score 1; without any, those .6 alike by the matcher; without any, those that hold it or that
    it holds, .7. Letters' case and blanks at the ends don't count. Without `fuzzy` the matcher is left out.

    Queries are a stated batch against all names, in blocks of both. The matcher can't find more letters than two texts have in common, however ordered: pairs with too few
    are ruled out by counts of letters, which are compared as arrays, and only the rest are matched.
    """
    every = names.select("name").where("name is not null").distinct()
    asked = queries.select(F.lower(F.trim("query")).alias("q")).where("q is not null").distinct()
    parts, blocks = max(1, -(-every.count() // NAMES_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = every.select("name", F.pmod(F.xxhash64("name"), F.lit(parts)).alias("part"), numbers(blocks).alias("block"))
    right = asked.select("q", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block"), numbers(parts).alias("part"))
    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(lambda n, q: compared(n, q, fuzzy), "query string, name string, score double, tier int")
    return met.withColumn("best", F.min("tier").over(Window.partitionBy("query"))).where("tier = best").select("query", "name", F.round("score", 6).alias("score"))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """src, tgt, relation, confidence: each edge once, with its largest confidence."""
    return edges.groupBy("src", "tgt", "relation").agg(F.max("confidence").alias("confidence"))


def event_edges(events: DataFrame, root: str = "question_graph") -> DataFrame:
    """src, tgt, relation, weight, n_events of `events` (event_id, question, doc, concept, score): running sums of weights, each rounded to 3 digits. All questions hang on the node `root`.

    The same function serves a batch and a stream in update or complete mode: every aggregate can be merged.
    """
    q, d, c = F.concat(F.lit("question_"), "question"), F.concat(F.lit("doc_"), "doc"), F.concat(F.lit("knowledge_"), "concept")
    edge = lambda s, t, r, w: F.struct(s.alias("src"), t.alias("tgt"), F.lit(r).alias("relation"), w.alias("weight"))
    four = F.array(
        edge(F.lit(root), q, "EXPANDS_FROM", F.lit(1.0)), edge(q, d, "ASKS_ABOUT", F.lit(0.8)), edge(q, c, "FOCUSES_ON", F.col("score")), edge(c, d, "GROUNDED_IN", F.greatest(F.lit(0.4), F.col("score") - 0.1))
    )
    rows = events.select("event_id", F.explode(four).alias("e")).select("event_id", "e.*")
    return rows.groupBy("src", "tgt", "relation").agg(F.round(F.sum(F.round("weight", 3)), 3).alias("weight"), F.count(F.lit(1)).alias("n_events"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "tgt").unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).where("src != tgt").distinct()


def neighbours(edges: DataFrame, nodes: DataFrame, relation: str | None = None) -> DataFrame:
    """node, neighbour, relation, confidence of `nodes` (node), along edges (src, tgt, relation, confidence) either way, or those of one relation: each neighbour once, by its most
    confident edge, ties by the relation. Both ends are added up before neighbours of a node meet."""
    own = edges if relation is None else edges.where(F.col("relation") == relation)
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("tgt").alias("neighbour")), F.struct(F.col("tgt").alias("node"), F.col("src").alias("neighbour")))
    each = own.select(F.explode(ends).alias("e"), "relation", "confidence").select("e.node", "e.neighbour", "relation", "confidence").where("node != neighbour")
    best = each.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node", "neighbour").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "relation")).alias("b"))
    return best.select("node", "neighbour", "b.relation", (-F.col("b.c")).alias("confidence"))


def keyword_candidates(nodes: DataFrame, edges: DataFrame, queries: DataFrame, most: int = 10, near: int = 5, fuzzy: bool = True) -> DataFrame:
    """query_id, rank, id, score, place, neighbour, relation, confidence: the `most` best nodes (id, name) of each of `queries` (query_id, query), each with up to `near` neighbours.

    A query's words of two letters or more are looked up by search_names; a node counts by its best word, ties by id. Neighbours come by their edge's confidence, ties by id; a
    node without any has one row, with nulls. Words are looked up once, however many queries have them.
    """
    words = queries.select("query_id", F.explode(F.split(F.lower("query"), r"\s+")).alias("word")).where(F.length("word") >= 2).distinct()
    found = search_names(nodes.select("name"), words.select(F.col("word").alias("query")), fuzzy).select(F.col("query").alias("word"), "name", "score")
    scored = words.join(found, "word").join(nodes.select("id", "name"), "name").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")).cast("long")).where(F.col("rank") <= most)
    around = neighbours(edges, ranked.select(F.col("id").alias("node")))
    by = Window.partitionBy("node").orderBy(F.col("confidence").desc(), "neighbour")
    around = around.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= near).withColumnRenamed("node", "id")
    return ranked.join(around, "id", "left").select("query_id", "rank", "id", "score", "place", "neighbour", "relation", "confidence")


def centres(nodes: DataFrame, queries: DataFrame, default: str) -> DataFrame:
    """query, node: for each of `queries` (query) the first node (id, name), by id, whose name or id equals it; else the first that holds it in either; else, as for a blank query, the `default`.

    Queries are a stated batch: equal ones meet by a join, the rest are looked for in all nodes, in blocks of QUERY_BLOCK.
    """
    asked = queries.select("query", F.lower(F.trim("query")).alias("q")).distinct()
    named = nodes.select("id", F.lower(F.coalesce("name", F.lit(""))).alias("low"), F.lower("id").alias("low_id"))
    keys = named.select("id", F.explode(F.array_distinct(F.array("low", "low_id"))).alias("q"))
    exact = asked.where("q != ''").join(keys, "q").groupBy("query").agg(F.min("id").alias("node"))
    rest = asked.where("q != ''").join(exact, "query", "left_anti")
    blocks = max(1, -(-rest.count() // QUERY_BLOCK))
    packed = rest.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query", "q")).alias("asked"))
    holds = F.filter("asked", lambda a: F.contains(F.col("low"), a["q"]) | F.contains(F.col("low_id"), a["q"]))
    numbered = named.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    partial = numbered.join(packed, "block").select("id", F.explode(holds).alias("a")).groupBy("a.query").agg(F.min("id").alias("node"))
    return queries.select("query").distinct().join(exact.unionByName(partial), "query", "left").select("query", F.coalesce("node", F.lit(default)).alias("node"))


def paths(edges: DataFrame, pairs: DataFrame, hops: int = 2) -> DataFrame:
    """a, b, path (the nodes from a to b) of `pairs` (a, b): all shortest paths of at most `hops` edges, along edges either way; each step looks at what earlier ones
    haven't found only."""
    way = both_ways(edges)
    steps, out = pairs.select("a", "b", F.array("a").alias("path")).where("a != b").distinct(), None
    for _ in range(hops):
        ends = steps.withColumn("at", F.element_at("path", -1))
        grown = ends.join(way, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("tgt"))).select("a", "b", F.concat("path", F.array("tgt")).alias("path"))
        found = grown.where(F.element_at("path", -1) == F.col("b"))
        out = found if out is None else out.unionByName(found)
        steps = grown.join(found.select("a", "b").distinct(), ["a", "b"], "left_anti")
    return out


def ego(edges: DataFrame, centre: DataFrame, hops: int = 2) -> DataFrame:
    """Edges among the nodes within `hops` of `centre` (node)."""
    way, seen = both_ways(edges), centre.select("node").distinct()
    for _ in range(hops):
        seen = seen.unionByName(seen.join(way, F.col("node") == F.col("src")).select(F.col("tgt").alias("node"))).distinct()
    inside = edges.join(seen.withColumnRenamed("node", "src"), "src", "left_semi")
    return inside.join(seen.withColumnRenamed("node", "tgt"), "tgt", "left_semi")


def stats(edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, density."""
    nodes = edges.select("src").union(edges.select("tgt")).distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    n = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return nodes.crossJoin(n).select("n_nodes", "n_edges", F.round(F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0), 9).alias("density"))


def first_best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def delta_decisions(delta: DataFrame, known: DataFrame) -> DataFrame:
    """`delta` (src, tgt, structural, ...) with `decision`: reject for structural nodes, merge where an end is among the `known` nodes (id), add otherwise."""
    nodes = known.select("id").distinct().withColumn("there", F.lit(True))
    marked = delta
    for end in ("src", "tgt"):
        marked = marked.join(nodes.select(F.col("id").alias(end), F.col("there").alias(f"{end}_known")), end, "left")
    return marked.withColumn("decision", F.when(F.col("structural"), "reject").when(F.col("src_known") | F.col("tgt_known"), "merge").otherwise("add")).drop("src_known", "tgt_known")
