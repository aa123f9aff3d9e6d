"""Text functions: normalisation, tokens, profiles. Columns in, columns out; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that evidence matching leaves out.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "this", "to", "with"]

CJK = "一-鿿"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Line ends as LF, runs of blanks as one, at most one empty line between lines, no white space at either end; null as empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(t)


def without_tags(text: Column) -> Column:
    """Normalised text whose tags are line ends."""
    return strip(F.regexp_replace(F.regexp_replace(normalize(text), r"<[^>]+>", "\n"), r"\n{2,}", "\n"))


def simple_tokens(text: Column) -> Column:
    """Runs of letters a-z and digits, and CJK runs of two or more, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9]+|[{CJK}]{{2,}}"), F.lit(0))


def search_tokens(text: Column) -> Column:
    """As an index takes them: words, and for a CJK run itself, if it has at most six characters, and its pairs; a single character counts twice."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9]+|[{CJK}]+"), F.lit(0))

    def parts(run):
        n = F.length(run)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        whole = F.when(n <= 6, F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(whole, pairs)).otherwise(F.array(run))

    return F.flatten(F.transform(runs, parts))


def answer_tokens(text: Column) -> Column:
    """Words with an apostrophe part, CJK runs, and numbers with a decimal part or a per cent sign."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[a-z]+(?:'[a-z]+)?|[{CJK}]{{2,}}|\d+(?:\.\d+)?%?"), F.lit(0))


def evidence_tokens(text: Column) -> Column:
    """Distinct tokens of more than one character that are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[a-z0-9]+(?:'[a-z0-9]+)?|[{CJK}]{{2,}}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS)))


def bare(text: Column) -> Column:
    """Lower case, without white space and without what is no word character."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\W]+", "")


def profile(text: Column) -> Column:
    """zh, en or mixed, from the first 20,000 characters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 20000)
    cjk, latin = F.regexp_count(head, F.lit(f"[{CJK}]")), F.regexp_count(head, F.lit("[A-Za-z]"))
    low, high = F.least(cjk, latin), F.greatest(cjk, latin)
    return F.when((high > 0) & (low / F.greatest(high, F.lit(1)) > 0.15), "mixed").when(cjk > latin, "zh").otherwise("en")


def health(text: Column) -> Column:
    """2 for a CJK character, a quarter for a Latin letter, less 3 for a replacement character and 1 for a question mark."""
    t = F.coalesce(text, F.lit(""))
    n = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return 2 * n(f"[{CJK}]") + 0.25 * n("[A-Za-z]") - 3 * n("�") - n(r"\?")


def garbled_ratio(text: Column) -> Column:
    """Share of the characters, white space aside, that are neither letters, digits nor common punctuation; 0 without any."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    good = F.regexp_count(solid, F.lit(r"[\p{L}\p{N}.,;:!?'\"()\-]"))
    return F.when(F.length(solid) == 0, F.lit(0.0)).otherwise(1 - good / F.length(solid))


def slug(prefix: str, text: Column) -> Column:
    """prefix, underscore and the text with white space as underscores, other signs dropped, at most 48 characters; unknown if nothing is left."""
    t = F.substring(F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"\s+", "_"), f"[^a-z0-9_{CJK}-]", ""), 1, 48)
    return F.concat(F.lit(prefix + "_"), F.when(F.coalesce(t, F.lit("")) == "", "unknown").otherwise(t))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def json_object(text: Column, schema: str) -> Column:
    """The object a text is, or the one from its first to its last brace."""
    return F.coalesce(F.from_json(text, schema), F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema))


def image_refs(text: Column) -> Column:
    """(page, bbox) of each Markdown reference ![](page=N,bbox=[x1, y1, x2, y2])."""
    pattern = F.lit(r"!\[[^\]]*\]\(page=(\d+),\s*bbox=(\[[^\]]*\])\)")
    return F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(1)),
        F.regexp_extract_all(text, pattern, F.lit(2)),
        lambda p, b: F.struct(p.cast("int").alias("page"), F.from_json(b, "array<double>").alias("bbox")),
    )


def region_text(label: Column, text: Column) -> Column:
    """A recognised region as Markdown: titles with #, formulas between $$, bullets as -, enumerations with a space, single line ends doubled."""
    t = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\t", ""))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\.{4,}", "..."), r"·{4,}", "···"), r"_{4,}", "___")
    heading = F.regexp_replace(t, r"^#+\s*", "")
    bullet = F.regexp_replace(t, r"^[·•*]\s*", "- ")
    number = F.regexp_replace(F.regexp_replace(bullet, r"^\((\d+)\)\s*", r"($1) "), r"^(\d+)\.\s*(?=\D)", r"$1. ")
    plain = F.regexp_replace(number, r"(?<!\n)\n(?!\n)", "\n\n")
    formula = F.concat(F.lit("$$\n"), strip(F.regexp_replace(t, r"^\$\$|\$\$$", "")), F.lit("\n$$"))
    return F.when(label == "doc_title", F.concat(F.lit("# "), heading)).when(label == "paragraph_title", F.concat(F.lit("## "), heading)).when(label == "formula", formula).otherwise(plain)


# Kinds of blocks by label; what marks the kind of a knowledge label; terms that say nothing; signs of text decoded wrongly.
BLOCK_TYPES = {
    "title": ["title", "heading", "header"], "table": ["table", "table_caption"], "image": ["image", "figure", "chart"], "formula": ["formula", "equation"], "caption": ["caption", "figure_caption"],
    "list": ["list", "list_item"], "code": ["code", "code_block"], "text": ["text", "plain_text", "paragraph"],
}
KNOWLEDGE = {"Method": ["机制", "方法", "流程", "框架", "模型"], "Metric": ["指标", "准确率", "召回", "分数", "率"], "Dataset": ["数据集", "样本", "报告", "文档"], "Task": ["任务", "问题", "场景"], "Claim": ["结论", "发现", "创新", "优势"]}
METHOD_WORDS = ["rag", "sql", "agent", "t2sql"]
STOP_TERMS = ["什么", "如何", "为什么", "是否", "哪些", "这个", "一下", "进行", "通过", "根据", "文档", "问题", "回答", "生成", "说明", "总结", "包括", "以及", "其中", "项目", "具体", "文中", "报告"]
MOJIBAKE = ["閿", "閵", "閳", "閺", "閻", "閸", "閹", "锟斤拷"]
FACT_MARKS = ["是什么", "谁", "哪些", "多少", "第几", "哪四个", "哪三个", "目标", "指标", "计划", "模块", "流程"]


#: What a region is shown as.
REGION_KINDS = {
    "image": ["chart", "image"],
    "text": ["abstract", "algorithm", "content", "doc_title", "figure_title", "paragraph_title", "reference_content", "text", "vertical_text", "vision_footnote", "seal", "formula_number"],
    "table": ["table"],
    "formula": ["display_formula", "inline_formula"],
}


def region_kind(label: Column, kinds: dict[str, list[str]] | None = None) -> Column:
    """image, text, table or formula by the lists of labels in `kinds`, tried in their order; a label in none of them stays."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, labels in (REGION_KINDS if kinds is None else kinds).items():
        out = out.when(label.isin(labels), kind)
    return out.otherwise(label)


def block_type(label: Column) -> Column:
    """The kind of a block by its label; other labels stay, none is unknown."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F.when(low == "", "unknown")
    for kind, labels in BLOCK_TYPES.items():
        out = out.when(low.isin(labels), kind)
    return out.otherwise(low)


def knowledge_label(text: Column) -> Column:
    """A claim as a label: without numbering and determiner at its start and the predicate at its end, at most 24 characters."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^[\s,，;；:：.\-、（(]*[0-9]+[\)）.、\s]*", "")
    t = F.regexp_replace(F.regexp_replace(t, "^(其|该|本|这个|一种|一个|项目的?|具体的?)", ""), "(包括|为|是|指|通过|用于).*$", "")
    return F.trim(F.substring(F.regexp_replace(t, "^[ ，,;；:：。]+|[ ，,;；:：。]+$", ""), 1, 24))


def contains_any(text: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def knowledge_type(label: Column) -> Column:
    out = F.when(contains_any(label, KNOWLEDGE["Method"]) | contains_any(F.lower(label), METHOD_WORDS), "Method")
    for kind, marks in list(KNOWLEDGE.items())[1:]:
        out = out.when(contains_any(label, marks), kind)
    return out.otherwise("Concept")


def clean_content(text: Column) -> Column:
    """Recognised content without tabs written out at its ends, with at most three of a run of points, middle points, lines or escaped lines."""
    t = strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^(\\t)+", ""), r"(\\t)+$", ""))
    for sign, three in ((r"\.", "..."), ("·", "···"), ("_", "___")):
        t = F.regexp_replace(t, sign + "{3,}", three)
    return strip(F.regexp_replace(t, r"(\\_){3,}", r"\\_\\_\\_"))


def run_around(codes, at: int, unit: int, width: int) -> tuple[int, int]:
    """Begin and end of the longest stretch with the period `unit` around [at, at + width), which has it."""
    import numpy as np

    begin, end, step = at, at + width, 4 * unit
    while begin > 0:
        low = max(0, begin - step)
        differ = np.flatnonzero(codes[low:begin] != codes[low + unit : begin + unit])
        if len(differ):
            begin = low + int(differ[-1]) + 1
            break
        begin, step = low, 2 * step
    step = 4 * unit
    while end < len(codes):
        high = min(len(codes), end + step)
        differ = np.flatnonzero(codes[end:high] != codes[end - unit : high - unit])
        if len(differ):
            return begin, end + int(differ[0])
        end, step = high, 2 * step
    return begin, end


def first_loop(text: str, least: int = 10, times: int = 10) -> tuple[int, int] | None:
    """Start and length of the first unit of `least` characters or more that stands `times` times in a row, times being 8 or more; the shortest unit there.

    For units of w to 2 w - 1 characters, one window of 4 w in each 4 w lies within any such loop, as that has 8 w or more; a window that is followed by its own beginning
    within 2 w has that period, and its stretch is measured once. So the time is that of a few passes for each doubling of w.
    """
    import numpy as np

    n, found, width = len(text), None, least
    if times < 8:
        raise ValueError("a unit has to stand 8 times or more")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    while width * times <= n:
        measured = 0  # where the last stretch of this width ends
        for at in range(0, n - 4 * width + 1, 4 * width):
            if at + 4 * width <= measured:
                continue
            again = text.find(text[at : at + 2 * width], at + width, at + 4 * width - 1)
            if again < 0:
                continue
            unit = again - at
            begin, measured = run_around(codes, at, unit, 2 * width + unit)
            if measured - begin >= unit * times and (found is None or (begin, unit) < found):
                found = (begin, unit)
        width *= 2
    return found


def without_loop(content: str, least: int = 10, times: int = 10, lines_from: int = 10) -> str:
    """Content cut after the first unit of a loop: of characters, or else of a line that makes up 80 % of ten lines or more, where it first stands three times in a row."""
    solid = content.strip()
    if len(solid) > least * times:
        loop = first_loop(solid, least, times)
        if loop:
            return solid[: loop[0] + loop[1]]
    own = content.split("\n")
    lines = [(k, t.strip()) for k, t in enumerate(own) if t.strip()]
    if len(lines) >= lines_from:
        from collections import Counter

        common, n = Counter(t for _, t in lines).most_common(1)[0]
        if n >= lines_from and n / len(lines) >= 0.8:
            for (k, a), (_, b), (_, c) in zip(lines, lines[1:], lines[2:]):
                if a == b == c == common:
                    return "\n".join(own[: k + 1])
    return content


def without_loops(text: Column, from_chars: int = 2048) -> Column:
    """without_loop of texts of `from_chars` characters or more; others stay in the JVM."""
    import pandas as pd

    cut = F.pandas_udf(lambda t: pd.Series([None if x is None else without_loop(x) for x in t]), "string")
    return F.when(F.length(text) >= from_chars, cut(F.when(F.length(text) >= from_chars, text))).otherwise(text)


def repaired(text: str) -> str:
    """The healthiest of a text as it is and as UTF-8 that was read as GBK, code page 936 or Latin-1; ties go to the earlier."""
    import re

    def health_of(t: str) -> float:
        count = lambda p: len(re.findall(p, t))
        return 2 * count(f"[{CJK}]") + 0.25 * count("[A-Za-z]") - 3 * t.count("\ufffd") - t.count("?")

    found = [text]
    for codec in ("gbk", "cp936", "latin1"):
        try:
            found.append(text.encode(codec).decode("utf-8"))
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return max(found, key=health_of)


def repair_mojibake(text: Column) -> Column:
    """repaired, for texts beyond ASCII; others can't be read wrongly and stay in the JVM."""
    import pandas as pd

    wide = text.rlike(r"[^\x00-\x7F]")
    fix = F.pandas_udf(lambda t: pd.Series([None if x is None else repaired(x) for x in t]), "string")
    return F.when(wide, fix(F.when(wide, text))).otherwise(text)


def formula_number(text: Column) -> Column:
    """A formula's number without its parentheses."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(r"(?s)^\(.*\)$") | t.rlike("(?s)^（.*）$"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def search_text(name: Column, page: Column, label: Column, kind: Column, path: Column, heading: Column, content: Column) -> Column:
    """What is embedded for a block: six labelled lines."""
    given = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    lines = [("文档:", given(name)), ("页码:", F.coalesce(page.cast("string"), F.lit("0"))), ("类型:", F.concat(given(label), F.lit(" "), given(kind))), ("章节路径:", given(path)), ("标题:", given(heading)), ("内容:", given(content))]
    return F.concat_ws("\n", *[F.concat(F.lit(k), v) for k, v in lines])


def prefixed(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.trim(F.coalesce(text, F.lit(""))))


def numbers(text: Column) -> Column:
    """Numbers with a decimal part or a per cent sign, and runs of Chinese numerals."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?%?|[一二三四五六七八九十百千万]+"), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[。！？!?;；\n]+"), strip), lambda x: x != "")


def gold_facts(answer: Column, question: Column) -> Column:
    """Facts that an answer has to hold, normalised, each once: up to eight numbers, for questions after facts up to ten phrases; without any, the first three sentences."""
    phrases = F.slice(F.filter(F.split(F.coalesce(answer, F.lit("")), r"[，。；：、\s]+"), lambda x: F.length(x) >= 2), 1, 10)
    found = F.concat(F.slice(numbers(answer), 1, 8), F.when(contains_any(F.coalesce(question, F.lit("")), FACT_MARKS), phrases).otherwise(F.array().cast("array<string>")))
    every = F.when(F.size(found) > 0, found).otherwise(F.slice(sentences(answer), 1, 3))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))), lambda x: x != ""))


def safe_id(text: Column) -> Column:
    """Letters, digits, points, lines and underscores; runs of anything else are one underscore, none at the ends; item if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text.cast("string"), F.lit(""))), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(t == "", "item").otherwise(t)


def valid_id(text: Column) -> Column:
    """Whether a text may name a stored document: safe as it is, without a point at its start."""
    return F.coalesce(text.rlike("^[A-Za-z0-9_-][A-Za-z0-9_.-]*$"), F.lit(False))
