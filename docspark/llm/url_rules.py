"""URL filters with redirect equivalence, with DataFrame functions only.

A rule (action, host, path) decides for urls of its host and that host's subdomains whose path starts with the rule's; the longest rule wins. Urls that redirect to one
another or name one another as canonical are aliases: connected components over such edges, found by contraction. A url without a rule takes its
aliases' decision: allowed if one of them is explicitly allowed, else blocked if one is explicitly blocked, else allowed. Only links' ends take part
in components; pages without links are judged where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import checkpointed
from docspark.llm.simhash import components

#: So many rules at most are one expression; more are joined.
INLINE_RULES = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What no browser reads as markup: comments, and elements of other languages; unclosed, they go on to the end.
HIDDEN = r"(?is)<!--(?:.*?-->|.*\z)|<(script|style|template|noscript)\b(?:.*?</\1\s*>|.*\z)"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"


def lower_ascii(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def split_url(url: Column) -> Column:
    """(host, path, query) of a url: the host with A-Z in lower case, the query with its `?`; all empty where there is no `://`."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", k), F.lit(""))
    return F.struct(lower_ascii(part(1)).alias("host"), part(2).alias("path"), part(3).alias("query"))


def node_of(parts: Column) -> Column:
    """The name of a url among links: without scheme and fragment, an empty path as `/`. Null where there is no host."""
    path = F.when(parts["path"] == "", "/").otherwise(parts["path"])
    return F.when(parts["host"] != "", F.concat(parts["host"], path, parts["query"]))


def without_dots(path: Column) -> Column:
    """`.` and `..` segments resolved."""

    def step(done, part):
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    end = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, F.lit(1), F.lit(1)), step), end), "/")
    return F.when(path.rlike(r"/\.\.?(/|\z)"), whole).otherwise(path)


def resolved(page: Column, target: Column) -> Column:
    """(host, path, query) of a link as it stands in a page whose url has the parts `page`."""
    target = F.regexp_replace(F.regexp_replace(target, r"\A\s+|\s+\z", ""), "&amp;", "&")
    own = F.regexp_replace(target, r"(?s)#.*\z", "")
    path = F.regexp_replace(own, r"(?s)\?.*\z", "")
    query = F.regexp_extract(own, r"(?s)\?.*\z", 0)
    folder = F.when(page["path"] == "", "/").otherwise(F.regexp_replace(page["path"], r"[^/]*\z", ""))
    at = lambda p: F.struct(page["host"].alias("host"), without_dots(p).alias("path"), query.alias("query"))
    whole = lambda u: F.struct(u["host"].alias("host"), without_dots(u["path"]).alias("path"), u["query"].alias("query"))
    return (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), whole(split_url(target)))
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), None)  # mail addresses, scripts
        .when(target.startswith("//"), whole(split_url(F.concat(F.lit("http:"), target))))
        .when(target.startswith("/"), at(path))
        .when((target == "") | target.startswith("#"), None)
        .when(target.startswith("?"), F.struct(page["host"].alias("host"), page["path"].alias("path"), query.alias("query")))
        .otherwise(at(F.concat(folder, path)))
    )


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty where there is none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def page_links(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): distinct nodes that pages link by `<link rel=canonical>` or `<meta http-equiv=refresh>`. The first canonical link of a page counts, and the first refresh."""
    html = df[html_col].cast("string")
    marked = df.where(html.rlike(r"(?i)canonical|http-equiv")).select(split_url(df[url_col].cast("string")).alias("page"), F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(TAG), F.lit(0)).alias("tags"))
    canonical = F.filter("tags", lambda t: t.rlike(r"(?i)\A<link") & attribute(t, "rel").rlike(r"(?i)(\A|\s)canonical(\s|\z)") & (attribute(t, "href") != ""))
    refresh = F.filter("tags", lambda t: t.rlike(r"(?i)\A<meta") & (lower_ascii(attribute(t, "http-equiv")) == "refresh") & attribute(t, "content").rlike(r"(?i)url\s*="))
    url = lambda t: F.regexp_replace(F.regexp_extract(attribute(t, "content"), r"(?is)url\s*=\s*(.*)\z", 1), r"""\A['"]|['"]\s*\z""", "")
    targets = F.concat(F.transform(F.slice(canonical, 1, 1), lambda t: attribute(t, "href")), F.transform(F.slice(refresh, 1, 1), url))
    found = marked.select("page", F.explode(targets).alias("target")).select(node_of(F.col("page")).alias("a"), node_of(resolved(F.col("page"), F.col("target"))).alias("b"))
    return found.where("a != b").distinct()


def inline_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(action, rule) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(own + start).alias("rule"))).otherwise(found)
    return found


def joined_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls` (host, path) that a rule of `rules` (action, host, path) fits, once each, with their `decision` (action, rule).

    A url meets a rule at one of its host's ends and one of its path's beginnings up to a `/`, which the rule has too, so no host meets all rules.
    """
    base = lambda p: F.regexp_extract(p, r"(?s)\A.*/", 0)
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    steps = F.split("path", "/")
    begins = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/"))))
    keyed = urls.select("host", "path").distinct().select("host", "path", F.explode(ends).alias("end"), begins.alias("begins")).select("host", "path", "end", F.explode("begins").alias("begin"))
    named = rules.select("action", F.col("host").alias("end"), base(F.col("path")).alias("begin"), F.col("path").alias("start"))
    met = keyed.join(named, ["end", "begin"]).where(F.col("path").startswith(F.col("start")))
    rule = F.concat("end", "start")
    best = F.max(F.struct(F.length(rule).alias("size"), (F.col("action") == "allow").alias("allow"), rule.alias("rule"), "action"))
    return met.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.struct("best.action", "best.rule").alias("decision"))


def with_decision(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """`urls` (host, path, ...) with `decision` (action, rule), null where no rule fits."""
    if isinstance(rules, DataFrame):
        return urls.join(joined_rule(urls, rules), ["host", "path"], "left")
    if len(rules) > INLINE_RULES:
        return with_decision(urls, urls.sparkSession.createDataFrame(rules, "action string, host string, path string"))
    return urls.withColumn("decision", inline_rule(F.col("host"), F.col("path"), rules))


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, component: one row for each input row.

    rules: (action, host, path) with action `allow` or `block`, a list or a DataFrame; among rules of one length `allow` wins. redirects: (source, target), urls of a
    crawl's log, beside the links that `page_links` finds. component: the least node of the url's aliases, itself included; null where a url has no host. A
    null url, or one without `://`, has an empty host and path, is fitted by no rule, has no aliases and is allowed. Null pages have no links. Repeated rows and ids
    are judged alike, each for itself. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    pages = df.select(df[id_col].alias("page_id"), split_url(df[url_col].cast("string")).alias("parts")).select("page_id", "parts.host", "parts.path", node_of(F.col("parts")).alias("node"))
    links = page_links(df, url_col, html_col)
    if redirects is not None:
        given = redirects.select(*[node_of(split_url(redirects[c].cast("string"))).alias(k) for c, k in (("source", "a"), ("target", "b"))])
        links = links.unionByName(given.where("a != b")).distinct()
    roots = components(checkpointed(links))
    parts = split_url(F.concat(F.lit("://"), F.col("node")))
    members = with_decision(roots.select("node", "root", parts.alias("parts")).select("node", "root", "parts.host", "parts.path"), rules)
    # a node has `/` for an empty path, which a page itself may have: rules of explicit urls are those of the page, aliases' those of the node
    action = lambda a: F.max(F.coalesce(F.col("decision.action") == a, F.lit(False)))
    fates = members.groupBy("root").agg(action("allow").alias("allowed"), action("block").alias("blocked"))
    aliases = checkpointed(members.select("node", "root").join(fates, "root"))
    out = with_decision(pages, rules).join(aliases, "node", "left")
    shared = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("decision.rule").alias("rule"), F.coalesce("decision.action", shared).alias("verdict"), F.coalesce("root", "node").alias("component"))
