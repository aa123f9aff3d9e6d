"""Source divergence, conversation repair and url rules against slow versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from docspark.llm import repair, url_rules
from docspark.llm.divergence import source_divergence
from docspark.llm.repair import damage, repair_conversations
from docspark.llm.url_rules import joined_rule, judge_urls, page_links

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def slow_divergence(rows, least, ranks=50):
    """rows: (text, lang, source)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out, shares = set(), {}
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        n = sum(counts[lang, source][t] for t in kept)
        shares[lang, source] = {t: 1 + 10**9 * (counts[lang, source][t] + 5) // (n + 5 * len(kept)) for t in kept}
    for (lang, source), p in shares.items():
        kept = list(p)
        pairs = [(s, sum(abs(p[t] - q[t]) for t in kept)) for (g, s), q in shares.items() if g == lang and s != source]
        every = Counter()
        for g, s in groups:
            if g == lang:
                every.update({t: counts[g, s][t] for t in kept})
        total = sum(every.values())
        q = {t: 1 + 10**9 * (every[t] + 5) // (total + 5 * len(kept)) for t in kept}
        terms = [(t, p[t] - q[t]) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, k) for k, (item, value) in enumerate(found, 1) if part == "pair" or k <= ranks}
    return out


def divergence_rows(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def documents(spark, rows):
    """rows: (text, lang, source), with columns whose names the operator uses itself."""
    return spark.createDataFrame([(k, *r, 7, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term long, rank string").repartition(3)


def test_divergence_equals_slow(spark):
    rng = random.Random(5)
    words = ["the", "The", "été", "Été", "中文", "zu", "a-b", "x9y", "_z", "über", "q"]
    rows = [(" ".join(rng.choices(words, range(1, 12), k=rng.randrange(40))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s10", "ß", None, ""])) for _ in range(150)]
    rows += [(None, "de", "alone"), ("word", "it", "a"), (None, "it", "b"), ("", "en", "silent")] + rows[:10]
    for least in (1, 6):
        assert divergence_rows(source_divergence(documents(spark, rows), least_documents=least, ranks=4)) == slow_divergence(rows, least, 4)


def test_divergence_over_tiles(spark):
    """Three blocks of groups, and more chunks than a tile holds."""
    rng = random.Random(6)
    many = ["".join(chr(97 + int(d)) for d in str(k)) for k in range(17000)]
    rows = [(" ".join(many[a:b]), "en", f"s{k}") for k, (a, b) in enumerate([(0, 17000), (0, 9000), (9000, 17000)])] * 2
    rows += [(" ".join(rng.choices(many[:50], k=20)), "en", f"s{k}") for k in range(66) for _ in range(2)]
    assert divergence_rows(source_divergence(documents(spark, rows), least_documents=2)) == slow_divergence(rows, 2)


def test_divergence_of_nothing(spark):
    assert divergence_rows(source_divergence(documents(spark, [("a b", "en", "s")]).limit(0))) == set()
    assert divergence_rows(source_divergence(documents(spark, [("a b", "en", "s"), ("c", "en", "t")]))) == {("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)}


SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
GOAL = re.compile("(s?(ua)+)?\\Z")


def faults_of(turns):
    """turns: (turn, role, text), sorted."""
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(turns, faults, most):
    """All (cost, audit, roles, texts) by trying all edits, `most` insertions at most."""

    def go(k, left):
        if left:
            for role in "ua":
                for c, a, out in go(k, left - 1):
                    yield c + 2, "I" + a, [(role, "I", "")] + out
        if k == len(turns):
            yield 0, "", []
            return
        _, role, text = turns[k]
        for c, a, out in go(k + 1, left):
            yield c + 3, "D" + a, out
            if faults[k] not in ("blank", "duplicate"):
                cut = faults[k] == "truncated"
                yield c + cut, "K" + a, [(role, "K", text)] + out
                for other in "ua":
                    yield c + cut + 2, "R" + a, [(other, "R", text)] + out

    return ((c, a, out) for c, a, out in go(0, most) if GOAL.match("".join(r[:1] or " " for r, _, _ in out)))


def line(piece):
    role, edit, text = piece
    return f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[role]}:{text}"


def fast_repair(turns, faults):
    """(cost, audit, text) by dynamic programming over whole states."""
    step = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("", "s"): "s"}
    best = {"": (0, "", ())}

    def inserted(b):
        for _ in range(2):
            for state, (c, a, out) in list(b.items()):
                for r in "ua":
                    if to := step.get((state, r)):
                        b[to] = min(b.get(to, (1 << 60,)), (c + 2, a + "I", (out, (r, "I", ""))))
        return b

    for (_, role, text), fault in zip(turns, faults):
        now, b = {}, inserted(dict(best))
        for state, (c, a, out) in b.items():
            options = [(state, (c + 3, a + "D", out))]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                options += [(step.get((state, r)), (c + cut + (0 if e == "K" else 2), a + e, (out, (role if e == "K" else r, e, text)))) for r, e in ((role[:1], "K"), ("u", "R"), ("a", "R"))]
            for to, option in options:
                if to is not None:
                    now[to] = min(now.get(to, (1 << 60,)), option)
        best = now
    b = inserted(dict(best))
    cost, audit, out = min(b[s] for s in ("", "a") if s in b)
    pieces = []
    while out:
        out, piece = out
        pieces.append(line(piece))
    return cost, audit, "\n".join(reversed(pieces))


def repaired(spark, conversations):
    """conversations: id -> [(turn, role, text)]; the operator's rows by id."""
    rows = [(c, t, r, x, False, 1) for c, turns in conversations.items() for t, r, x in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean, place int").repartition(3)
    return {r.conv_id: r for r in repair_conversations(df).collect()}


def test_repair_equals_all_edits(spark):
    rng = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", ""], ["Yes.", "no", "", " \n", "What?", "yes. "]
    conversations = {k: sorted(((rng.randrange(4), rng.choice(roles), rng.choice(texts)) for _ in range(k % 4 + 1))) for k in range(60)}
    got = repaired(spark, conversations)
    for k, turns in conversations.items():
        faults = faults_of(turns)
        best = min(((c, a) for m in range(4) for c, a, _ in every_repair(turns, faults, m)))
        whole = min(((c, a, "\n".join(map(line, out))) for c, a, out in every_repair(turns, faults, best[1].count("I")) if (c, a) == best))
        r = got[k]
        assert (r.cost, r.audit, r.repaired) == whole == fast_repair(turns, faults)
        assert [r.blank, r.duplicate, r.truncated] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = {t for t, _, _ in turns}
        assert r.gaps == max(numbers) - min(numbers) + 1 - len(numbers)


def test_repair_over_blocks(spark):
    """Longer than several blocks, and a text of some megabytes."""
    rng = random.Random(8)
    n = 3 * repair.BLOCK + 17
    long = [(k, rng.choice(["user", "assistant", "user", "assistant", "system", "x"]), rng.choice([f"Text {k}.", f"text {k}", "", "Same."])) for k in range(n)]
    conversations = {1: long, 2: [(0, "user", "a" * 3_000_000), (1, "assistant", "b.")], 3: [(k, "system", "") for k in range(repair.BLOCK + 1)]}
    got = repaired(spark, conversations)
    for k, turns in conversations.items():
        assert (got[k].cost, got[k].audit, got[k].repaired) == fast_repair(turns, faults_of(turns))


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(30) for t in (*range(6), None)] + [(None, 3, None, None), (None, None, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.gone) for r in damage(df).collect())
    expected = Counter()
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        expected[c, t, "user" if fate == 4 else role, text, fate == 0] += 2 if fate == 3 else 1
    assert got == expected


def test_repair_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, gone boolean"
    rows = [(1, 0, "user", "Hi.", True), (2, None, "assistant", "B.", False), (2, None, "user", "A.", False), (2, None, "user", "A.", False), (None, 5, "user", "A.", False), (None, 9, "assistant", "B.", False)]
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", "")
    ordered = [(None, "assistant", "B."), (None, "user", "A."), (None, "user", "A.")]  # null turns are one place; the role decides
    assert got[2] == (0, 0, 1, 0, 1, *fast_repair(ordered, faults_of(ordered)))
    assert got[None] == (3, 0, 0, 0, 0, 0, "KK", "user:A.\nassistant:B.")
    assert repair_conversations(spark.createDataFrame([], schema)).collect() == []


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def pages(spark, rows):
    """rows: (page_id, url, html), with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, node long").repartition(3)


def judged(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_rules(spark):
    urls = [
        "http://EXAMPLE.com/en/x?y", "https://www.example.com/en/", "https://a.www.example.com/en/z#t", "https://notexample.com/en/1", "https://com/", "https://com", "http://x.net/es/a",
        "http://x.net/es", "http://x.net?/es/", "ftp://x.org/://net/es/", None, "", "no scheme", "://a.net/fr/q", "http://ÄB.net/fr/", "http://user@a.net:80/fr/", "http://",
    ]
    got = judged(judge_urls(pages(spark, [(k, u, None) for k, u in enumerate(urls)]), RULES))
    for k, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, action = max(fits, default=(0, None, "allow"))
        assert got[k] == (host, path, rule, action)


def test_joined_rules_equal_inline(spark):
    rng = random.Random(9)
    labels, steps = ["a", "b", "com", "net"], ["", "x", "xy", "y"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randrange(1, 4)))
    path = lambda: "/".join(["", *rng.choices(steps, k=rng.randrange(0, 4))])
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(60))}.values())
    urls = spark.createDataFrame([(host(), path()) for _ in range(400)], "host string, path string").distinct()
    inline = {(r.host, r.path): r.decision and tuple(r.decision) for r in urls.select("host", "path", url_rules.inline_rule(urls.host, urls.path, rules).alias("decision")).collect()}
    joined = {(r.host, r.path): tuple(r.decision) for r in joined_rule(urls, spark.createDataFrame(rules, "action string, host string, path string")).collect()}
    assert joined == {k: v for k, v in inline.items() if v}


def test_links(spark):
    html = [
        ("http://a.org/x/y?q", '<link href="/c" rel="alternate canonical"><link rel=canonical href=/second>', {("a.org/x/y?q", "a.org/c")}),
        ("http://a.org/x/y", "<LINK REL='canonical' HREF='../up/./z?w=1&amp;v=2#f'>", {("a.org/x/y", "a.org/up/z?w=1&v=2")}),
        ("http://a.org/x/y", '<link rel="canonical" href="//B.org">', {("a.org/x/y", "b.org/")}),
        ("http://a.org/x/y", """<meta content="0; URL='https://b.org/../q'" http-equiv="Refresh">""", {("a.org/x/y", "b.org/q")}),
        ("http://a.org/x/y", '<link rel="canonical" href="?p=2"><meta http-equiv="refresh" content="5;url=z">', {("a.org/x/y", "a.org/x/y?p=2"), ("a.org/x/y", "a.org/x/z")}),
        ("http://a.org/x", '<!-- <link rel="canonical" href="/no"> --><script>"<link rel=canonical href=/no>"</script><noscript><link rel=canonical href=/no></noscript>', set()),
        ("http://a.org/x", '<!-- open <link rel="canonical" href="/no">', set()),
        ("http://a.org/x", '<link rel="canonical" href="https://a.org/x#self"><link rel="canonical" href="/other">', set()),
        ("http://a.org/x", '<link rel="canonical" href="mailto:me"><link rel="canonical-not" href="/no"><link rel="canonical" href="">', set()),
        (None, '<link rel="canonical" href="http://b.org/">', set()),
        ("http://a.org/x", None, set()),
    ]
    for url, page, expected in html:
        assert {tuple(r) for r in page_links(pages(spark, [(1, url, page)])).collect()} == expected, page


def test_aliases_share_decisions(spark):
    link = lambda u: f'<html><link rel="canonical" href="{u}">'
    rows = [
        (1, "http://a.org/1", link("http://b.net/fr/2")),  # to a blocked url that is no page
        (2, "http://c.org/3", link("http://a.org/1")),  # over two links
        (3, "http://d.org/4", link("http://b.net/es/5")),
        (4, "http://e.com/6", link("http://d.org/4")),  # allowed: precedence over 3's block
        (5, "http://b.net/es/5", None),  # its own rule stays
        (6, "http://f.org/7", None),
        (7, "https://f.org/7#x", None),
        (8, "http://g.org/8", link("http://h.org/9")),  # aliases without rules
        (9, None, link("http://b.net/fr/2")),
        (1, "http://a.org/1", link("http://b.net/fr/2")),
    ]
    log = spark.createDataFrame([("http://f.org/7", "http://b.net/fr/2"), (None, "http://x.org/"), ("http://y.org/", "http://y.org/")], "source string, target string")
    got = judge_urls(pages(spark, rows), RULES, redirects=log)
    assert got.count() == len(rows)
    verdicts = {k: v[3] for k, v in judged(got).items()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "allow"}
    assert {r.page_id: r.component for r in got.collect()}[7] == "a.org/1"
    assert judge_urls(pages(spark, rows).limit(0), RULES).collect() == []


def test_components_of_many_urls(spark):
    """Chains, a star and random links, against union-find."""
    rng = random.Random(10)
    names = [f"http://h{k}.org/" for k in range(400)]
    edges = [(k, k + 1) for k in range(100)] + [(150, k) for k in range(151, 250)] + [(rng.randrange(260, 400), rng.randrange(260, 400)) for _ in range(90)]
    blocked = "http://z.net/fr/"
    log = spark.createDataFrame([(names[a], names[b]) for a, b in edges] + [(names[57], blocked), (names[249], blocked + "2")], "source string, target string")
    root = list(range(400))
    find = lambda k: k if root[k] == k else find(root[k])
    for a, b in edges:
        root[find(a)] = find(b)
    got = {r.page_id: r for r in judge_urls(pages(spark, [(k, u, None) for k, u in enumerate(names)]), RULES, redirects=log).collect()}
    by_root = defaultdict(set)
    for k in range(400):
        by_root[find(k)].add(got[k].component)
        assert got[k].verdict == ("block" if find(k) in (find(57), find(249)) else "allow")
    assert all(len(v) == 1 for v in by_root.values()) and len({min(v) for v in by_root.values()}) == len(by_root)


@pytest.mark.parametrize("length", [3_000_000])
def test_long_pages(spark, length):
    page = "<p>x</p>" * (length // 8) + "<!-- canonical" + "<script>" * 1000
    assert judged(judge_urls(pages(spark, [(1, "http://x.net/fr/", page)]), RULES)) == {1: ("x.net", "/fr/", "net/fr/", "block")}
