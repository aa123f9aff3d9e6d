"""Source divergence audit: how far the sources of a language differ in their words, by exact arithmetic.

A first pass counts terms in tasks that add up before anything is shuffled. Kept terms are dealt by hash into vocabulary chunks; a group's counts in a
chunk are one packed vector. The groups of a language are cut into blocks; every packed vector goes to each group-block by group-block tile that
its group takes part in, and a tile computes its pairs' submatrix chunk by chunk. A tile covers CHUNKS chunks, so that work spreads over the vocabulary
as well as over the groups, and what tiles of one pair find is added up.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import as_bytes, checkpointed, map_batches, small

#: A term has to be in so many documents of its language; counts are raised by SMOOTHING; shares are in units of 1 / SCALE.
LEAST_DOCUMENTS, SMOOTHING, SCALE = 30, 5, 1_000_000_000
#: Terms of a vocabulary chunk, chunks of a tile, groups of a block: a tile reads 2 x GROUPS x CHUNKS x CHUNK_TERMS counts at most, about.
CHUNK_TERMS, CHUNKS, GROUPS = 2048, 8, 32
#: Different terms that a task counts before it passes them on.
HELD_TERMS = 200_000
#: A-Z to a-z; bytes that are no letter of ASCII nor part of a longer character to a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, in parts that still have to be added up. Each group also has a row of term ''."""

    def count(batches):
        found = defaultdict(lambda: (Counter(), Counter()))

        def held():
            for (lang, source), (n, docs) in found.items():
                size = len(n)
                words = pa.array(list(n), pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), words, pa.array(n.values(), pa.int64()), pa.array([docs[w] for w in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            found.clear()

        terms = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                n, docs = found[lang, source]
                words = text.translate(LETTERS).split()
                before = len(n)
                n[b""] += 0
                n.update(words)
                docs.update(set(words))
                terms += len(n) - before
                if terms > HELD_TERMS:
                    yield from held()
                    terms = 0
        yield from held()

    known = lambda c: F.coalesce(df[c].cast("string"), F.lit(""))
    rows = df.select(known(lang_col).alias("lang"), known(source_col).alias("source"), df[text_col].cast("string").alias("text"))
    return map_batches(rows, count, "lang string, source string, term string, n bigint, docs bigint")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTHING) / (total + SMOOTHING terms)), exactly."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above, (total + terms * SMOOTHING).cast("decimal(20,0)")) + 1


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """`share` of an array, by long division in steps of 1,000: exact while total + SMOOTHING terms is under 9e15."""
    below = total + SMOOTHING * terms
    out, rest = np.divmod(counts.astype(np.int64) + SMOOTHING, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + more
    return out + 1


def tile_pairs(key: tuple, table: pa.Table) -> pa.Table:
    """(lang, a, b, f), a < b: the pairs of a tile's two blocks, f summed over the tile's chunks. Rows with chunk -1 name the groups."""
    lang, span, one, two = (k.as_py() for k in key)
    table = table.sort_by("chunk")
    chunk, group = (table.column(c).to_numpy() for c in ("chunk", "group"))
    heads = np.flatnonzero(chunk < 0)
    groups = np.sort(group[heads])
    total = dict(zip(group[heads].tolist(), table.column("total").to_numpy()[heads].tolist()))
    terms = int(table.column("terms")[0].as_py())
    places, counts = table.column("places").combine_chunks(), table.column("counts").combine_chunks()
    upper, lower = groups[groups // GROUPS == one], groups[groups // GROUPS == two]
    f = np.zeros((len(upper), len(lower)), np.int64)
    if terms:
        base = np.array([shares(np.zeros(1, np.int64), total[g], terms)[0] for g in groups.tolist()])
        side = [np.searchsorted(groups, x) for x in (upper, lower)]
        apart = np.abs(base[side[0]][:, None] - base[side[1]][None, :])
        if span == 0:
            f += apart * terms  # as if no group had a term; chunks correct that
        begins = np.flatnonzero(np.diff(chunk, prepend=-2))
        for begin, end in zip(begins, [*begins[1:], len(chunk)]):
            if chunk[begin] < 0:
                continue
            own = [(group[k], places[k].values.to_numpy(), counts[k].values.to_numpy()) for k in range(begin, end)]
            width = max(int(p.max()) for _, p, _ in own) + 1
            matrix = np.repeat(base[:, None], width, 1)
            for g, p, n in own:
                matrix[np.searchsorted(groups, g), p] = shares(n, total[int(g)], terms)
            below = matrix[side[1]]
            for k, row in enumerate(side[0]):
                f[k] += np.abs(below - matrix[row]).sum(1)
            f -= apart * width
    a, b = np.nonzero(upper[:, None] < lower[None, :])
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": upper[a].astype(np.int64), "b": lower[b].astype(np.int64), "f": f[a, b]})


def source_divergence(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS, ranks: int = 50
) -> DataFrame:
    """lang, source, part, item, value, rank: the distance to each other source of the language, and the terms that mark a source.

    Part 'pair' has a row for each other source of the language, with the sum of absolute differences of smoothed shares over all kept terms. Part 'term'
    has the terms that a source uses more than its language does, the `ranks` farthest. Null texts, languages and sources are read as ''; texts are
    read whole. A repeated row counts as another document. A language without kept terms has distance 0 between its sources; a single source has no
    pairs. Ties go by item, as UTF-8. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    of_term = Window.partitionBy("lang", "term")
    dealt = term_counts(df, text_col, lang_col, source_col).repartition("lang", "term")  # the one shuffle of terms: what follows has the same keys
    counts = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    first = F.row_number().over(of_term.orderBy("source")) == 1
    kept = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("lang_n"), first.alias("first"))
    kept = checkpointed(kept.where((F.col("term") == "") | (F.col("docs") >= least_documents)).drop("docs"))
    named = F.col("term") != ""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.when(named & F.col("first"), 1).otherwise(0)).alias("terms"))
    by_lang = Window.partitionBy("lang")
    groups = own.join(langs, "lang").withColumns({"group": F.row_number().over(by_lang.orderBy("source")) - 1, "groups": F.count(F.lit(1)).over(by_lang)})
    groups = checkpointed(groups.withColumns({"chunks": F.ceil(F.col("terms") / CHUNK_TERMS), "blocks": F.ceil(F.col("groups") / GROUPS).cast("int")}))
    n_groups = groups.count()
    known = small(groups, n_groups)
    terms = kept.where(named).join(known, ["lang", "source"])

    value = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    marks = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).where("value > 0")
    marks = marks.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)

    # packed vectors: terms dealt to chunks by hash, a place for each term of a chunk
    chunked = terms.select("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"), "term", "group", "n", "total", "terms", "blocks")
    placed = chunked.withColumn("place", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    pairs = F.collect_list(F.struct("place", "n"))
    packed = placed.groupBy("lang", "chunk", "group", "total", "terms", "blocks").agg(pairs.alias("packed"))
    packed = packed.select("lang", F.floor(F.col("chunk") / CHUNKS).alias("span"), "chunk", "group", "total", "terms", "blocks", F.col("packed.place").alias("places"), F.col("packed.n").alias("counts"))
    spans = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("chunks") / CHUNKS) - 1).cast("long")))
    heads = groups.select(
        "lang", spans.alias("span"), F.lit(-1).cast("long").alias("chunk"), "group", "total", "terms", "blocks", F.array().cast("array<int>").alias("places"), F.array().cast("array<bigint>").alias("counts")
    )
    tile = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    block = F.floor(F.col("group") / GROUPS).cast("int")
    tiled = heads.unionByName(packed).select("*", tile.alias("other")).select("*", F.least("other", block).alias("one"), F.greatest("other", block).alias("two")).drop("other", "blocks")
    found = tiled.groupBy("lang", "span", "one", "two").applyInArrow(tile_pairs, "lang string, a bigint, b bigint, f bigint")
    sums = found.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "value").select("lang", "p.a", "p.b", "value")
    name = lambda k, c: small(groups.select("lang", F.col("group").cast("long").alias(k), F.col("source").alias(c)), n_groups)
    far = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    far = far.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return far.unionByName(marks)
