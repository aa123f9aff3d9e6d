"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a target in words. Its documents are dealt by hash into blocks, about BLOCK_WORDS each. Which output shard draws from which blocks comes
from a multivariate-hypergeometric splitting tree: all blocks are partitioned exactly in two, as if each half's were drawn without replacement from
all, and so on down to the shards, so each shard has an exact quota of blocks of each source. A shard draws its quota from the source's permuted
blocks, disjoint from those of other shards, and takes as many words of them as the source's target asks for: whole passes over its blocks, then whole blocks
in hashed order, and of the last one whole documents in hashed order, the last of them cut. Rows are laid out by shard and shuffled within it by hash.
No step holds a source's documents or all sources together: the tree asks one hashed bridge, for the whole line of blocks, how many before a source's
own went left; sums over sources run over ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import BROADCAST_ROWS, checkpointed, small

#: Words of a block; blocks of a source, at least; words of a shard; passes over a source, at most.
BLOCK_WORDS, LEAST_BLOCKS, SHARD_WORDS, PASSES = 1 << 18, 32, 1 << 24, 3
WEIGHTS = (1, 2, 3)
#: Parts of a shard's places: the two highest bits of a hash.
QUARTERS = 4


def uniform(*parts) -> Column:
    """A number from 0 to 1, by hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def let(x: Column, body) -> Column:
    """body of x, computed once and not written out again wherever body uses it."""
    return F.transform(F.array(x), body)[0]


def ln_factorial(n: Column) -> Column:
    """Stirling's series, shifted by 8 so that it is good to 1e-12 from 0 on."""
    return let(
        n + 9.0,
        lambda x: (x - 0.5) * F.log(x) - x + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
        - F.log((x - 1) * (x - 2) * (x - 3) * (x - 4)) - F.log((x - 5) * (x - 6) * (x - 7) * (x - 8)),
    )


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` are among the `marked`: the inverse of the distribution at u, within 9 deviations of the mean."""
    ways = lambda a, b: ln_factorial(a) - ln_factorial(b) - ln_factorial(a - b)

    def of(p):
        n, k, d = p["n"], p["k"], p["d"]
        mean = d * k / F.greatest(n, F.lit(1.0))
        deviation = F.sqrt(F.greatest(mean * (n - k) * (n - d) / F.greatest(n * (n - 1), F.lit(1.0)), F.lit(0.0)))
        least = F.greatest(F.lit(0.0), d - (n - k), F.floor(mean - 9 * deviation) - 2).cast("long")
        most = F.least(d, k, F.ceil(mean + 9 * deviation) + 2).cast("long")
        start = F.struct(F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("value"), ways(n, d).alias("every"))

        def add(s, i):
            share = F.exp(ways(k, i.cast("double")) + ways(n - k, d - i.cast("double")) - s["every"])
            return F.struct((s["below"] + share).alias("below"), F.when(s["below"] < p["u"], i).otherwise(s["value"]).alias("value"), s["every"].alias("every"))

        found = let(F.struct(least.alias("least"), most.alias("most")), lambda r: F.aggregate(F.sequence(r["least"], F.greatest(r["least"], r["most"])), start, add))
        return F.when(d <= 0, F.lit(0).cast("long")).when(k >= n, d.cast("long")).otherwise(found["value"])

    return let(F.struct(total.cast("double").alias("n"), marked.cast("double").alias("k"), drawn.cast("double").alias("d"), u.alias("u")), of)


def went_left(node: Column, total: Column, left: Column, x: Column) -> Column:
    """How many of the first x of `total` blocks of a node are among the `left` that go to its left half: a bridge halved down to x."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(total, F.lit(1)).cast("double"))).cast("int") + 1))

    def halve(s, _):
        half = F.floor(s["size"] / 2).cast("long")
        drawn = F.struct(half.alias("half"), hypergeometric(s["size"], half, s["left"], uniform(node, s["begin"], s["size"], F.lit("bridge"))).alias("got"))

        def down(g):
            return F.when(
                x < s["begin"] + g["half"], F.struct(s["begin"].alias("begin"), g["half"].alias("size"), g["got"].alias("left"), s["sum"].alias("sum"))
            ).otherwise(F.struct((s["begin"] + g["half"]).alias("begin"), (s["size"] - g["half"]).alias("size"), (s["left"] - g["got"]).alias("left"), (s["sum"] + g["got"]).alias("sum")))

        return F.when(s["size"] <= 1, s).otherwise(let(drawn, down))

    start = F.struct(F.lit(0).cast("long").alias("begin"), total.cast("long").alias("size"), left.cast("long").alias("left"), F.lit(0).cast("long").alias("sum"))
    end = let(F.aggregate(steps, start, halve), lambda e: e["sum"] + F.when(x > e["begin"], e["left"]).otherwise(F.lit(0)))
    return F.when(x <= 0, F.lit(0).cast("long")).when(x >= total, left.cast("long")).otherwise(end)


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`df` with the sums of each of `sums` over all rows before its own, by `order`: rows are dealt into ranges, of which only the sums reach the driver."""
    spark = df.sparkSession
    parts = checkpointed(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("range", F.spark_partition_id()))
    totals = sorted(tuple(r) for r in parts.groupBy("range").agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()]).collect())
    upto, rows = [0.0] * len(sums), []
    for k, *own in totals:
        rows.append((k, *upto))
        upto = [a + b for a, b in zip(upto, own)]
    offsets = spark.createDataFrame(rows, ", ".join(["range int", *[f"`{n} before` double" for n in sums]]))
    by = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(offsets), "range")  # a row for each range
    return out.select(*df.columns, *[(F.coalesce(F.sum(c).over(by).cast("double"), F.lit(0.0)) + F.col(f"{n} before")).alias(n) for n, c in sums.items()])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = PASSES) -> DataFrame:
    """(source, source_size, target) of `sizes` (source, source_size): one row a source.

    Sources by code point, null last, weigh weights[0], weights[1], ..., repeating, and share the total; a target stops at `most` times its
    source's size and the excess is shared again. The level at which this ends is found from running sums over sources, sorted by the
    level at which each one is full.
    """
    name = F.col("source").asc_nulls_last()
    placed = prefix_sums(sizes.select("source", "source_size"), [name], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place").cast("long"), F.lit(len(weights))) + 1).cast("int"))
    full = placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("most")).withColumn("full", F.col("most") / F.col("weight"))
    both = checkpointed(prefix_sums(full, [F.col("full").asc(), name], {"held": F.col("most"), "weights": F.col("weight")}))
    whole = both.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("every"))
    # the level of all that aren't full is that of the first of them
    level = (F.col("all") - F.col("held")) / (F.col("every") - F.col("weights"))
    found = both.crossJoin(F.broadcast(whole)).withColumn("level", level).where(F.col("level") <= F.col("full")).agg(F.min(F.struct("full", "level"))["level"].alias("level"))
    out = both.crossJoin(F.broadcast(found))  # one row
    return out.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def size_of(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, so that joins keep null sources."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def split_blocks(quota: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """(key, shard, before, n): how many of the blocks of each source `quota` (key, quota) each of 2**levels shards draws, and how many the shards before it draw."""
    line = prefix_sums(quota, [F.col("key")], {"low": F.col("quota")})
    total = line.agg(F.sum("quota").alias("total"))
    node = line.crossJoin(F.broadcast(total)).select("key", F.col("low").cast("long").alias("low"), (F.col("low") + F.col("quota")).cast("long").alias("high"), "total", F.lit(1).cast("long").alias("node"))
    for _ in range(levels):
        left = F.floor((F.col("total") + F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(2))) / 2).cast("long")
        went = lambda x: went_left(F.col("node") + F.lit(seed), F.col("total"), F.col("left"), F.col(x))
        halves = node.withColumn("left", left).select("*", went("low").alias("a"), went("high").alias("b"))
        one = F.struct(F.col("a").alias("low"), F.col("b").alias("high"), F.col("left").alias("total"), (F.col("node") * 2).alias("node"))
        two = F.struct((F.col("low") - F.col("a")).alias("low"), (F.col("high") - F.col("b")).alias("high"), (F.col("total") - F.col("left")).alias("total"), (F.col("node") * 2 + 1).alias("node"))
        node = checkpointed(halves.select("key", F.explode(F.array(one, two)).alias("n")).select("key", "n.low", "n.high", "n.total", "n.node"))
    shards = node.select("key", (F.col("node") - (1 << levels)).alias("shard"), (F.col("high") - F.col("low")).alias("n")).where("n > 0")
    running = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("key", "shard", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"), "n")


@dataclass
class Mix:
    """sources: (key, blocks, source_size, target); draws: (key, block, draws of (pass, shard, share)); parts: (key, block, doc, size, part) the words taken of each
    document of a block that is drawn in part. Each with its number of rows. Tables without texts."""

    sources: DataFrame
    draws: DataFrame
    parts: DataFrame
    rows: tuple[int, int, int]
    shards: int
    seed: int


def plan_mix(rows: DataFrame, seed: int = 0, levels: int | None = None, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS) -> Mix:
    """The mix of `rows` (id, key, size). levels: log2 of the shards, by default as many as make a shard SHARD_WORDS, two shards at least."""
    rows = checkpointed(rows.select(F.xxhash64("id", F.lit(seed)).alias("doc"), "key", "size"))
    sizes = checkpointed(rows.groupBy("key").agg(F.sum("size").alias("source_size")))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    if levels is None:
        levels = max(1, (-(-total // SHARD_WORDS) - 1).bit_length())
    source = F.when(F.col("key").startswith("1"), F.expr("substring(key, 2)"))
    targets = source_targets(sizes.select(source.alias("source"), "source_size"), weights).select(source_key(F.col("source")).alias("key"), "source_size", "target")
    count = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / block_words)).cast("long")
    sources = checkpointed(targets.select("key", count.alias("blocks"), "source_size", "target"))
    n_sources = sources.count()
    blocked = with_block(rows, sources, n_sources, seed).select("key", "block", "doc", "size")
    per_block = checkpointed(blocked.groupBy("key", "block").agg(F.sum("size").alias("words")).where("words > 0"))
    shards = split_blocks(per_block.groupBy("key").agg(F.count(F.lit(1)).alias("quota")), levels, seed)
    # the source's permuted blocks, dealt out to the shards by their quotas: numbered over ranges of all blocks, so that no source's blocks are sorted in one task
    deal = F.xxhash64("key", "block", F.lit(seed), F.lit("deal"))
    numbered = prefix_sums(per_block.withColumn("deal", deal), [F.col("key"), F.col("deal"), F.col("block")], {"place": F.lit(1)})
    first = numbered.groupBy("key").agg(F.min("place").alias("first"))
    turn = (F.col("place") - F.col("first") + 1).cast("long")
    turned = numbered.join(small(first, n_sources), "key").select("key", "block", "words", turn.alias("turn"))
    turns = shards.select("key", "shard", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("turn"))
    dealt = turned.join(turns, ["key", "turn"])
    own = Window.partitionBy("key", "shard")
    drawn = own.orderBy(F.xxhash64("key", "block", F.lit(seed), F.lit("draw")), "block").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumns({"own": F.sum("words").over(own), "before": F.coalesce(F.sum("words").over(drawn), F.lit(0))}).join(sources.select("key", "source_size", "target"), "key")
    wanted = F.col("own") * F.col("target") / F.col("source_size") - F.col("before")
    share = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (wanted - p * F.col("own")) / F.col("words")))
    draws = F.filter(F.array(*[F.struct(F.lit(p).alias("pass"), "shard", share(p).alias("share")) for p in range(PASSES)]), lambda d: d["share"] > 1e-12)
    plan = checkpointed(dealt.select("key", "block", "words", draws.alias("draws")))
    # of a block that is drawn in part, whole documents in hashed order; repeated rows are peers, which have the same words before them and share what is left
    part = plan.withColumn("share", F.array_max(F.transform(F.filter("draws", lambda d: d["share"] < 1), lambda d: d["share"]))).where("share is not null")
    inside = blocked.join(part.select("key", "block", "words", "share"), ["key", "block"]).groupBy("key", "block", "doc", "size", "words", "share").agg(F.count(F.lit(1)).alias("copies"))
    upto = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("key", "block").orderBy(F.xxhash64("doc", F.lit("part")), "doc", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.floor((F.floor(F.col("words") * F.col("share") + 0.5) - upto) / F.col("copies"))
    parts = checkpointed(inside.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")).select("key", "block", "doc", "size", "part").where("part > 0"))
    draws = plan.select("key", "block", "draws")
    return Mix(sources, draws, parts, (n_sources, plan.count(), parts.count()), 1 << levels, seed)


def with_block(rows: DataFrame, sources: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """`rows` (doc, key, ...) with their source's columns and their block."""
    return rows.join(small(sources, n_sources), "key").withColumn("block", F.pmod(F.xxhash64("doc", F.lit(seed), F.lit("block")), F.col("blocks")))


def drawn(rows: DataFrame, mix: Mix) -> DataFrame:
    """`rows` (id, key, size, ...) with source_size, target and draws of (pass, shard, place, words); place: the order within a shard."""
    rows = with_block(rows.withColumn("doc", F.xxhash64("id", F.lit(mix.seed))), mix.sources, mix.rows[0], mix.seed)
    rows = rows.join(small(mix.draws, mix.rows[1]), ["key", "block"], "left").join(small(mix.parts, mix.rows[2]), ["key", "block", "doc", "size"], "left")
    words = lambda d: F.when(d["share"] < 1, F.coalesce("part", F.lit(0))).otherwise(F.col("size")).cast("long")
    place = lambda d: F.xxhash64("doc", d["pass"], d["shard"], F.lit(mix.seed), F.lit("place"))
    draws = F.transform("draws", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), place(d).alias("place"), words(d).alias("words")))
    empty = F.array().cast("array<struct<pass:int,shard:bigint,place:bigint,words:bigint>>")
    return rows.withColumn("draws", F.coalesce(F.filter(draws, lambda d: d["words"] > 0), empty))


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, levels: int | None = None, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """doc_id, size, source_size, target, draws: one row for each input row, without its text.

    draws: (pass, shard, place, words) of each time a shard draws it; words is less than size for the documents at which a shard's share of a source ends,
    one for each source and shard (and its repetitions, all cut alike). Null texts have size 0 and are never drawn; null sources are one source, the
    last. Repeated rows are dealt as others, together. Reruns agree, whatever the partitioning: all choices are hashes of ids, sources and the seed.
    Other columns are ignored; an empty table gives no rows. A source's documents are never gathered; its blocks are.
    """
    rows = df.select(df[id_col].alias("id"), source_key(df[source_col]).alias("key"), size_of(df[text_col].cast("string")).alias("size"))
    return drawn(rows, plan_mix(rows, seed, levels, block_words, weights)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "draws")


def mixed_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", seed: int = 0, levels: int | None = None, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """`df` with a row for each draw of the mix, its text cut after the words drawn; chars_col, if there, is counted again.

    Rows are in the order of their shards and, within a shard, of a hash, so that what is written is laid out like that; texts move once, for that.
    Each row is drawn as itself: rows that share an id, a source and a size are drawn alike. Rows without words are in no draw. Other columns, whatever
    their names, stay as they are; an empty table gives no rows.
    """
    own = F.struct(*[df[c] for c in df.columns])
    rows = df.select(df[id_col].alias("id"), source_key(df[source_col]).alias("key"), size_of(df[text_col].cast("string")).alias("size"), own.alias("own"))
    mix = plan_mix(rows.select("id", "key", "size"), seed, levels, block_words)
    if max(mix.rows) <= BROADCAST_ROWS:
        each = drawn(rows, mix)
    else:  # ids and sizes meet their draws first, texts last and once
        by = ["doc", "key", "size"]
        draws = drawn(rows.select("id", "key", "size").distinct(), mix).where(F.size("draws") > 0).select(*by, "draws").dropDuplicates(by)
        each = rows.withColumn("doc", F.xxhash64("id", F.lit(seed))).join(draws, by)
    each = each.select("own", "size", F.explode("draws").alias("draw"))
    # a shard's rows lie in QUARTERS of its places: partitions in the order of shards and places, without looking at the rows beforehand
    buckets = mix.shards * QUARTERS
    parts = min(buckets, max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bucket = F.col("draw.shard") * QUARTERS + F.shiftright("draw.place", 62) + QUARTERS // 2
    laid = each.repartitionById(parts, F.floor(bucket * parts / buckets).cast("int")).sortWithinPartitions("draw.shard", "draw.place")
    text = F.col("own")[text_col]
    cut = F.when(F.col("draw.words") >= F.col("size"), text).otherwise(first_words(text.cast("string"), F.col("draw.words"))).alias(text_col)
    out = laid.select(*[cut if c == text_col else F.col("own")[c].alias(c) for c in df.columns])
    return out.withColumn(chars_col, F.length(text_col).cast(df.schema[chars_col].dataType)) if chars_col in df.columns else out


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it is written."""
    parts = F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int"))
    return F.array_join(parts, "")
