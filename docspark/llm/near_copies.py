"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are in one ball of SimHashes, by op3's ball hashing, or share a band of MinHash values. Work on them is linear wherever copies abound: in each band's group all are compared with the member that
agrees with most others, which near copies of one text nearly always are; only what that leaves in different components is compared across, by
signatures first. Every link is verified on whole texts, of which only those of candidates move. Rows that are in no group of copies are never shuffled:
a bounded table of bits tells most of them apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from docspark.llm.common import as_bytes, checkpointed, in_slices, map_batches, release_memory
from docspark.llm.simhash import ball_links, components, simhash

#: Words of a shingle; texts with a Jaccard similarity of ALIKE or more, as a fraction, are near copies.
SHINGLE_WORDS, ALIKE = 5, (4, 5)
#: Candidates share one of BANDS values, each of BAND_ROWS MinHash values: two texts 0.8 alike share none with probability (1 - 0.8^6)^24 = 7e-4.
BANDS, BAND_ROWS = 24, 6
#: Across components, pairs whose signatures (SIGNATURE MinHash values, a byte each) estimate less than LEAST_ESTIMATE aren't verified: 4.2 deviations below 0.8, passed over with
#: probability 1.1e-5.
SIGNATURE, LEAST_ESTIMATE = 288, 0.7
#: The texts of a group with more pairs than this across its components are joined on their rarest shingles instead, which passes over none of them.
GROUP_PAIRS = 20_000_000
#: Texts compared with one in one task.
GROUP_TEXTS = 2000
#: log2 of the bits that tell which rows may be in a group: 2**(TABLE_BITS - 6) rows are broadcast at most.
TABLE_BITS = 24
#: Words a worker remembers with their hashes.
MEMO_WORDS = 150_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


KNOWN = WordHashes()


def forget() -> None:
    """Empties the worker's memo at a task's end."""
    KNOWN.clear()
    release_memory()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: bytes) -> np.ndarray:
    """Hashes of the text's distinct shingles, sorted; a shorter text is one shingle. A-Z count as a-z, white space is ASCII's."""
    parts = text.lower().split()
    words = np.fromiter(map(KNOWN.__getitem__, parts), np.uint64, len(parts))
    n = len(words) - SHINGLE_WORDS + 1
    if n <= 1:
        return mixed(np.array([sum(int(w) * 0x9E3779B97F4A7C15 ** (k + 1) for k, w in enumerate(words)) + len(words) & 0xFFFFFFFFFFFFFFFF], np.uint64))
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        total = (total + words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mixed(total))


def minhashes(sets: list[np.ndarray], n: int = BANDS * BAND_ROWS, seed: int = 42) -> np.ndarray:
    """(texts, n) MinHash values, none of the sets being empty."""
    rng = np.random.default_rng(seed)
    salts, odd = rng.integers(0, 1 << 64, (2, n), np.uint64)
    every, begins = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((every ^ salts[k]) * (odd[k] | np.uint64(1)), begins)
    return out


def band_values(values: np.ndarray) -> np.ndarray:
    """(texts, BANDS): one value for each band of MinHash values; bands never share one but by chance."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
    for k in range(BAND_ROWS):
        out = mixed((out ^ values[:, k::BAND_ROWS]) * np.uint64(0x9E3779B97F4A7C15))
    return out


def signatures(rows: DataFrame) -> DataFrame:
    """id, row, node (a digest of the set of shingles), size (their number), bands, fp (the SimHash, as a signed long) of `rows` (id, row, text)."""
    import xxhash

    kind = rows.schema["id"].dataType.simpleString()

    def compute(batches):
        for batch in in_slices(batches, 200):
            texts = as_bytes(batch.column(2))
            sets, fps = [shingle_hashes(t) for t in texts], np.array([simhash(t) for t in texts], np.uint64).view(np.int64)
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(band_values(minhashes(sets)).view(np.int64).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), bands, pa.array(fps)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "node", "size", "bands", "fp"])
        forget()

    return map_batches(rows.select("id", "row", "text"), compute, f"id {kind}, row bigint, node bigint, size int, bands array<bigint>, fp bigint")


def ball_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of `nodes` (node, fp) that connect all whose SimHashes differ in two bits at most: those of one SimHash with the smallest of them, and these by ball hashing."""
    first = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")))
    same = nodes.join(first.where("n > 1"), "fp").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    near = ball_links(first.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return checkpointed(same.unionByName(near))


def bit_place(key: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("bit")), F.lit(1 << TABLE_BITS))


def possible(rows: DataFrame, wanted: DataFrame, key: str = "row") -> DataFrame:
    """`rows` with `may`: false only where `key` isn't among `wanted`'s. The table of bits has 2**(TABLE_BITS - 6) rows at most, whatever `wanted` has."""
    table = wanted.select(bit_place(key).alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    placed = rows.withColumn("h", bit_place(key)).withColumn("word", F.shiftright("h", 6)).join(F.broadcast(table), "word", "left")
    return placed.withColumn("may", F.coalesce(F.expr("(bits & shiftleft(1L, cast(h & 63 as int))) != 0"), F.lit(False))).drop("word", "bits", "h")


def candidate_texts(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """node, text (words joined by spaces), signature (a byte of each MinHash value) of `wanted` (node, row): texts of other rows aren't shuffled."""

    def compute(batches):
        for batch in in_slices(batches, 200):
            texts = [b" ".join(t.lower().split()) for t in as_bytes(batch.column(1))]
            values = (minhashes([shingle_hashes(t) for t in texts], SIGNATURE, 43) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(56)).astype(np.uint8).view(np.int8)
            marks = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1]).cast(pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), marks], ["node", "text", "signature"])
        forget()

    near = possible(rows.select("row", "text"), wanted).where("may").select("row", "text")
    found = near.join(wanted, "row").select("node", "text").dropDuplicates(["node"])
    return checkpointed(map_batches(found, compute, "node bigint, text string, signature array<tinyint>"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose `texts` (node, text) are ALIKE or more, by all their shingles.

    A text `b` travels once for each GROUP_TEXTS texts that are compared with it, not once a pair.
    """

    def compare(batches):
        place = own = None
        for batch in in_slices(batches, 200):
            found = []
            for a, b, part, kind, text in zip(*[batch.column(k).to_pylist() for k in range(4)], as_bytes(batch.column(4))):
                shingles = shingle_hashes(text)
                if kind == 0:
                    place, own = (b, part), shingles
                    continue
                if place != (b, part):
                    raise ValueError("a text to compare with is missing")
                common = len(np.intersect1d(own, shingles, assume_unique=True))
                if common * ALIKE[1] >= (len(own) + len(shingles) - common) * ALIKE[0]:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        forget()

    pairs = checkpointed(pairs.distinct())
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP_TEXTS).cast("int").alias("parts"))
    of = lambda name: texts.select(F.col("node").alias(name), "text")
    heads = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(of("b"), "b").select(F.col("b").alias("a"), "b", "part", F.lit(0).alias("kind"), "text")
    others = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")).join(of("a"), "a").select("a", "b", "part", F.lit(1).alias("kind"), "text")
    dealt = heads.unionByName(others).repartition("b", "part").sortWithinPartitions("b", "part", "kind")
    return checkpointed(map_batches(dealt, compare, "a bigint, b bigint"))


def sharing_rare(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), b < a, of `rows` (node, root, text) of different roots that share one of their rarest shingles and fit in size: all pairs that are ALIKE are among them.

    Shingles are ordered by how many texts have them. Two texts that are ALIKE have that share of either's shingles in common, so not all that they share is behind the first
    1 - ALIKE of either's shingles, and one more: only those are joined.
    """

    def spread(batches):
        for batch in in_slices(batches, 20):
            sets = [shingle_hashes(t).view(np.int64) for t in as_bytes(batch.column(2))]
            size = np.array([len(s) for s in sets])
            of = pa.array(np.repeat(np.arange(len(sets)), size))
            columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(np.repeat(size, size).astype(np.int32)), pa.array(np.concatenate(sets))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "root", "size", "shingle"])
        forget()

    every = checkpointed(map_batches(rows.select("node", "root", "text"), spread, "node bigint, root bigint, size int, shingle bigint"))
    counts = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    ordered = every.join(counts, "shingle", "left").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("texts", F.lit(1)), "shingle")))
    first = F.col("size") - F.ceil(F.col("size") * ALIKE[0] / ALIKE[1]) + 1
    rare = ordered.where((F.col("place") <= first) & F.col("texts").isNotNull())  # a shingle that one text has meets none
    x, y = (rare.select("shingle", *[F.col(c).alias(f"{n}_{c}") for c in ("node", "root", "size")]) for n in "xy")
    fits = (F.col("x_size") * ALIKE[1] >= F.col("y_size") * ALIKE[0]) & (F.col("y_size") * ALIKE[1] >= F.col("x_size") * ALIKE[0])
    met = x.join(y, "shingle").where((F.col("x_root") != F.col("y_root")) & (F.col("x_node") > F.col("y_node")) & fits)
    return met.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def similar_links(distinct: DataFrame, rows: DataFrame, balls: DataFrame | None = None) -> DataFrame:
    """Distinct links (a, b) that connect the nodes of `distinct` (node, row, size, bands) whose texts are ALIKE or more; every link is verified.

    `rows` (row, text) holds the texts. balls: further candidates (a, b), which are verified with the first. In each group that shares a band value, all members are compared with the one that shares most values with
    others. What lies in different components after that is compared across: each pair once, in the first group that both are in, if signatures
    estimate LEAST_ESTIMATE or more. Nothing is capped: texts of groups with very many such pairs, see GROUP_PAIRS, meet on their rarest shingles.
    """
    fits = lambda x, y: (x * ALIKE[1] >= y * ALIKE[0]) & (y * ALIKE[1] >= x * ALIKE[0])  # noqa: E731  else the sizes alone rule it out
    bands = distinct.select("node", "size", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = checkpointed(bands.join(shared, "key"))
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    wanted = company.select("node")
    if balls is not None:
        wanted = wanted.unionByName(balls.select(F.col("a").alias("node"))).unionByName(balls.select(F.col("b").alias("node")))
    texts = candidate_texts(distinct.join(wanted, "node", "left_semi").select("node", "row"), rows)
    members = checkpointed(members.join(company, "node").drop("n"))
    centre = members.groupBy("key").agg(F.max(F.struct("company", "node", "size")).alias("centre"))
    star = members.join(centre, "key").where((F.col("node") != F.col("centre.node")) & fits(F.col("size"), F.col("centre.size")))
    pairs = star.select(F.col("node").alias("a"), F.col("centre.node").alias("b"))
    links = verified(pairs if balls is None else pairs.unionByName(balls), texts)
    placed = members.join(components(links), "node", "left").select("key", "band", "node", "size", F.coalesce("root", "node").alias("root"))
    wide = distinct.select("node", "bands").join(texts.select("node", "signature"), "node")
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    groups = parts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("n")).select("key", F.col("most.root").alias("main"), (F.col("n") - F.col("most.c")).alias("outside"), "n")
    left = checkpointed(placed.join(groups.where("outside > 0"), "key"))
    many = F.col("outside") * F.col("n") > GROUP_PAIRS
    now = left.where(~many).join(wide, "node")
    x = now.where("root != main").select("key", "band", "main", *[F.col(c).alias(f"x_{c}") for c in ("node", "size", "root", "bands", "signature")])
    y = now.select("key", *[F.col(c).alias(f"y_{c}") for c in ("node", "size", "root", "bands", "signature")])
    equal = lambda a, b, of=lambda v: v: F.size(F.filter(F.zip_with(of(F.col(a)), of(F.col(b)), lambda p, q: p == q), lambda e: e))
    first = equal("x_bands", "y_bands", lambda v: F.slice(v, F.lit(1), F.col("band"))) == 0  # the pair's first group
    share = lambda a, b: (equal(a, b) / SIGNATURE - 1 / 256) / (1 - 1 / 256)
    once = (F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("main")) | (F.col("x_node") > F.col("y_node")))
    pairs = x.join(y, "key").where(once & fits(F.col("x_size"), F.col("y_size")) & first & (share("x_signature", "y_signature") >= LEAST_ESTIMATE))
    links = links.unionByName(verified(pairs.select(F.col("y_node").alias("a"), F.col("x_node").alias("b")), texts))
    crowd = left.where(many).select("node", "root").distinct()
    if not crowd.isEmpty():
        near = sharing_rare(crowd.join(texts.select("node", "text"), "node"))
        signed = [texts.select(F.col("node").alias(c), F.col("signature").alias(f"{c}_signature")) for c in "ab"]
        near = near.join(signed[0], "a").join(signed[1], "b").where(share("a_signature", "b_signature") >= LEAST_ESTIMATE)
        links = links.unionByName(verified(near.select("a", "b"), texts))
    return links.distinct()


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row. Nulls count by their place: the hash function alone passes over them. What holds other values is hashed as JSON, its nulls written out."""
    parts: list[Column] = []
    for k, field in enumerate(df.schema):
        value = df[field.name]
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            value = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        parts += [F.when(df[field.name].isNull(), F.lit(k)).otherwise(F.lit(-1)), value]
    return F.xxhash64(*parts)


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, whole, without near copies: of each group of linked rows the one with the smallest id stays, once.

    Null ids come before all others; among equal ids the smallest hash of the whole row decides, so every run keeps the same. Rows are told apart by that
    hash, not by their id: rows that share an id, or have none, go only if their texts are near copies. Null texts and texts without words are
    copies of one another. Rows equal in all columns are one. Texts are compared whole, whatever their length. Other columns, whatever their names, come back
    as they were; an empty table gives no rows.
    """
    rows = df.select(df[id_col].alias("id"), row_hash(df).alias("row"), df[text_col].cast("string").alias("text"), F.struct(*[df[c] for c in df.columns]).alias("own"))
    marked = checkpointed(signatures(rows))
    place = F.struct(F.col("id").isNotNull().alias("has"), "id", "row")
    nodes = checkpointed(marked.groupBy("node").agg(F.min(place).alias("first"), F.max("size").alias("size"), F.first("bands").alias("bands"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")))
    links = similar_links(nodes.select("node", F.col("first.row").alias("row"), "size", "bands"), rows, ball_pairs(nodes.select("node", "fp")))
    whole = nodes.select("node", "first", "n").join(components(links), "node", "left").where("root is not null or n > 1")
    whole = whole.select("node", "first", F.coalesce("root", "node").alias("root"))
    kept = whole.groupBy("root").agg(F.min("first").alias("kept"))
    of_node = whole.join(kept, "root").select("node", "kept")
    fates = marked.select("id", "row", "node").join(of_node, "node").groupBy("row").agg(F.max(place != F.col("kept")).alias("goes"), F.count(F.lit(1)).alias("n"))
    fates = checkpointed(fates.where("goes or n > 1").select("row", "goes"))
    placed = possible(rows.select("row", "own"), fates)
    doubtful = placed.where("may").join(fates, "row", "left")
    out = placed.where("not may").select("own").unionByName(doubtful.where("goes is null").select("own"))
    if not fates.where("not goes").isEmpty():  # rows equal in all columns
        out = out.unionByName(doubtful.where("not goes").dropDuplicates(["row"]).select("own"))
    return out.select(*[F.col("own")[c].alias(c) for c in df.columns])
