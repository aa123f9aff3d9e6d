"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a value in common within r bits of both. So every distinct fingerprint emits all values within r,
the shuffle brings equal values together, and each fingerprint is linked to the smallest one that meets it there; links are deduplicated and
verified. For r = 1 all that meet at a value are at most 2 apart, so linking to the smallest loses no connection and needs no pairs.
Components of the links come from repeated contraction: each node points to its smallest neighbour, pointers are followed to their end, links are
moved to the ends. Nodes are compared by fingerprint, which is as good as a random order, so a few rounds do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import as_bytes, checkpointed, map_batches, written

#: A round of contraction follows this many pointers at most; what is left comes in the next round.
JUMPS = 2


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's shingles, repeats included, as an unsigned number."""
    import xxhash

    parts = text.lower().split()  # as bytes: A-Z only, ASCII white space only
    n = len(parts) - words + 1
    if not parts:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)  # one shingle: each of its bits is in over half
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins[:n].tolist(), ends[words - 1 :].tolist())], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bounded scratch space for long texts
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), one row for each input row. A null text counts as empty, with fingerprint 0."""
    ids = df.schema[id_col].dataType.simpleString()

    def compute(batches):
        for batch in batches:
            got = np.array([simhash(t, words) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["doc_id", "fp"])

    return map_batches(df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")), compute, f"doc_id {ids}, fp bigint")


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct, verified links (a, b), b < a, that connect all of `distinct`'s fingerprints (column fp) within `radius`, 1 or 2.

    Each value's fingerprints, 65 at most, are linked to the smallest of them.
    """
    if radius not in (1, 2):
        raise ValueError("half the radius has to be one bit at most: a wider ball has thousands of values")
    # dealt out anew: the few partitions that hold the fingerprints are too few for 65 times as many rows (by a hash of their own, else the shuffle is left out)
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    variants = distinct.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    met = checkpointed(variants.groupBy("variant").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    # two fingerprints at a value are the smallest and the largest; the few values with more are joined to their members again
    two = met.select(F.col("high").alias("a"), F.col("low").alias("b"))
    more = met.where("n > 2").select("low", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("variant")))).alias("fp"))
    three = more.join(distinct, "fp").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return two.unionByName(three).where("a != b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for every node of `links` (a, b). Rows, not groups, move between rounds."""
    links = written(links.select("a", "b").where("a != b"))
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
        for _ in range(JUMPS):
            higher = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            up = up.join(higher, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        up = written(up)
        ends = [up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"]
        links = written(links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a != b").distinct())
        if found is None:
            found = up
        else:
            moved = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = written(found.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links within `radius` bits): one row for each input row.

    Null and empty texts have fingerprint 0 and are linked like any others. A null id never becomes a component's id unless it has no
    other. Repeated rows stay and share a component. Other columns are ignored; an empty table gives no rows. Copies meet by an
    aggregate over fingerprints, so the size of their group costs nothing.
    """
    marked = checkpointed(fingerprints(df, id_col, text_col, words))
    smallest = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(ball_links(smallest.select("fp"), radius))
    whole = smallest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    whole = checkpointed(whole)
    linked = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    named = whole.select("fp", "root").join(linked, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
