"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

A shingle is hashed once; the hash's high bits name its bin, and each bin keeps its smallest hash. An empty bin takes the value of the first full
bin in a random order of its own (optimal densification): bin i looks at (a_i t + b_i) mod BINS for t = 0, 1, 2, ..., with a_i odd, so that the order holds
every bin. The first PROBES places are looked up; after that the first full bin is found from the full ones, whose places (j - b_i) / a_i mod BINS are known. The low BITS bits of each value are stored, packed in hexadecimal; likeness is the share of equal values, corrected for values that are equal
by chance.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Bins (a power of two), stored bits of each (8: two hexadecimal digits), words of a shingle.
BINS, BITS, WORDS = 256, 8, 5
PROBES = 8
#: Documents of a range within which the next document is looked up, and the most ranges there are.
RANGE_DOCS, RANGES = 1500, 4096


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the text's runs of `words` words; of all words if there are fewer; an empty text has the hash of no words."""
    parts = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(p):
        last = F.greatest(F.size(p) - words + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(p, i, words)))

    return F.transform(F.array(parts), of)[0]


def bin_of(h: Column, bins: int = BINS) -> Column:
    return F.shiftrightunsigned(h, 64 - (bins.bit_length() - 1)).cast("int")


def fingerprint(text: Column, bins: int = BINS, words: int = WORDS) -> Column:
    """Two hexadecimal digits for each bin."""
    ordered = F.array_sort(shingle_hashes(text, words))  # within a bin by value, bins together

    def firsts(a):
        return F.filter(a, lambda h, i: (i == 0) | (bin_of(h, bins) != bin_of(F.element_at(a, F.greatest(i, F.lit(1))), bins)))

    def packed(a):
        full = F.map_from_arrays(F.transform(a, lambda h: bin_of(h, bins)), F.transform(a, lambda h: (h.bitwiseAND(F.lit(255))).cast("int")))
        row = F.transform(F.array(full), lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.element_at(m, b)))[0]

        def dense(v):
            def value(x, i):
                step = F.pmod(F.xxhash64(i, F.lit("step")), F.lit(bins // 2)).cast("int") * 2 + 1
                begin = F.pmod(F.xxhash64(i, F.lit("begin")), F.lit(bins)).cast("int")
                held = lambda x: x.bitwiseAND(F.lit(bins - 1))
                probe = lambda t: F.element_at(v, held(step * t + begin) + 1)
                # 1 / step: right in 5 bits, then in 10, 20 by Newton's iteration
                start = held((step * 3).bitwiseXOR(F.lit(2)))
                inverse = held(start * (2 - held(step * start)))
                inverse = held(inverse * (2 - held(step * inverse)))
                place = lambda h: held((bin_of(h, bins) - begin) * inverse)
                nearest = F.array_min(F.transform(a, lambda h: F.struct(place(h).alias("place"), h.bitwiseAND(F.lit(255)).cast("int").alias("low"))))
                # coalesce stops at the first full bin; few get to the last
                return F.coalesce(x, *[probe(t) for t in range(PROBES)], nearest["low"])

            return F.transform(v, value)

        return F.transform(F.array(row), dense)[0]

    values = F.transform(F.array(F.transform(F.array(ordered), firsts)[0]), packed)[0]
    digit = lambda x: F.substring(F.lit("0123456789abcdef"), x + 1, F.lit(1))
    return F.array_join(F.transform(values, lambda x: F.concat(digit(F.shiftright(x, 4)), digit(x.bitwiseAND(F.lit(15))))), "")


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """An estimate, 0 to 1, of the Jaccard likeness of two texts' shingles."""
    equal = F.size(F.filter(F.zip_with(F.regexp_extract_all(a, F.lit(".."), F.lit(0)), F.regexp_extract_all(b, F.lit(".."), F.lit(0)), lambda x, y: x == y), lambda z: z))
    chance = 1 / (1 << bits)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (equal / bins - chance) / (1 - chance)))


def with_next(df: DataFrame, columns: list[str], range_docs: int = RANGE_DOCS, most: int = RANGES) -> DataFrame:
    """`df` (doc_id and `columns`) with next_<column> of the next row, ascending (doc_id, columns); the first row's after the last.

    Rows are dealt into ranges of doc_id of about equal size and sorted there; each range is also given the first rows of the one after. Only range
    bounds, at most `most`, reach the driver. A null id comes before all others. Ids that aren't whole numbers are ordered as text, and dealt into ranges by the
    seven bytes after those that all of them begin with.
    """
    n = df.count()
    if not n:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    if isinstance(df.schema["doc_id"].dataType, IntegralType):
        own = F.col("doc_id").cast("long")
    else:
        ends = df.select(F.col("doc_id").cast("string").cast("binary").alias("b")).agg(F.min("b").alias("low"), F.max("b").alias("high")).first()
        same = len(commonprefix([bytes(ends.low or b""), bytes(ends.high or b"")]))
        own = F.conv(F.rpad(F.hex(F.substring(F.col("doc_id").cast("string").cast("binary"), same + 1, 7)), 14, "0"), 16, 10).cast("long")
    key = F.coalesce(own, F.lit(-(1 << 63)))
    parts = max(1, min(most, -(-n // range_docs)))
    cuts = df.select(F.percentile_approx(key, [k / parts for k in range(1, parts)] or [0.5], max(10_000, 10 * parts))).first()[0] or []
    bounds = sorted(set(cuts))
    powers = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    array = F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>")
    # binary search: how many bounds are below the key
    place = F.lit(0)
    if bounds:
        place = F.aggregate(
            F.array(*map(F.lit, powers)), F.lit(0), lambda s, p: F.when((s + p <= len(bounds)) & (F.get(array, s + p - 1) < key), s + p).otherwise(s)
        )
    firsts = sorted((r[0], r[1]) for r in df.groupBy(place.alias("range")).agg(F.min(key)).collect())
    before = [(firsts[k][1], firsts[k - 1][0], k == 0) for k in range(len(firsts))]
    spark = df.sparkSession
    given = F.broadcast(spark.createDataFrame(before, "first long, into int, around boolean"))  # a row for each range
    marked = df.withColumn("key", key).withColumn("range", place).join(given, F.col("key") == F.col("first"), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("lent"))
    lent = F.struct(F.col("into").alias("range"), F.lit(1).alias("lent"))
    dealt = marked.withColumn("to", F.explode(F.when(F.col("into").isNull(), F.array(own)).otherwise(F.array(own, lent)))).select("doc_id", *columns, "key", "to.range", "to.lent")
    by = Window.partitionBy("range").orderBy("lent", "key", "doc_id", *columns)
    out = dealt.select("doc_id", *columns, "lent", *[F.lead(c).over(by).alias(f"next_{c}") for c in columns])
    return out.where("lent = 0").drop("lent")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many, or all, of the one that follows."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each input row.

    A null text counts as empty; an empty text has the fingerprint of no words. Repeated rows follow one another; among equal ids rows are
    sorted by text. A single row is its own next. Other columns are ignored; an empty table gives no rows.
    """
    own = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    both = with_next(own.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    made = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited(F.col("text"), F.col("next_text")).alias("edited"))
    prints = made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
