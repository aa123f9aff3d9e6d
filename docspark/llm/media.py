"""Media columns stored as content-defined chunks.

A payload is stored as the 8-bit samples of a WAV file. A file is cut where a rolling gear hash over its last 32 bytes has LOG2_MEAN leading zero
bits, but for cuts nearer than LEAST and farther than MOST bytes. Each distinct chunk is held once, by its digest, compressed; a file is the ordered
list of its chunks. A join of lists finds the digests that stand in several places: those chunks are in a store, deduplicated by digest, while
a chunk that no other place shares lies in its file's list, so its bytes move once. Files are put together by joining lists with the store and are verified
against their own digest before anything is read from them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import as_bytes, in_slices, map_batches

#: Bytes of the shortest and longest chunk; log2 of the mean beyond the shortest.
LEAST, MOST, LOG2_MEAN = 128, 8 << 10, 9
#: Bytes of the digests that chunks and files go by; log2 of the bits that tell which chunks may be shared: 2 MB, whatever the corpus.
DIGEST, TABLE_BITS = 16, 24
RATE, UNIT = 8000, 64

HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")

#: A random number for each byte, by rule.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest(), "little") for b in range(256)], np.uint32)


def payload_of(text: bytes) -> bytes:
    """The bytes, filled up with 0 to a positive multiple of UNIT."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel of unsigned 8-bit samples."""
    return HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of such a file."""
    riff, _, wave, fmt, _, code, channels, _, _, _, bits, data, size = HEADER.unpack_from(media)
    if (riff, wave, fmt, code, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 1, 1, 8, b"data") or len(media) != HEADER.size + size:
        raise ValueError("not a WAV file of 8-bit samples")
    return media[HEADER.size :]


def gear_hashes(data: bytes) -> np.ndarray:
    """After each byte, the sum of GEAR[byte k bytes before] << k, k < 32, modulo 2**32."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for lag in (1, 2, 4, 8, 16):
        more = h.copy()
        more[lag:] += h[:-lag] << np.uint32(lag)
        h = more
    return h


def cut(data: bytes, least: int = LEAST, most: int = MOST, log2_mean: int = LOG2_MEAN) -> list[bytes]:
    """The chunks of `data`, in order; at least one."""
    if len(data) <= least:
        return [data]
    ends, begin = [], 0
    for at in np.flatnonzero(gear_hashes(data) >> np.uint32(32 - log2_mean) == 0).tolist() + [len(data) - 1]:
        while at + 1 - begin > most:
            ends.append(begin + most)
            begin += most
        if at + 1 - begin >= least or at + 1 == len(data):
            ends.append(at + 1)
            begin = at + 1
    return [data[a:b] for a, b in zip([0, *ends], ends) if b > a]


def sample_features(payload: bytes) -> str:
    """mean, root mean square and crossing rate of the samples about their middle, peak, and entropy in bits."""
    raw = np.frombuffer(payload, np.uint8)
    x = raw.astype(np.float64) - 128
    share = np.bincount(raw, minlength=256) / len(raw)
    entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    crossings = np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)) / len(x)
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};cross={crossings:.6f};peak={int(np.abs(x).max())};entropy={entropy + 0.0:.4f}"


def digest_of(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:DIGEST]


def manifests(source: DataFrame, kind: str) -> DataFrame:
    """doc_id, n_bytes, media_id (digest of the stored file) of `source` (doc_id, text)."""

    def mark(batches):
        for batch in batches:
            texts = as_bytes(batch.column(1))
            ids = [digest_of(to_wav(payload_of(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_bytes", "media_id"])

    return map_batches(source.select("doc_id", "text"), mark, f"doc_id {kind}, n_bytes bigint, media_id binary")


def each_file(batches) -> Iterator[list[tuple[bytes, list[bytes]]]]:
    """(media_id, chunks) of the files of each batch of texts, copies within a batch once."""
    for batch in in_slices(batches, 100):
        files = {}
        for t in set(as_bytes(batch.column(0))):
            media = to_wav(payload_of(t))
            files[digest_of(media)] = cut(media)
        yield sorted(files.items())


def chunk_lists(texts: DataFrame, table=None) -> DataFrame:
    """media_id, place, digest: where chunks stand, each file once; with `table`, only those that may be shared."""

    def rows(batches):
        for files in each_file(batches):
            found = [(m, k, digest_of(c)) for m, chunks in files for k, c in enumerate(chunks)]
            if table is not None:
                found = [r for r in found if is_shared(table.value, r[2])]
            kinds = (pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], ["media_id", "place", "digest"])

    return map_batches(texts.select("text"), rows, "media_id binary, place int, digest binary").distinct()


def shared_table(lists: DataFrame) -> np.ndarray:
    """Bits by which digests that stand in more than one place of `lists` are told from most others: 2**TABLE_BITS of them."""
    many = lists.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = F.conv(F.hex(F.substring("digest", 1, 8)), 16, 10).cast("decimal(20,0)") % (1 << TABLE_BITS)
    words = many.select(place.cast("long").alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def is_shared(table: np.ndarray, digest: bytes) -> bool:
    """May be true of a digest that isn't: its chunk then is in the store all the same."""
    h = int.from_bytes(digest[:8], "big") % (1 << TABLE_BITS)
    return bool(int(table[h >> 6]) >> (h & 63) & 1)


def stored(texts: DataFrame, table, of_store: bool) -> DataFrame:
    """The store (digest, data) of chunks that may be shared, or the files (media_id, parts), whose parts are null where the store has them."""

    def rows(batches):
        import zstandard

        press, shared = zstandard.ZstdCompressor(level=3), table.value
        for files in each_file(batches):
            store, lists = {}, []
            for media_id, chunks in files:
                parts = []
                for c in chunks:
                    digest = digest_of(c)
                    inside = not is_shared(shared, digest)
                    if of_store and not inside and digest not in store:
                        store[digest] = press.compress(c)
                    elif not of_store:
                        parts.append(press.compress(c) if inside else None)
                lists.append((media_id, parts))
            if of_store:
                yield pa.RecordBatch.from_arrays([pa.array(store.keys(), pa.binary()), pa.array(store.values(), pa.binary())], ["digest", "data"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in lists], pa.binary()), pa.array([p for _, p in lists], pa.list_(pa.binary()))], ["media_id", "parts"])

    schema = "digest binary, data binary" if of_store else "media_id binary, parts array<binary>"
    return map_batches(texts.select("text"), rows, schema).dropDuplicates(["digest" if of_store else "media_id"])


def whole_files(texts: DataFrame) -> DataFrame:
    """(media_id, parts: the compressed chunks in order) of each distinct file, put together from lists and store."""
    table = texts.sparkSession.sparkContext.broadcast(shared_table(chunk_lists(texts)))
    files = stored(texts, table, False)
    asked = chunk_lists(texts, table)
    fetched = asked.join(stored(texts, table, True), "digest").groupBy("media_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "data"))).alias("fetched"))
    both = files.join(fetched, "media_id", "left")
    return both.select("media_id", F.transform("parts", lambda p, k: F.coalesce(p, F.try_element_at("fetched", k))).alias("parts"))


def read_media(files: DataFrame) -> DataFrame:
    """Features of each file of `files` (media_id, parts: the compressed chunks in order), verified against media_id."""
    names = ["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in in_slices(batches, 50):
            out = []
            for media_id, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                media = b"".join(unpress.decompress(p) for p in parts)
                digest = hashlib.sha256(media)
                if digest.digest()[:DIGEST] != media_id:
                    raise ValueError(f"a stored file differs from its digest {media_id.hex()}")
                payload = from_wav(media)
                out.append((media_id, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), digest.hexdigest(), sample_features(payload)))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return map_batches(
        files.select("media_id", "parts"), read, "media_id binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and what was read back from the stored file: one row for each input row.

    A null text counts as empty; its payload is UNIT bytes of 0. Equal texts share one file, repeated rows too, and like texts share chunks. A task holds a
    file at a time, never a group of copies. Other columns are ignored; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    return manifests(source, kind).join(read_media(whole_files(source)), "media_id").drop("media_id")
