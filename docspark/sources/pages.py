"""Pages of image inputs: data URIs, file URLs, paths, and containers of several pages (TIFF). Rendering of other formats is left to a model's side.

An input is a unit; its pages keep its number. Files are opened by Spark's reader, so they may lie wherever Spark reads; containers are taken apart in tasks, each by its directories, and
every page comes out as a file of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a value of each TIFF type; tags of width, height, places and lengths of strips and tiles.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
WIDTH, HEIGHT = 256, 257
PIECES = {273: 279, 324: 325}
SCHEMA = "unit long, page int, format string, width int, height int, n_bytes long, content binary, error string"


def tiff_directories(data: bytes) -> Iterator[dict[int, tuple[int, int, bytes]]]:
    """Tag -> (type, count, bytes of the values) of each directory in a row; ends at a directory that was there before."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n, tags = struct.unpack_from(order + "H", data, at)[0], {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = TYPE_BYTES.get(kind, 1) * count
            begin = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if begin + size > len(data):
                raise ValueError("a directory points behind the file's end")
            tags[tag] = (kind, count, data[begin : begin + size])
        yield tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def tiff_numbers(order: str, entry: tuple[int, int, bytes]) -> list[int]:
    kind, count, raw = entry
    return list(struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", raw))


def tiff_page(data: bytes, tags: dict[int, tuple[int, int, bytes]]) -> bytes:
    """A container of one page: the directory's tags, with its strips or tiles behind them."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    own = dict(tags)
    pieces: list[bytes] = []
    for places, lengths in PIECES.items():
        if places in own and lengths in own:
            pieces = [data[a : a + n] for a, n in zip(tiff_numbers(order, own[places]), tiff_numbers(order, own[lengths]))]
            own[places] = (4, len(pieces), b"\0" * 4 * len(pieces))
    head = 8 + 2 + 12 * len(own) + 4
    at, where = head, {}
    for tag, (_, _, raw) in sorted(own.items()):
        if len(raw) > 4:
            where[tag], at = at, at + len(raw) + len(raw) % 2
    begins = []
    for piece in pieces:
        begins.append(at)
        at += len(piece)
    for places in PIECES:
        if places in own and pieces:
            own[places] = (4, len(begins), struct.pack(f"{order}{len(begins)}I", *begins))
    out = data[:2] + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(own))
    for tag, (kind, count, raw) in sorted(own.items()):
        out += struct.pack(order + "HHI", tag, kind, count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", where[tag]))
    out += struct.pack(order + "I", 0) + b"".join(raw + b"\0" * (len(raw) % 2) for _, (_, _, raw) in sorted(own.items()) if len(raw) > 4)
    return out + b"".join(pieces)


def jpeg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one has to be")
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + size
    raise ValueError("no frame")


def pages_of(data: bytes, most: int | None = None) -> Iterator[tuple[str, int, int, bytes]]:
    """(format, width, height, bytes) of each page, the first `most` of them."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        for k, tags in enumerate(tiff_directories(data)):
            if most is not None and k >= most:
                return
            yield "tiff", *(tiff_numbers(order, tags[t])[0] for t in (WIDTH, HEIGHT)), tiff_page(data, tags)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        yield "png", *struct.unpack_from(">II", data, 16), data
    elif data[:2] == b"\xff\xd8":
        yield "jpeg", *jpeg_size(data), data
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        yield "gif", *struct.unpack_from("<HH", data, 6), data
    elif data[:2] == b"BM":
        width, height = struct.unpack_from("<ii", data, 18)
        yield "bmp", width, abs(height), data
    else:
        raise ValueError("no image format that is known")


def page_units(sources: DataFrame, files: DataFrame, most: int | None = None) -> DataFrame:
    """unit, page (from 0 in its unit), format, width, height, n_bytes, content, error: the pages of `sources` (unit, source), at most the first `most` of each.

    A source is a `data:image/...;base64,` URI, a file URL or a path; files: (path, content) of Spark's binaryFile reader, for all that may be named. A source that can't be read has one row, with the
    error and without content; a null one, too. One source is one value; units that name the same file each have its pages.
    """
    bare = lambda c: F.regexp_replace(F.col(c), "^file:/*", "/")
    is_data = F.col("source").startswith("data:image")
    inline = sources.where(is_data).select("unit", F.expr("try_to_binary(substring_index(source, ',', -1), 'base64')").alias("content"))
    named = sources.where(~F.coalesce(is_data, F.lit(False))).withColumn("path", bare("source"))
    opened = named.join(files.select(bare("path").alias("path"), "content"), "path", "left").select("unit", "content")

    def split(batches):
        schema = pa.schema([("unit", pa.int64()), ("page", pa.int32()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("n_bytes", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(1)):  # one input at a time
                rows = []
                try:
                    if (data := data.as_py()) is None:
                        raise ValueError("not found, or no base64")
                    for k, (kind, width, height, content) in enumerate(pages_of(data, most)):
                        rows.append((unit, k, kind, width, height, len(content), content, None))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((unit, len(rows), None, None, None, None, None, str(e) or type(e).__name__))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return opened.unionByName(inline).select(F.col("unit").cast("long").alias("unit"), "content").mapInArrow(split, SCHEMA)


def read_units(spark: SparkSession, sources: list[str], folder: str, most: int | None = None) -> DataFrame:
    """page_units of a list of sources, whose files lie under `folder`."""
    listed = spark.createDataFrame(list(enumerate(sources)), "unit long, source string")
    return page_units(listed, spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), most)
