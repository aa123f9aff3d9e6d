"""Token counts: exact counts of whole texts, spliced from overlapping chunks.

A text is cut into chunks of CHUNK_BYTES that overlap. Each chunk is encoded unit by unit, with the units' offsets. A unit ends at ASCII white space and at
either side of an ASCII digit, which no token of the vocabularies handled here spans: their patterns take digits one by one, and nothing is composed
across them. Two neighbours are spliced at the first boundary in their overlap that both have and that is proven stable: all whole units from it to
the overlap's end have the same ids in both. Where the overlap holds no such boundary (a long run without either), it is widened, in the end to the
whole chunk, and then the chunk itself, each time by a factor, so that the work stays in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docspark.llm.common import as_bytes, map_batches
from docspark.llm.subwords import WordMemo, memo, tokenizer, word_vocabulary

#: Bytes of a chunk and of the overlap that is tried first.
CHUNK_BYTES, OVERLAP_BYTES = 4096, 128
#: Longer units aren't remembered.
MEMO_BYTES = 64

UNIT = re.compile(rb"[0-9]|[^0-9 \t-\r]+")


def encoded(words: WordMemo, path: str, chunk: bytes) -> list[bytes]:
    """The ids of each of the chunk's units, packed."""
    units = UNIT.findall(chunk)
    distinct = set(units)
    long = {u for u in distinct if len(u) > MEMO_BYTES}
    words.learn(distinct - long if long else distinct)
    if not long:
        return list(map(words.__getitem__, units))
    import numpy as np

    known = {u: np.array(tokenizer(path).encode(u.decode(), add_special_tokens=False).ids, "<u4").tobytes() for u in long}
    return [known[u] if u in known else words[u] for u in units]


def whole_character(text: bytes, at: int) -> int:
    """The place at or before `at` where a character begins."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def junction(text: bytes, left: list[bytes], right: list[bytes], begin: int, end: int) -> tuple[int, int, int] | None:
    """How many units of `left`, a chunk that ends at `end`, come before the first proven boundary in text[begin:end], how many of `right`, a chunk that begins at
    `begin`, are dropped, and where it is; None without one. A unit that the overlap's edge may cut is no evidence."""
    units = [m.span() for m in UNIT.finditer(text, begin, end)]
    if not units:
        return None
    edge = lambda at: 0 < at < len(text) and UNIT.fullmatch(text[at - 1 : at + 1]) is not None  # noqa: E731  both sides in one unit
    cut_first, cut_last = units[0][0] == begin and edge(begin), units[-1][1] == end and edge(end)
    first, n = int(cut_first), len(units) - int(cut_last)
    if first >= n:
        return None
    skipped = len(left) - len(units)
    if left[skipped + first : skipped + n] != right[first:n]:
        return None
    return skipped + first, first, units[first][0]


def spliced(words: WordMemo, path: str, text: bytes, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> Iterator[list[bytes]]:
    """The packed ids of the whole text's units, from overlapping chunks."""
    at, end = 0, whole_character(text, min(chunk, len(text)))
    now = encoded(words, path, text[:end])
    while end < len(text):
        wide = overlap
        while True:
            begin = whole_character(text, max(at, end - wide))
            upto = whole_character(text, min(len(text), end + max(chunk - overlap, wide)))
            following = encoded(words, path, text[begin:upto])
            cut = junction(text, now, following, begin, end)
            if cut or begin == at:
                break
            wide *= 4
        if cut:
            yield now[: cut[0]]
            now, at, end = following[cut[1] :], cut[2], upto
        else:
            end = whole_character(text, min(len(text), end + 2 * (end - at)))
            now = encoded(words, path, text[at:end])
    yield now


def count_tokens(
    df: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    chunk: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each input row, in one pass without a shuffle.

    `path`: a vocabulary file for the `tokenizers` library whose texts can be split at ASCII white space and digits (see subwords.py). A null text
    counts as empty: 0 bytes, 0 tokens. Repeated rows are counted again; other columns are ignored; an empty table gives no rows. A chunk of under 16
    bytes, and an overlap that isn't smaller than half of it, at least 1, are refused.
    """
    if chunk < 16 or not 0 < overlap <= chunk // 2:
        raise ValueError("a chunk has 16 bytes or more and overlaps by at least one and at most half of them")
    path = path or word_vocabulary()
    ids = df.schema[id_col].dataType.simpleString()

    def count(batches):
        words = memo(path)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            tokens = [sum(sum(map(len, part)) for part in spliced(words, path, t, chunk, overlap)) // 4 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_batches(
        df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")),
        count,
        f"doc_id {ids}, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )
