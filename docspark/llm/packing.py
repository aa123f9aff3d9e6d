"""Packing by lexical retrieval: each window is filled with documents like its seed.

Documents are dealt into shards as they are read, so nothing is shuffled. Full windows of long documents are written as they are read; what is left of them, with
the short documents, are a shard's fragments, each shorter than a window: a shard holds SHARD_DOCS of them at most, whatever its documents' length. A BM25 inverted index over the fragments' token ids is built for the shard. Fragments are seeds in turn;
for each seed that is still unused the index returns the unused fragments most like it, which greedily fill the window; the last of them is
cut where the window ends and its rest stays a fragment. What a shard has left over at its end goes to sequences of a power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docspark.llm.common import as_bytes, in_slices, map_batches
from docspark.llm.subwords import encode_words, memo, word_vocabulary

#: Tokens of a sequence; documents of a shard, within one Spark partition.
WINDOW, SHARD_DOCS = 2048, 1000
K1, B = 1.2, 0.75


class Index:
    """Inverted BM25 index of a shard. Terms in more than half of the fragments have weight 0 (Robertson's idf, not below 0)."""

    def __init__(self, fragments: list[np.ndarray]):
        self.n = len(fragments)
        size = np.array([len(f) for f in fragments], np.float64)
        doc = np.repeat(np.arange(self.n, dtype=np.int64), size.astype(np.int64))
        term = np.concatenate(fragments).astype(np.int64) if self.n else np.empty(0, np.int64)
        key, tf = np.unique(term * max(self.n, 1) + doc, return_counts=True)
        term, self.doc = key // max(self.n, 1), (key % max(self.n, 1)).astype(np.int32)
        self.terms, begin, df = np.unique(term, return_index=True, return_counts=True)
        idf = np.maximum(0, np.log((self.n - df + 0.5) / (df + 0.5)))
        length = 1 - B + B * size / max(size.mean() if self.n else 1, 1e-9)
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * length[self.doc])
        # postings of terms with a weight, by fragment: which terms a seed asks for
        self.begin, self.end = begin, begin + df
        number = np.repeat(np.arange(len(self.terms)), df)
        useful = np.repeat(idf > 0, df)
        order = np.argsort(self.doc[useful], kind="stable")
        self.asked = number[useful][order]
        self.asked_at = np.searchsorted(self.doc[useful][order], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every fragment for the seed's distinct terms."""
        asked = self.asked[self.asked_at[seed] : self.asked_at[seed + 1]]
        if not len(asked):
            return np.zeros(self.n)
        begin, count = self.begin[asked], self.end[asked] - self.begin[asked]
        total = np.cumsum(count)
        at = np.arange(total[-1]) + np.repeat(begin - (total - count), count)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(lengths: np.ndarray, tokens: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length). Each token is in one piece; only a shard's last sequences are shorter than a window,
    and their lengths are powers of two. Ties in a score go to the earlier document."""
    whole = [(k, s, window) for k, n in enumerate(lengths) for s in range(0, int(n) - window + 1, window)]
    begin = [int(n) // window * window for n in lengths]
    rest = pack_fragments([t[b:] for t, b in zip(tokens, begin)], window)
    return [[p] for p in whole] + [[(k, begin[k] + s, n) for k, s, n in pieces] for pieces in rest]


def pack_fragments(fragments: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (fragment, start, length) of fragments shorter than a window, as for pack_shard."""
    sequences: list[list[tuple[int, int, int]]] = []
    start, left = [0] * len(fragments), [len(f) for f in fragments]
    places = [k for k, n in enumerate(left) if n]
    index = Index([fragments[k] for k in places])
    unused = np.array([left[k] for k in places], np.int64)
    rank = -np.arange(len(places)) * 1e-12
    waiting = int(unused.sum())
    open_sequence: list[tuple[int, int, int]] = []
    for seed in range(len(places)):
        while unused[seed] and waiting >= window:
            scores = index.scores(seed) + rank
            scores[unused == 0] = -np.inf
            scores[seed] = np.inf
            room, pieces = window, []
            best = np.argpartition(-scores, min(64, len(places) - 1))[: 64 + 1] if len(places) > 65 else np.arange(len(places))
            queue = best[np.argsort(-scores[best], kind="stable")]
            if unused[queue].sum() < window:  # short fragments: look at all of them
                queue = np.argsort(-scores, kind="stable")
            for k in queue:
                take = int(min(room, unused[k]))
                if take:
                    p = places[k]
                    pieces.append((p, start[p], take))
                    start[p] += take
                    unused[k] -= take
                    room -= take
                    if not room:
                        break
            waiting -= window - room
            sequences.append(pieces)
    for k in range(len(places)):
        if unused[k]:
            open_sequence.append((places[k], start[places[k]], int(unused[k])))
    while open_sequence:  # under a window is left: the largest power of two first
        total = sum(p[2] for p in open_sequence)
        room, pieces, rest = 1 << (total.bit_length() - 1), [], []
        for p, s, n in open_sequence:
            take = min(room, n)
            if take:
                pieces.append((p, s, take))
            if n > take:
                rest.append((p, s + take, n - take))
            room -= take
        sequences.append(pieces)
        open_sequence = rest
    return sequences


def pack_documents(
    df: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    window: int = WINDOW,
    shard_docs: int = SHARD_DOCS,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the packed ids.

    A document is its text's ids and `end_id`; a null or empty text is `end_id` alone. Repeated rows are packed again. Sequence ids hold the
    partition's and the sequence's number; they and the pieces are the same again for the same partitioning of the input. Texts are read whole; what is held of
    a long one is what its last window leaves. Other columns are ignored; an empty table gives no rows. The window has to be a power of two, so that no sequence
    needs padding.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window has to be a power of two")
    path = path or word_vocabulary()
    ids = df.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def pack(batches):
        from pyspark import TaskContext

        words, number = memo(path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        end = np.array([end_id], "<u4").tobytes()

        def rows(sequences: list[list[tuple[int, int, int]]], pieces_of) -> pa.RecordBatch:
            """pieces_of: (doc_id, start, ids, length of the document) of a piece."""
            nonlocal number
            columns: list[list] = [[] for _ in names]
            for pieces in sequences:
                offset = 0
                for piece in pieces:
                    doc_id, begin, own, total = pieces_of(piece)
                    for column, value in zip(columns, (doc_id, begin, piece[2], zlib.crc32(own), total, number, offset, own)):
                        column.append(value)
                    offset += piece[2]
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:7]] + [pa.array(c, pa.binary()) for c in columns[7:]], names)

        held: list[tuple] = []  # doc_id, start, ids of the fragment, length of the document

        def shard() -> pa.RecordBatch:
            def piece_of(piece):
                k, s, n = piece
                doc_id, begin, ids, total = held[k]
                return doc_id, begin + s, ids[4 * s : 4 * (s + n)], total

            out = rows(pack_fragments([np.frombuffer(h[2], "<u4") for h in held], window), piece_of)
            held.clear()
            return out

        kind = None
        for batch in in_slices(batches, 200):
            kind = batch.schema.field(0).type
            doc_ids, packed = batch.column(0).to_pylist(), [p + end for p in encode_words(words, as_bytes(batch.column(1)))]
            whole = []
            for k, ids in enumerate(packed):
                total = len(ids) // 4
                begin = total // window * window
                whole += [[(k, s, window)] for s in range(0, begin, window)]
                held.append((doc_ids[k], begin, ids[4 * begin :], total))
            yield rows(whole, lambda p: (doc_ids[p[0]], p[1], packed[p[0]][4 * p[1] : 4 * (p[1] + p[2])], len(packed[p[0]]) // 4))
            if len(held) >= shard_docs:
                yield shard()
        if held:
            yield shard()

    from pyspark.sql import functions as F

    return map_batches(
        df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")),
        pack,
        f"doc_id {ids}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids,
    )
