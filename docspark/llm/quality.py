"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Each n-gram indicator is scaled by the log ratio of its smoothed counts in the two classes; a linear model with hinge loss is fitted to the
scaled, length-normalised vectors by dual coordinate descent; a logistic curve fitted to margins of rows kept from that fit turns margins
into probabilities. n-grams are taken over words, over word shapes (case, digits, punctuation; runs shortened) and over repeats.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import as_bytes, map_batches, release_memory, remainder

#: Most labelled rows that the model is fitted to, a sample by hash of the id. They reach the driver as hashed features.
TRAIN_ROWS = 6000
#: Features are hashed to this many bits.
BITS = 18
#: Words a worker remembers with their hashes.
MEMO_WORDS = 400_000
EPOCHS, COST, SMOOTHING = 20, 1.0, 1.0

SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
RUN = re.compile(rb"(.)\1+", re.S)


class Hashes(dict):
    """Word -> hash of its shape in the high, of itself in the low 32 bits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        got = self[word] = zlib.crc32(RUN.sub(rb"\1", word.translate(SHAPE))) << 32 | zlib.crc32(word.lower())
        return got


@lru_cache(maxsize=1)
def hashes() -> Hashes:
    return Hashes()


def forget() -> None:
    """Empties the worker's memo at a task's end."""
    hashes().clear()
    release_memory()


def mixed(x: np.ndarray, kind: int) -> np.ndarray:
    """Hashed to BITS bits; kinds of n-grams differ."""
    x = (x + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: bytes, known: Hashes, stamp: np.ndarray) -> np.ndarray:
    """The text's distinct features. `stamp`: 2**BITS numbers of scratch space."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int32)
    both = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    shape, word = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    m = np.uint64(0x100000001B3)
    parts = [mixed(shape, 1), mixed(word, 2)]
    if n > 1:
        pairs = shape[:-1] * m + shape[1:]
        parts += [mixed(pairs, 3), mixed(word[:-1] * m + word[1:], 4)]
        if n > 2:
            parts.append(mixed(pairs[:-1] * m + shape[2:], 5))
        for gap in (1, 2, 3):  # words that repeat those `gap` before, over 1, 2, 4 and 8 words
            same = word[gap:] == word[:-gap]
            for k in range(4):
                if len(same) and same.any():
                    parts.append(mixed(np.array([gap * 16 + k], np.uint64), 6))
                    same = same[1 << k :] & same[: -(1 << k)] if len(same) > 1 << k else same[:0]
                else:
                    break
    found = np.concatenate(parts)
    order = np.arange(len(found), dtype=np.int32)
    stamp[found] = order  # the last of equal features stays
    return found[stamp[found] == order]


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights (by feature, unscaled) and bias of the L2-regularised hinge loss over vectors ratio[row] / |ratio[row]|."""
    rng = np.random.default_rng(seed)
    vectors = [(r, ratio[r] / max(np.linalg.norm(ratio[r]), 1e-9)) for r in rows]
    squares = np.array([1.0 + float(v @ v) for _, v in vectors])
    weight, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = vectors[i]
            gradient = y[i] * (weight[r] @ v + bias) - 1
            now = min(max(alpha[i] - gradient / squares[i], 0.0), cost)
            if (step := (now - alpha[i]) * y[i]) != 0:
                alpha[i] = now
                weight[r] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability that y is 1, by Newton's method with targets drawn in from 0 and 1."""
    ones = int(y.sum())
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x, at = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


class Model:
    """weight: ratio times hinge-loss weight; square: ratio squared, for the norm. All by feature."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.constant = len(labels) < 40 or not 0 < self.prior < 1
        if self.constant:
            return
        y = np.where(labels > 0, 1.0, -1.0)
        fit = np.arange(len(y)) % 4 != 3
        size = 1 << BITS
        counts = [SMOOTHING + np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(fit & (y == s))] or [np.empty(0, int)]), minlength=size) for s in (1, -1)]
        ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
        ratio[(counts[0] + counts[1]) == 2 * SMOOTHING] = 0  # never met
        weight, self.bias = dual_coordinate_descent([rows[i] for i in np.flatnonzero(fit)], y[fit], ratio, COST, EPOCHS)
        self.weight, self.square = (weight * ratio).astype(np.float32), (ratio * ratio).astype(np.float32)
        kept = np.array([self.margin(rows[i]) for i in np.flatnonzero(~fit)])
        self.slope, self.offset = logistic(kept, (y[~fit] > 0).astype(float))

    def margin(self, found: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[found].sum(dtype=np.float64)))
        return float(self.weight[found].sum(dtype=np.float64)) / max(norm, 1e-9) + self.bias

    def score(self, found: np.ndarray) -> float:
        if self.constant:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def fit_quality(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of `labels`, from at most about `train_rows` labelled rows whose crc32(id as text) mod 4 is not 2.

    Several labels of one id count once, by their smallest; labels without a text, and null ids and labels, count for nothing. With under 40
    rows or a single class the model gives the share of label 1 (0.5 without rows) to every text.
    """
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("id is not null and label is not null")
    marked = marked.where(remainder(F.col("id"), 4) != 2).groupBy("id").agg(F.min("label").alias("label"))
    n = marked.count()
    share = min(1.0, train_rows / max(1, n))
    order = F.pmod(F.xxhash64("id", F.lit("quality sample")), F.lit(1 << 40))
    sample = marked.where(order < F.lit(int(share * (1 << 40))))  # about train_rows rows, whatever the table's size
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).join(F.broadcast(sample), "id")

    def prepare(batches):
        known, stamp = hashes(), np.zeros(1 << BITS, np.int32)
        for batch in batches:
            packed = [features(t, known, stamp).tobytes() for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1), batch.column(2)], ["found", "label", "place"])
        forget()

    got = map_batches(rows.select("text", F.col("label").cast("int").alias("label"), order.alias("place")), prepare, "found binary, label int, place bigint").collect()
    got.sort(key=lambda r: (r.place, bytes(r.found)))
    return Model([np.frombuffer(r.found, np.int32) for r in got], np.array([1 if r.label else 0 for r in got], float))


def score_quality(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns in `keep`: one row for each input row, in one pass without a shuffle.

    A null text is scored as an empty one, by the model's bias; a null id isn't held out; repeated rows are scored again. Texts are read whole, whatever their
    length; an empty table gives no rows. Other columns are ignored, those in `keep` come back in a struct, so that no name can clash.
    """
    extra = [df[c] for c in keep]
    # carried in one struct, so that no name can clash with the operator's own
    source = df.select(
        df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"), (remainder(df[id_col], 4) == 2).alias("held_out"), (F.struct(*extra) if extra else F.lit(True)).alias("kept")
    )
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        own, known, stamp = shared.value, hashes(), np.zeros(1 << BITS, np.int32)
        for batch in batches:
            scores = np.array([own.score(features(t, known, stamp)) for t in as_bytes(batch.column(1))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32()), batch.column(3)],
                ["doc_id", "held_out", "score", "predicted", "kept"],
            )
        forget()

    return map_batches(source, score, f"doc_id {kinds['doc_id']}, held_out boolean, score double, predicted int, kept {kinds['kept']}")
