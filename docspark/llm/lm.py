"""LM scoring: a causal self-attention model over subword ids and add-one word counts, learnt from the training rows.

Word counts cover all training rows. Words of at least HOT_SHARE of all tokens, at most 1 / HOT_SHARE of them by arithmetic, are broadcast with
their counts; counts of other words are joined to their occurrences after the model has scored them, so that all words count alike. Subword counts
come from the counted words. Everything the model keeps comes from all training rows: classes of ids from the company they keep there, parameters from training on all windows of
all texts, where tasks train copies that are averaged, and the weights of the mixture from all targets. Training only begins with a bounded sample of windows, on the driver.

A text's probability is that of its words, each the mean of two: the product over its pieces by the attention model (mixed with counts of pairs of
pieces), and the word's add-one share in the training rows.
"""

from __future__ import annotations

import math
import uuid
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import attention
from docspark.llm.common import as_bytes, checkpointed, in_slices, map_batches, remainder
from docspark.llm.subwords import MEMO_WORDS, distinct_words, encode_words, memo, tokenizer, word_bytes, word_vocabulary, words_of

#: Words this frequent are broadcast with their counts: 500,000 at most, whatever the corpus.
HOT_SHARE = 2e-6
#: The model of pairs holds pairs of pieces this frequent among all pieces, a million at most; other pairs are backed off to their pieces.
PAIR_SHARE = 1e-6
#: Texts, and windows of each, that the attention model begins with on the driver, about.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 2000, 10
#: Texts of a training task, unless it is one partition, and such tasks at most; rate of that training; windows trained on at a time.
TASK_TEXTS, TASKS, TRAIN_RATE, TASK_WINDOWS = 1024, 1024, 2e-3, 20_000
#: Parameters travel in pieces of so many numbers.
PIECE = 1 << 14
#: Distinct words a task holds, once it has folded them, before it passes them on.
FLUSH = 300_000
BEGIN_ID, END_ID = 49406, 49407
LN10 = math.log(10)


def count_words(df: DataFrame) -> DataFrame:
    """(word, c) over the column `text`; the empty word stands for ends of texts. Tasks pass on counts, not words."""

    def table(words, c):
        return pa.table({"word": words, "c": c})

    def count(batches):
        held, rows, ends = [], 0, 0

        def folded():
            whole = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            return table(whole["word"], whole["c_sum"])

        for batch in in_slices(batches, 256):
            found = words_of(batch.column(0)).flatten().value_counts()
            ends += batch.num_rows
            held.append(table(found.field("values"), found.field("counts")).filter(pc.field("word") != ""))
            rows += len(found)
            if rows > 2 * FLUSH:
                held = [folded()]
                rows = held[0].num_rows
                if rows > FLUSH:
                    yield from held.pop().to_batches()
                    rows = 0
        if ends:
            held.append(table(pa.array([""]), pa.array([ends], pa.int64())))
            yield from folded().to_batches()
            held.clear()
            pa.default_memory_pool().release_unused()  # the worker scores next

    return map_batches(df.select("text"), count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def count_pieces(words: DataFrame, path: str, ends: np.ndarray) -> DataFrame:
    """(before, piece, c) over the pieces of counted words; before: the piece before in the word, len(ends) after a piece that ends one."""

    def count(batches):
        known, start = memo(path), len(ends)
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in in_slices(batches, 5000):
            texts = as_bytes(batch.column(0))
            known.learn(set(texts) - {b""})
            packed = [known[t] if t else b"" for t in texts]
            size = np.array([len(p) // 4 for p in packed])
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
            if not len(ids):
                continue
            before = np.concatenate([[0], ids[:-1]])
            before = np.where(ends[before], start, before)
            before[(np.cumsum(size) - size)[size > 0]] = start
            c = np.repeat(np.array(batch.column(1).to_pylist(), np.int64), size)
            keys, at = np.unique(np.concatenate([keys, before << 32 | ids]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, c]).astype(np.float64)).astype(np.int64)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(counts)], ["before", "piece", "c"])

    return map_batches(words.select("word", "c"), count, "before bigint, piece bigint, c bigint").groupBy("before", "piece").agg(F.sum("c").alias("c"))


def sample_windows(df: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows of about SAMPLE_TEXTS of the rows, at most SAMPLE_WINDOWS of each, chosen by hash from the whole text."""
    share = min(1.0, SAMPLE_TEXTS / max(1, df.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit("windows")), F.lit(1 << 40))
    width = attention.T + attention.SCORED

    def cut(batches):
        known = memo(path)
        for batch in in_slices(batches, 100):
            out = []
            for ids, seed in zip(encode_words(known, [t.lower() for t in as_bytes(batch.column(0))]), batch.column(1).to_pylist()):
                both = np.concatenate(attention.windows_of(np.frombuffer(ids, "<u4").astype(np.int32), BEGIN_ID, END_ID), 1).astype("<i4")
                out.append(both[np.sort(np.random.default_rng(seed).permutation(len(both))[:SAMPLE_WINDOWS])].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["place", "windows"])

    rows = map_batches(df.withColumn("place", place).where(F.col("place") < int(share * (1 << 40))).select("text", "place"), cut, "place bigint, windows binary").collect()
    rows.sort(key=lambda r: (r.place, bytes(r.windows)))
    got = np.frombuffer(b"".join(bytes(r.windows) for r in rows), "<i4").reshape(-1, width)
    return got[:, : attention.T], got[:, attention.T :]


def few_tasks(texts: DataFrame, n: int) -> DataFrame:
    """The `n` texts in at most one task for TASK_TEXTS of them, TASKS at most: each task gives a table of its own. Texts stay where they are read."""
    return texts.coalesce(max(1, min(TASKS, -(-n // TASK_TEXTS))))


def company(texts: DataFrame, path: str, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (attention.company_vectors) of all pieces of `texts` (text). What tasks pass on, and the driver gets, is bounded by the vocabulary."""
    places = attention.places_of(counts)
    wide = int(places.max()) + 1

    def count(batches):
        known, held = memo(path), np.zeros(3 * wide * len(places), np.int32)
        for batch in in_slices(batches, 100):
            streams = [np.concatenate([[BEGIN_ID], np.frombuffer(i, "<u4").astype(np.int64), [END_ID]]) for i in encode_words(known, [t.lower() for t in as_bytes(batch.column(0))])]
            np.add.at(held, attention.company_keys(streams, places, wide), np.int32(1))  # of the same kind: many times faster
        key = np.flatnonzero(held)
        for at in range(0, len(key), FLUSH):
            own = key[at : at + FLUSH]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(held[own].astype(np.int64))], ["key", "c"])

    found = map_batches(few_tasks(texts.select("text"), texts.count()), count, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c")).toArrow()
    return attention.company_vectors(found["key"].to_numpy(), found["c"].to_numpy(), wide)


def trained(model: attention.Attention, texts: DataFrame, path: str) -> np.ndarray:
    """Trains `model` on all windows of `texts` (text): each task a copy on its texts, then the mean of the copies, weighted by their windows.

    Only parameters travel, in pieces; the driver gets one set of them. Returns attention.compared() of all windows, each by a copy that hasn't been trained on it yet.
    """
    spark, n = texts.sparkSession, texts.count()
    if not n:
        return np.zeros((2, attention.SHARES))
    names = list(model.p)
    sizes = np.cumsum([0] + [model.p[k].size for k in names])
    shared = spark.sparkContext.broadcast(model)

    def train(batches):
        import copy

        from pyspark import TaskContext

        own, known, windows, compared = None, memo(path), 0, np.zeros((2, attention.SHARES))
        rng = np.random.default_rng(TaskContext.get().partitionId() if TaskContext.get() else 0)
        held: list[np.ndarray] = []

        def learn():
            nonlocal own, windows, compared
            own = own or copy.deepcopy(shared.value)
            both = np.concatenate(held)
            held.clear()
            own.prepare()
            compared = compared + own.compared(both[:, : attention.T], both[:, attention.T :])
            own.train(both[:, : attention.T], both[:, attention.T :], rng, 1, TRAIN_RATE)
            windows += len(both)

        for batch in in_slices(batches, 50):
            for ids in encode_words(known, [t.lower() for t in as_bytes(batch.column(0))]):
                held.append(np.concatenate(attention.windows_of(np.frombuffer(ids, "<u4").astype(np.int32), BEGIN_ID, END_ID), 1))
            if sum(map(len, held)) > TASK_WINDOWS:
                learn()
        if held:
            learn()
        if own:
            flat = np.concatenate([own.p[k].reshape(-1) for k in names]).astype(np.float32)
            pieces = [compared.tobytes(), *(flat[k : k + PIECE].tobytes() for k in range(0, len(flat), PIECE))]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(pieces) - 1), pa.int32()), pa.array([windows] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["piece", "windows", "values"])

    def mean(table: pa.Table) -> pa.Table:
        if table.column("piece")[0].as_py() < 0:  # counts add up
            total = sum(np.frombuffer(v, np.float64) for v in table.column("values").to_pylist())
            return pa.table({"piece": table.column("piece")[:1], "values": pa.array([total.tobytes()], pa.binary())})
        total, weight = 0.0, 0
        for n, values in zip(table.column("windows").to_pylist(), table.column("values").to_pylist()):
            total, weight = total + n * np.frombuffer(values, np.float32).astype(np.float64), weight + n
        return pa.table({"piece": table.column("piece")[:1], "values": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})

    copies = map_batches(few_tasks(texts.select("text"), n), train, "piece int, windows bigint, values binary")
    got = copies.groupBy("piece").applyInArrow(mean, "piece int, values binary").toArrow()  # TASKS pieces at most meet in a group
    pieces = [v for _, v in sorted(zip(got["piece"].to_pylist(), got["values"].to_pylist()))]
    flat = np.frombuffer(b"".join(pieces[1:]), np.float32)
    for k, a, b in zip(names, sizes, sizes[1:]):
        model.p[k] = flat[a:b].reshape(model.p[k].shape).copy()
    model.prepare()
    return np.frombuffer(pieces[0], np.float64).reshape(2, attention.SHARES)


class Lexicon:
    """What a worker knows of words, by number: the logarithm of the training share (nan for words that aren't broadcast), ids, and for each id
    the weight of attention there and the rest of its probability, by pairs: both depend on the word alone."""

    def __init__(self, path: str, model: attention.Attention, frequent: dict[bytes, float], most: int = MEMO_WORDS):
        self.memo, self.model, self.frequent, self.most = memo(path), model, frequent, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.begin, self.size, self.value, self.ids, self.weight, self.rest = array("q"), array("q"), array("d"), array("I"), array("f"), array("f")

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """words: distinct."""
        got = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(got < 0)
        if len(self.number) + len(missing) > self.most:
            self.clear()
            missing = np.arange(len(words))
        fresh = [words[k] for k in missing.tolist()]
        got[missing] = np.arange(len(self.size), len(self.size) + len(fresh))
        if fresh:
            packed = self.memo.packed(fresh)
            size = np.array([len(p) // 4 for p in packed])
            self.number.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh))))
            self.begin.extend((len(self.ids) + np.cumsum(size) - size).tolist())
            self.size.extend(size.tolist())
            self.value.extend([self.frequent.get(w, math.nan) for w in fresh])
            raw = b"".join(packed)
            self.ids.frombytes(raw)
            weight, rest = self.model_parts(np.frombuffer(raw, "<u4").astype(np.int64), size)
            self.weight.frombytes(weight.tobytes())
            self.rest.frombytes(rest.tobytes())
        return got

    def model_parts(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words' pieces: a piece that begins a word follows one that ends a word."""
        pairs = self.model.pairs
        if not len(ids):
            return np.empty(0, np.float32), np.empty(0, np.float32)
        before = np.concatenate([[pairs.start], ids[:-1]])
        before[(np.cumsum(size) - size)[size > 0]] = pairs.start
        inner = (before != pairs.start) & ~pairs.ends[np.minimum(before, pairs.start - 1)]
        weight = self.model.mix[inner.astype(int)]
        return weight.astype(np.float32), ((1 - weight) * pairs.probability(before, ids)).astype(np.float32)


@lru_cache(maxsize=1)
def lexicon(path: str, shared) -> Lexicon:
    model, words, values = shared.value
    return Lexicon(path, model, dict(zip(words, values.tolist())))


def batch_windows(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """attention.windows_of of many texts at once: `ids` of all, `size` of each."""
    n, texts = size + 1, len(size)
    count = -(-n // attention.SCORED)
    # each text's stream with CONTEXT empty places before it, filled up to whole windows
    wide = count * attention.SCORED
    begin = np.cumsum(wide) - wide
    before = begin + attention.CONTEXT * np.arange(1, texts + 1)
    stream, targets = np.full(int(wide.sum()) + attention.CONTEXT * texts, -1, np.int32), np.full(int(wide.sum()), -1, np.int32)
    owner = np.repeat(np.arange(texts), size)
    place = np.arange(len(ids)) - (np.cumsum(size) - size)[owner]
    stream[before] = BEGIN_ID
    stream[before[owner] + place + 1] = ids
    targets[begin[owner] + place] = ids
    targets[begin + size] = END_ID
    text = np.repeat(np.arange(texts), count)
    first = np.arange(len(text)) * attention.SCORED + attention.CONTEXT * text
    # the end of a full last window isn't an input
    return stream[first[:, None] + np.arange(attention.T)], targets.reshape(-1, attention.SCORED)


class Shared:
    """A broadcast that hashes by its number, which no other has, so that a worker builds its dictionary once for each model."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.number = broadcast, number

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self):
        return self.number

    def __eq__(self, other):
        return self.number == other.number


def score_texts(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each input row.

    Rows whose crc32(id as text) mod 7 is 2 are held out, all others (with a null id too) train. A null or empty text is an end alone. Repeated
    rows train and are scored again. Other columns are ignored; an empty table gives no rows; without any training row all counts are 0.
    """
    path = path or word_vocabulary()
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), (remainder(df[id_col], 7) == 2).alias("held_out"))
    train = source.where("not held_out")
    counts = checkpointed(count_words(train))
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("c").alias("v"), F.coalesce(F.max(F.when(F.col("word") == "", F.col("c"))), F.lit(0)).alias("texts")).first()
    total, floor = whole.n, whole.n + whole.v + 1
    hot = counts.where((F.col("c") >= F.lit(HOT_SHARE * total)) & (F.col("word") != "")).select(F.col("word").cast("binary").alias("word"), "c").toArrow()

    names = tokenizer(path).get_vocab()
    ends = np.zeros(max(names.values()) + 1, bool)
    for name, number in names.items():
        ends[number] = name.endswith("</w>") or number >= BEGIN_ID
    pieces = checkpointed(count_pieces(counts, path, ends))
    ids = np.zeros(len(ends))
    by_id = pieces.groupBy("piece").agg(F.sum("c").alias("c")).toArrow()  # as many rows as the vocabulary has
    ids[by_id["piece"].to_numpy()] = by_id["c"].to_numpy()
    ids[END_ID] += whole.texts
    kept = pieces.where(F.col("c") >= F.lit(PAIR_SHARE * max(1.0, ids.sum()))).toArrow()
    key = kept["before"].to_numpy() << 32 | kept["piece"].to_numpy()
    order = np.argsort(key)
    pairs = attention.Pairs(key[order], kept["c"].to_numpy()[order].astype(float), ids, ends)
    begun = sample_windows(train, path)
    model = attention.Attention(ids, pairs, *begun, company=company(train, path, ids))
    model.fit_mix(trained(model, train, path))
    log = lambda c: math.log10((c + 1) / floor)
    made = spark.sparkContext.broadcast((model, hot["word"].to_pylist(), np.log10((hot["c"].to_numpy() + 1) / floor)))
    shared, end_value, end_known = Shared(made, uuid.uuid4().int >> 66), log(whole.texts), int(whole.texts > 0)

    def score(batches):
        from pyspark import TaskContext

        known, own = lexicon(path, shared), shared.value[0]
        end_weight = float(own.mix[0])
        end_rest = (1 - end_weight) * float(own.pairs.probability(np.array([own.pairs.start]), np.array([END_ID]))[0])
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in in_slices(batches, 128):
            length, names, which = distinct_words(batch.column(1))
            n = len(length)
            numbers = known.numbers(word_bytes(names))[which]
            owner = np.repeat(np.arange(n), length)
            size, value, begin = (np.frombuffer(c, kind)[numbers] if len(numbers) else np.empty(0, kind) for c, kind in ((known.size, np.int64), (known.value, np.float64), (known.begin, np.int64)))
            upto = np.cumsum(size)
            at = np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
            take = lambda c, kind: np.frombuffer(c, kind)[at] if len(at) else np.empty(0, kind)
            pieces = np.bincount(owner, size, n).astype(np.int64)
            # a text's end stands, as a piece, after each text
            ends_at = np.cumsum(pieces + 1) - 1
            inside = np.arange(len(at)) + np.repeat(np.arange(n), pieces)
            weight, rest = np.full(len(at) + n, end_weight, np.float32), np.full(len(at) + n, end_rest, np.float32)
            weight[inside], rest[inside] = take(known.weight, np.float32), take(known.rest, np.float32)
            by_piece = own.attend(*batch_windows(take(known.ids, "<u4").astype(np.int32), pieces)) * weight + rest
            by_piece = np.concatenate([[0.0], np.cumsum(np.log10(np.maximum(by_piece, 1e-38)), dtype=np.float64)])
            to = upto + owner
            by_word, by_end = by_piece[to] - by_piece[to - size], np.diff(by_piece)[ends_at]
            mean = lambda a, b: np.logaddexp(a * LN10, b * LN10) / LN10 - math.log10(2)
            missing = np.isnan(value)
            met = ~missing
            scores = np.bincount(owner[met], mean(by_word[met], value[met]), n) + mean(by_end, np.full(n, end_value))
            base = np.bincount(owner[met], value[met], n) + end_value
            rows, m = np.arange(row, row + n), int(missing.sum())
            row += n
            own_row = pa.StructArray.from_arrays(
                [batch.column(0), batch.column(2), pa.array(length + 1), pa.array(np.bincount(owner[met], minlength=n) + end_known), pa.array(base), pa.array(scores)], ["doc_id", "held_out", "n_tokens", "known", "base", "score"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rows, rows[owner[missing]]])),
                    pa.concat_arrays([own_row, pa.nulls(m, own_row.type)]),
                    # a text's own row goes by a word that no text has, so that it is dealt out like others
                    pa.concat_arrays([pa.array([f" {r}" for r in rows.tolist()], pa.string()), names.take(pa.array(which[missing]))]),
                    pa.array(np.concatenate([np.zeros(n), by_word[missing]])),
                ],
                ["row", "own", "word", "by_word"],
            )

    scored = map_batches(source, score, f"row bigint, own struct<doc_id:{kind},held_out:boolean,n_tokens:bigint,known:bigint,base:double,score:double>, word string, by_word double")
    # a partition's words are a hash table, so that their many occurrences needn't be sorted; frequent words aren't among them
    joined = scored.join(counts.hint("shuffle_hash"), "word", "left")
    share = (F.coalesce("c", F.lit(0)) + 1) / F.lit(float(floor))
    rare = F.col("own").isNull()
    return (
        joined.groupBy("row")
        .agg(
            *[F.max(f"own.{c}").alias(f"own_{c}") for c in ("doc_id", "held_out", "n_tokens", "known", "base", "score")],
            F.count_if(rare & F.col("c").isNotNull()).alias("known"),
            F.sum(F.when(rare, F.log10(share)).otherwise(0.0)).alias("base"),
            F.sum(F.when(rare, F.log10((F.pow(F.lit(10.0), "by_word") + share) / 2)).otherwise(0.0)).alias("score"),
        )
        .select(
            F.col("own_doc_id").alias("doc_id"), F.col("own_held_out").alias("held_out"), F.col("own_n_tokens").alias("n_tokens"), (F.col("own_known") + F.col("known")).alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("own_base") + F.col("base")).alias("base_score"), (F.col("own_score") + F.col("score")).alias("score"),
        )
    )
