"""Streams with state for each key: conversations that are due to be compacted, and evidence of a graph's nodes. Timers of event time clear the state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

DAY = 86_400


def compactions(turns: DataFrame, late: str = "1 hour", idle: int = DAY, least: int = 8, chars: int = 12_000, most: int = 10) -> DataFrame:
    """conv_id, n_turns, n_chars of a stream of turns (conv_id, turn, text, ts): sessions.to_compact, each conversation at most once for each number of turns.

    A micro-batch that makes a conversation due gives it once, with all turns so far; write it in append mode. A turn that comes again (its number decides) counts once; a null
    turn number counts always. Rows older than the watermark, `late` behind the latest, are dropped. A conversation without turns for `idle` seconds of event time is
    forgotten: a later turn begins it anew. What is kept of a conversation is its turns' numbers and two sums.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def update(key, frames, state):
        import numpy as np

        if state.hasTimedOut:
            state.remove()
            return
        seen, others, n_chars, fired, last = state.get if state.exists else (b"", 0, 0, 0, 0)
        numbers, closed = set(np.frombuffer(seen, np.int64).tolist()), state.getCurrentWatermarkMs() / 1000
        for frame in frames:
            for turn, size, second in zip(frame["turn"].tolist(), frame["size"].tolist(), frame["second"].tolist()):
                if second < closed:  # Spark itself drops late rows by the watermark of the batch before
                    continue
                last = max(last, int(second))
                if turn != turn or turn is None:
                    others += 1
                elif int(turn) in numbers:
                    continue
                else:
                    numbers.add(int(turn))
                n_chars += int(size)
        n = len(numbers) + others
        if not n:
            return
        due = n >= least and (n_chars >= chars or n >= most) and n > fired
        state.update((np.array(sorted(numbers), np.int64).tobytes(), others, n_chars, n if due else fired, last))
        state.setTimeoutTimestamp(max((last + idle) * 1000, state.getCurrentWatermarkMs() + 1))
        if due:
            yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [n], "n_chars": [n_chars]})

    marked = turns.select("conv_id", F.col("turn").cast("double").alias("turn"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.col("ts").cast("timestamp").alias("ts"))
    timed = marked.where("ts is not null").withWatermark("ts", late).withColumn("second", F.unix_timestamp("ts"))
    return timed.groupBy("conv_id").applyInPandasWithState(
        update, f"conv_id {kind}, n_turns long, n_chars long", "seen binary, others long, n_chars long, fired long, last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def node_evidence(events: DataFrame) -> DataFrame:
    """id, evidence: each piece of evidence of a graph's node once, of a batch or a stream of `events` (event_id, question, doc, concepts, evidence, ts): the question, its document and
    its concepts (an array) stand on all chunks that the event cites (an array).

    The key is the pair, so a node that all events name is no single state. For a stream, put a watermark on ts first: pairs are forgotten once it has passed them.
    """
    node = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    nodes = F.concat(F.array(node("question_", F.col("event_id")), node("doc_", F.col("doc"))), F.transform(F.coalesce("concepts", F.array().cast("array<string>")), lambda c: node("knowledge_", c)))
    pairs = events.select("ts", F.explode(nodes).alias("id"), "evidence").select("ts", "id", F.explode("evidence").alias("evidence")).where("id is not null and evidence is not null")
    once = pairs.dropDuplicatesWithinWatermark(["id", "evidence"]) if events.isStreaming else pairs.dropDuplicates(["id", "evidence"])
    return once.select("id", "evidence")
