"""Streams in several micro-batches against the batch: late rows, repeated rows, timers, a restart."""

import datetime
import random

from pyspark.sql import functions as F

from docspark.operators import sessions
from docspark.streaming import events as E
from docspark.streaming import stateful as S

START = datetime.datetime(2024, 1, 1)
TURN = "conv_id long, turn long, text string, ts timestamp"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def put(spark, folder, rows, schema, number):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{number}")


def run(spark, tmp_path, stream, out, mode="append"):
    job = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state-{out}").option("path", f"{tmp_path}/{out}").outputMode(mode).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/{out}")


def source(spark, tmp_path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_compactions_fire_once_and_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    turns = [(c, t, "x" * rng.choice([10, 900, 2500]), at(c + 60 * t)) for c in range(25) for t in range(rng.randrange(1, 16))]
    rng.shuffle(turns)
    thirds = [turns[k::3] for k in range(3)]
    for k in range(2):
        put(spark, tmp_path, thirds[k] + thirds[k][:5], TURN, k)  # some rows come twice
    first = run(spark, tmp_path, S.compactions(source(spark, tmp_path, TURN)), "out").collect()
    put(spark, tmp_path, thirds[2] + thirds[0][:7], TURN, 2)  # after a restart, with rows seen before it
    every = run(spark, tmp_path, S.compactions(source(spark, tmp_path, TURN)), "out").collect()
    assert set(first) <= set(every) and len({(r.conv_id, r.n_turns) for r in every}) == len(every)
    last = {}
    for r in every:
        last[r.conv_id] = max(last.get(r.conv_id, (0, 0)), (r.n_turns, r.n_chars))
    batch = {r.conv_id: (r.n_turns, r.n_chars) for r in sessions.to_compact(spark.createDataFrame(turns, TURN)).collect()}
    assert last == batch and len(every) > len(batch)


def test_late_turns_and_timers(spark, tmp_path):
    own = lambda turns, second: [(1, t, "x", at(second + t)) for t in turns]
    put(spark, tmp_path, own(range(9), 0), TURN, 0)  # nine turns: not due
    put(spark, tmp_path, [(2, 0, "x", at(7200)), (3, 0, "x", None)], TURN, 1)  # the watermark passes an hour
    put(spark, tmp_path, own([9], 100), TURN, 2)  # the tenth turn is late: dropped
    put(spark, tmp_path, own([10], 7000), TURN, 3)  # this one isn't: ten turns
    put(spark, tmp_path, [(2, 1, "x", at(4 * S.DAY))], TURN, 4)  # a long pause clears conversation 1
    put(spark, tmp_path, [(2, 2, "x", at(4 * S.DAY + 1))], TURN, 5)
    put(spark, tmp_path, own(range(11, 20), 4 * S.DAY), TURN, 6)  # nine turns again, not nineteen
    got = run(spark, tmp_path, S.compactions(source(spark, tmp_path, TURN)), "out").collect()
    assert [(r.conv_id, r.n_turns, r.n_chars) for r in got] == [(1, 10, 10)]


EVENT = "event_id long, question string, doc string, concepts array<string>, evidence array<string>, ts timestamp"


def test_evidence_of_nodes_equals_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, f"q{k}", f"d{k % 3}", rng.choice([None, [], ["a"], ["a", "b", None]]), rng.choice([None, ["c1", "c2"], ["c2", None, "c2"], [f"c{k}"]]), at(k)) for k in range(60)]
    for k in range(3):
        put(spark, tmp_path, rows[k::3] + rows[:4], EVENT, k)
    stream = S.node_evidence(source(spark, tmp_path, EVENT).withWatermark("ts", "1 hour"))
    got = [tuple(r) for r in run(spark, tmp_path, stream, "out").collect()]
    batch = {tuple(r) for r in S.node_evidence(spark.createDataFrame(rows, EVENT)).collect()}
    assert len(got) == len(set(got)) and set(got) == batch and ("knowledge_a", "c2") in batch


def test_complete_units(spark, tmp_path):
    schema = "unit_id long, n_parts long, ts timestamp"
    for k, ids in enumerate([[1, 1, 2], [2, 3], [1, 3]]):
        put(spark, tmp_path, [(u, 3 if u == 1 else 2, at(k)) for u in ids], schema, k)
    job = E.complete_units(source(spark, tmp_path, schema)).writeStream.format("memory").queryName("units").outputMode("update").trigger(availableNow=True).start()
    job.awaitTermination()
    assert {tuple(r) for r in spark.table("units").collect()} == {(1, 3), (2, 2), (3, 2)}


def test_windows(spark, tmp_path):
    schema = "event_type string, value double, ts timestamp"
    put(spark, tmp_path, [("a", 1.0, at(0)), ("a", 2.0, at(10)), ("b", 1.0, at(90_000))], schema, 0)
    put(spark, tmp_path, [("b", 0.0, at(90_001))], schema, 1)
    put(spark, tmp_path, [("a", 5.0, at(20))], schema, 2)  # its day is closed
    put(spark, tmp_path, [("b", 1.0, at(900_000))], schema, 3)
    got = run(spark, tmp_path, E.windowed_counts(source(spark, tmp_path, schema)), "out").select("event_type", "n", "total", F.to_date("start").cast("string").alias("d")).collect()
    assert {tuple(r) for r in got} == {("a", 2, 3.0, "2024-01-01"), ("b", 2, 1.0, "2024-01-02")}
