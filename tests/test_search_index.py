"""The index that outlives queries: after any changes it finds what BM25 over the items as they are finds."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import retrieval as R
from docspark.operators import scoring as S
from docspark.operators import search_index as I

WORDS = "sea ship wind harbour stone river night lamp road garden winter song letter 海洋 港口 x1 42".split()


def texts(rng, ids):
    return {k: rng.choice([None, "", " ".join(rng.choices(WORDS, range(1, len(WORDS) + 1), k=rng.randrange(1, 30)))]) if rng.random() < 0.2 else " ".join(rng.choices(WORDS, k=rng.randrange(1, 30))) for k in ids}


def frame(spark, items):
    return spark.createDataFrame(list(items.items()), "item_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(k, " ".join(random.Random(k).choices(WORDS, k=4))) for k in range(12)] + [(99, "unknown words only"), (98, ""), (97, None), (96, "sea sea sea")]
    return spark.createDataFrame(rows, "query_id long, question string")


def found(df):
    return {(r.query_id, r.item_id): (round(r.score, 9), r.matched) for r in df.collect()}


def test_changes_equal_a_new_index(spark, asked, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "index")
    items = texts(rng, range(60))
    I.build(frame(spark, items).withColumn("extra", F.lit(1)), path, parts=4)

    def same():
        assert found(I.search(asked, path)) == found(R.bm25(frame(spark, items), asked))

    same()
    for turn in range(3):
        change = texts(rng, rng.sample(range(90), 15))  # some are new
        items |= change
        I.upsert(frame(spark, change), path)
        gone = rng.sample(range(90), 8)  # some aren't there
        I.delete(spark.createDataFrame([(k,) for k in [*gone, gone[0], None]], "item_id long"), path)
        items = {k: t for k, t in items.items() if k not in gone}
        same()
        if turn == 1:
            I.compact(spark, path)
            same()
    back = {gone[0]: "sea again", gone[1]: "the harbour again"}
    items |= back
    I.upsert(frame(spark, back), path)
    same()
    I.delete(spark.createDataFrame([(k,) for k in items], "item_id long"), path)
    assert found(I.search(asked, path)) == {}


def test_only_asked_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    I.build(frame(spark, texts(random.Random(2), range(40))), path, parts=8)
    one = spark.createDataFrame([(1, "harbour")], "query_id long, question string")
    plan = I.search(one, path)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "tf#" in line]
    assert scans
    for scan in scans:
        folders, pushed = scan.split("PartitionFilters:")[1].split("PushedFilters:")
        assert "part#" in folders and "generation#" in folders and "harbour" in pushed


def test_a_change_that_was_not_logged_counts_for_nothing(spark, asked, tmp_path, monkeypatch):
    path, items = str(tmp_path / "index"), texts(random.Random(3), range(20))
    I.build(frame(spark, items), path, parts=2)
    before = found(I.search(asked, path))
    with monkeypatch.context() as m:
        m.setattr(I, "logged", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            I.upsert(frame(spark, {1: "sea sea", 50: "sea"}), path)
    assert found(I.search(asked, path)) == before
    I.upsert(frame(spark, {2: "ship"}), path)  # takes the place of what was left
    assert found(I.search(asked, path)) == found(R.bm25(frame(spark, items | {2: "ship"}), asked))


def test_repeated_and_empty_items(spark, asked, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, "sea"), (1, "sea ship"), (1, None), (None, "sea")], "item_id long, text string")
    I.build(rows, path)
    assert found(I.search(asked, path)) == found(R.bm25(frame(spark, {1: "sea ship"}), asked))
    none = str(tmp_path / "none")
    I.build(rows.limit(0), none)
    assert found(I.search(asked, none)) == {}
    I.upsert(rows.limit(0), none)
    I.upsert(frame(spark, {5: "harbour"}), none)
    assert found(I.search(asked, none)) == found(R.bm25(frame(spark, {5: "harbour"}), asked))
    with pytest.raises(Exception):
        I.search(asked, str(tmp_path / "nowhere")).collect()


def test_the_best_are_those_of_all_pairs(spark, asked, tmp_path):
    """Also after changes: `top` makes no row for each pair."""
    path, items = str(tmp_path / "index"), texts(random.Random(5), range(120))
    I.build(frame(spark, items), path, parts=4)
    I.upsert(frame(spark, {k: "sea " + (items[k] or "") for k in range(0, 120, 3)}), path)
    I.delete(spark.createDataFrame([(k,) for k in range(0, 120, 7)], "item_id long"), path)
    for _ in range(2):
        every = R.top(I.search(asked, path).selectExpr("query_id", "item_id", "round(score, 9) as score"), 3)
        rows = lambda df: {(r.query_id, r["rank"]): (r.item_id, round(r.score, 6)) for r in df.collect()}
        assert rows(I.top(asked, path, 3)) == rows(every)
        assert {r.item_id for r in I.current(spark, path).where("dl is not null").collect()} == {k for k in range(120) if k % 7}
        I.compact(spark, path)


def test_texts_are_counted_where_they_are_read(spark):
    """Only ids that come twice move with their texts."""
    rows = spark.createDataFrame([(1, "sea sea ship"), (2, None), (3, "b"), (3, "aa bb")], "item_id long, text string")
    found = I.analysed(rows)
    got = {r.item_id: (r.dl, {t.term: t.tf for t in r.terms}) for r in found.collect()}
    assert got == {1: (3, {"sea": 2, "ship": 1}), 2: (0, {}), 3: (2, {"aa": 1, "bb": 1})}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_an_item_stays_in_one_task_after_a_join(spark):
    """A join by item that Spark turns into a broadcast join while it runs deals items anew."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        postings = spark.range(0, 4000, 1, 8).select((F.col("id") % 100).alias("item_id"), F.concat(F.lit("t"), F.floor(F.col("id") / 100)).alias("term"), F.lit(1).cast("long").alias("tf"), F.lit(40).cast("long").alias("dl"))
        latest = spark.range(0, 100, 1, 4).groupBy(F.col("id").alias("item_id")).agg(F.max("id").alias("latest"))
        packs = S.packed_postings(postings.join(latest, "item_id", "left").where("latest is null or latest >= 0"))
        ids = [i for r in packs.select("ids").collect() for i in r.ids]
    finally:
        for key in held:
            spark.conf.unset(key)
    assert sorted(ids) == list(range(100))
