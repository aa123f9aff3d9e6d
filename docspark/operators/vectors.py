"""Exact search of vectors by inner product or cosine, for a batch of queries.

Vectors are dealt to the nearest of some centres, so a cell has a centre c and a radius r, and for a query q no vector of the cell scores more than q c + |q| r. A query first looks
into the cells whose centres are most like it until these have k vectors; its k-th best score there rules out all cells with a lower bound. What is left are pairs of a query
and a cell, which are joined: queries and vectors meet in tasks of bounded size, as matrices. No plan grows with the number of queries, and nothing but centres is sent to all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.checkpoints import checkpointed

#: Centres, at most: they go to every task. Vectors and queries of one task.
CENTRES, TASK_VECTORS, TASK_QUERIES = 1024, 10_000, 2000
#: Scores are compared as rounded to so many digits; bounds give way by a little more than that.
DIGITS, SLACK = 6, 2e-6


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of length 0 stay."""
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


@dataclass
class Cells:
    """rows: (item_id, v, cell, part), parts of a cell having TASK_VECTORS vectors, about; centres, radius and size of each cell."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    cosine: bool


def deal(vectors: DataFrame, cosine: bool = False, centres: int | None = None) -> Cells:
    """`vectors` (item_id, v) dealt to centres, which are vectors themselves, chosen by hash: half the square root of their number, CENTRES at most. Null vectors are left out."""
    rows = vectors.select("item_id", F.col("v").cast("array<double>").alias("v")).where("v is not null")
    n = rows.count()
    most = min(CENTRES, max(1, int(n**0.5 / 2))) if centres is None else centres
    chosen = rows.orderBy(F.xxhash64("item_id", F.lit("centre")), "item_id").limit(most).select("v").collect()  # CENTRES rows at most
    points = np.array([r.v for r in chosen], np.float64).reshape(len(chosen), -1) if chosen else np.empty((0, 0))
    points = unit(points) if cosine else points
    kind = rows.schema["item_id"].dataType.simpleString()

    def place(batches):
        half = (points * points).sum(1) / 2
        for batch in batches:
            own = matrix(batch.column(1))
            own = unit(own) if cosine else own
            cell = (own @ points.T - half).argmax(1)  # the nearest
            far = np.sqrt(((own - points[cell]) ** 2).sum(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), pa.array(own.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(cell, pa.int32()), pa.array(far)], ["item_id", "v", "cell", "far"])

    placed = checkpointed(rows.mapInArrow(place, f"item_id {kind}, v array<double>, cell int, far double"))
    radius, size = np.zeros(len(points)), np.zeros(len(points), np.int64)
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # CENTRES rows at most
        radius[r.cell], size[r.cell] = r.far, r.n
    parts = F.create_map(*[x for c in np.flatnonzero(size > TASK_VECTORS) for x in (F.lit(int(c)), F.lit(int(-(-size[c] // TASK_VECTORS))))]) if (size > TASK_VECTORS).any() else None
    part = F.lit(0) if parts is None else F.pmod(F.xxhash64("item_id"), F.coalesce(parts[F.col("cell")], F.lit(1))).cast("int")
    return Cells(placed.select("item_id", "v", "cell", part.alias("part")), points, radius, size, cosine)


def compared(k: int):
    def compare(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        """query_id, item_id, score: each query's k best of the task's vectors, ties by item."""
        ids, names = queries.column("query_id").combine_chunks(), vectors.column("item_id").combine_chunks()
        score = np.round(matrix(queries.column("q")) @ matrix(vectors.column("v")).T, DIGITS) if len(ids) and len(names) else np.empty((len(ids), len(names)))
        if score.shape[1] > k:
            least = np.partition(score, score.shape[1] - k, 1)[:, -k]
            q, v = np.nonzero(score >= least[:, None])
        else:
            q, v = np.nonzero(np.ones(score.shape, bool))
        found = pa.table({"place": pa.array(q), "query_id": ids.take(pa.array(q)), "item_id": names.take(pa.array(v)), "score": pa.array(score[q, v], pa.float64())})
        found = found.sort_by([("place", "ascending"), ("score", "descending"), ("item_id", "ascending")])
        place = found.column("place").to_numpy()
        first = np.searchsorted(place, place)
        return found.filter(pa.array(np.arange(len(place)) - first < k)).select(["query_id", "item_id", "score"])

    return compare


def best(cells: Cells, pairs: DataFrame, k: int) -> DataFrame:
    """query_id, item_id, score, rank of `pairs` (query_id, q, cell): the k best vectors of each query's cells."""
    counts = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).cast("int").alias("blocks"))  # a row for each cell
    parts = cells.rows.groupBy("cell").agg((F.max("part") + 1).alias("parts"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = cells.rows.join(F.broadcast(counts), "cell").select("item_id", "v", "cell", "part", numbers("blocks").alias("block"))
    dealt = pairs.join(F.broadcast(counts), "cell").join(F.broadcast(parts), "cell")
    right = dealt.select("query_id", "q", "cell", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), numbers("parts").alias("part"))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((pairs, "query_id"), (cells.rows, "item_id"))}
    keys = ["cell", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compared(k), f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def cell_pairs(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, q, cell, first): with `least` null, the cells that a query of `queries` (query_id, q, least) looks into first; else all others whose bound isn't under `least`."""
    kind = queries.schema["query_id"].dataType.simpleString()
    points, radius, size, cosine = cells.centres, cells.radius, cells.size, cells.cosine

    def choose(batches):
        for batch in batches:
            q = matrix(batch.column(1))
            q = unit(q) if cosine else q
            least = batch.column(2).to_numpy(zero_copy_only=False)
            near = q @ points.T if len(points) else np.empty((len(q), 0))
            order = np.argsort(-near, 1, kind="stable")
            upto = np.cumsum(size[order], 1)
            first = np.zeros(near.shape, bool)
            np.put_along_axis(first, order, upto - size[order] < k, 1)
            bound = near + np.sqrt((q * q).sum(1))[:, None] * radius[None, :]
            chosen = np.where(np.isnan(least)[:, None], first, ~first & (bound >= least[:, None] - SLACK)) & (size > 0)[None, :]
            row, cell = np.nonzero(chosen)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * q.shape[1], pa.int32()), pa.array(q[row].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), lists, pa.array(cell, pa.int32())], ["query_id", "q", "cell"])

    return queries.select("query_id", "q", F.col("least").cast("double").alias("least")).mapInArrow(choose, f"query_id {kind}, q array<double>, cell int")


def search(cells: Cells, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, item_id, score, rank) of the k best vectors of each of `queries` (query_id, q), ties by item; and the pairs of queries and cells that were compared. Null queries have no rows."""
    own = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("q is not null")
    first = checkpointed(cell_pairs(cells, own.withColumn("least", F.lit(None).cast("double")), k))
    begun = checkpointed(best(cells, first, k))
    least = begun.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    rest = checkpointed(cell_pairs(cells, own.join(least, "query_id"), k))
    found = begun.drop("rank").unionByName(best(cells, rest, k).drop("rank"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    ranked = found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)
    return ranked.select("query_id", "item_id", "score", "rank"), first.unionByName(rest).select("query_id", "cell")


def compared_share(cells: Cells, pairs: DataFrame, n_queries: int) -> float:
    """The share of all pairs of a query and a vector that were compared."""
    sizes = {r.cell: r.n for r in pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # CENTRES rows at most
    return float(sum(n * int(cells.size[c]) for c, n in sizes.items()) / max(1, n_queries * int(cells.size.sum())))
