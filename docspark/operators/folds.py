"""Order-dependent folds over groups of rows, many groups to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def fold_groups(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """`fold` of each group's rows (tuples of all columns, sorted) gives the rows of `schema`. Groups are dealt by key and sorted by Spark, which spills; a task
    holds one group and one batch."""
    n = [rows.columns.index(k) for k in keys]
    target = pa.schema([])

    def run(batches):
        group, at = [], None
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key = tuple(row[k] for k in n)
                if key != at:
                    if group:
                        out += fold(group)
                    group, at = [], key
                group.append(row)
            yield made(out)
        if group:
            yield made(fold(group))

    fields = rows.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(target)], schema=target)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
