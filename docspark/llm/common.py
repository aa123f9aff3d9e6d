"""What the operators of this package share: reading, checkpoints, Arrow batches, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python, so that a worker's memory doesn't follow the length of texts.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

#: Tables of so many rows at most are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000

#: A-Z to lower case; every byte that is no word byte (0-9, a-z, 128-255) to a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's Arrow batch limits to BATCH_ROWS and BATCH_BYTES; a smaller setting of the session stays."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        digits = "".join(c for c in spark.conf.get(key) if c.isdigit())
        if not spark.conf.get(key).strip("bB").isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a session of one machine may go without; it gets a folder of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docspark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and cut from its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared checkpoint folder. For loops: a checkpoint's estimated size is that of its whole past, and joins multiply estimates, round by round."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, to be broadcast if its counted `rows` are BROADCAST_ROWS at most; a larger one is joined by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def release_memory() -> None:
    """Gives what this process has freed back to the system: workers are kept, and stages that follow need the room."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def remainder(column, modulus: int):
    """crc32 of a column as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `rows`."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
