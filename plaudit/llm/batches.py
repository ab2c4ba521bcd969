"""Arrow batches of bounded size through a Python function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20
PIECE_BYTES = 1 << 18

#: A batch in, batches out; called once per task with the iterator of the task's batches.
TaskFunction = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_tasks(df: DataFrame, task: TaskFunction, schema: str) -> DataFrame:
    """``task`` over the Arrow batches of every partition, each batch bounded in bytes.

    A batch is closed once it holds ``BATCH_BYTES``, so long texts do not pile up in a worker.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def groups_by_size(sizes: list[int], limit: int = PIECE_BYTES) -> Iterator[slice]:
    """Neighbouring items in groups of at most ``limit`` bytes; a larger item is its own group."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )
