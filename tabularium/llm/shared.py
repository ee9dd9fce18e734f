"""Helpers of the operators: written intermediates in the shared folder, row numbers inside tasks, Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent (a local session) does the session helper choose a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """key_a, key_b: 128 bits of id and text, never null. Rows that repeat share them, and their results are the same."""
    text = F.col(text_col).cast("string")
    return [F.xxhash64(F.col(id_col), text).alias("key_a"), F.xxhash64(text, F.col(id_col), F.lit(1)).alias("key_b")]


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields plain dicts of equally long columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in kind], schema=kind)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``max_bytes`` at most, or one row: long texts come in smaller slices."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * max_bytes // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def clean_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) as doubles, without vectors that are null or hold null or non-finite entries."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(F.col("vector").isNotNull() & ~bad)


def summed(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], kind: str, largest: str | None = None) -> tuple[list, int]:
    """Sums by position of the equally long ``part`` arrays that ``fn`` yields, one a task, and the largest of a long column.

    Parts are added in Spark: the driver receives one number a position. No tasks give no sums.
    """
    more = f", {largest} bigint" if largest else ""
    parts = map_arrow(df, fn, f"part array<{kind}>{more}")
    spread = parts.select(F.posexplode("part").alias("at", "value"), F.col(largest).alias("most") if largest else F.lit(0).cast("bigint").alias("most"))
    found = spread.groupBy("at").agg(F.sum("value").alias("total"), F.max("most").alias("most")).collect()
    found.sort(key=lambda r: r["at"])
    return [r["total"] for r in found], max((r["most"] for r in found), default=0)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by an integer column, as tables that hold whole groups, with the rows each group spans."""
    held = None
    for batch in batches:
        block = pa.Table.from_batches([batch])
        held = block if held is None else pa.concat_tables([held, block])
        if held.num_rows:
            values = held.column(key).to_numpy()
            # the last group may go on in the next batch
            done = int(np.searchsorted(values, values[-1]))
            if done:
                yield held.slice(0, done), spans(values[:done])
                held = held.slice(done)
    if held is not None and held.num_rows:
        yield held, spans(held.column(key).to_numpy())


def spans(values: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
    return list(zip(starts, [*starts[1:], len(values)]))
