"""Stream sources and sinks: Kafka JSON, file streams, micro-batch callbacks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.guarded import col
from ..session import ensure_checkpoint_dir


def kafka_options(servers: str | list[str], topic: str | list[str], offset_reset: str = "earliest", max_records: int | None = None, timeout_ms: int | None = None) -> dict[str, str]:
    """Source options; offsets live in the query checkpoint, so there is no consumer group to commit."""
    join = lambda v: ",".join(v) if isinstance(v, list) else v
    out = {"kafka.bootstrap.servers": join(servers), "subscribe": join(topic), "startingOffsets": offset_reset}
    if max_records:
        out["maxOffsetsPerTrigger"] = str(max_records)
    if timeout_ms:
        out["kafkaConsumer.pollTimeoutMs"] = str(timeout_ms)
    return out


def parse_json(raw: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Typed columns from JSON message values."""
    return raw.select(F.from_json(col(value).cast("string"), schema).alias("m")).select("m.*")


def read_kafka(spark: SparkSession, schema: T.StructType, **options) -> DataFrame:
    return parse_json(spark.readStream.format("kafka").options(**kafka_options(**options)).load(), schema)


def kafka_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, value) rows with the whole record as JSON."""
    value = F.to_json(F.struct(*[col(c) for c in df.columns])).alias("value")
    return df.select(col(key).cast("string").alias("key"), value) if key else df.select(value)


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None) -> StreamingQuery:
    writer = kafka_rows(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("checkpointLocation", checkpoint).start()


def read_files(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """Folder or glob as a stream, a bounded number of files per micro-batch."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """New folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def for_each_batch(df: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Run ``callback`` on every micro-batch; ``available_now`` stops once the present input is read."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(callback)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain(df: DataFrame, mode: str = "append", label: str = "stream") -> DataFrame:
    """Run a stream over its present input and return what it wrote.

    Append mode keeps every batch; complete mode replaces the table each batch.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, label)
    schema = df.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch: a replayed batch overwrites its own output only
        target = f"{folder}/out/batch={batch_id}" if mode == "append" else f"{folder}/out/batch=0"
        batch.write.mode("overwrite").parquet(target)

    query = for_each_batch(df, write, f"{folder}/checkpoint", mode)
    query.awaitTermination()
    if mode == "append" and query.lastProgress is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")
