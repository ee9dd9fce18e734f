"""File scans: format by suffix, delimiter and encoding detection, multi-file merge, metadata."""

from __future__ import annotations

import os
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guarded import nan_to_null

# fixed values: suffix -> format
SUFFIXES = {
    ".parquet": "parquet",
    ".pq": "parquet",
    ".csv": "csv",
    ".tsv": "tsv",
    ".txt": "txt",
    ".json": "json",
    ".jsonl": "ndjson",
    ".ndjson": "ndjson",
    ".xml": "xml",
    ".orc": "orc",
}
# fixed values: UTF-8, else the single-byte encoding that accepts every byte
ENCODINGS = ["utf-8", "iso-8859-1"]
DELIMITERS = [",", ";", "\t"]


def detect_format(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"no format known for suffix {suffix!r}")
    return SUFFIXES[suffix]


def read(spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Scan a file or folder; ``format`` overrides the suffix."""
    format = format or detect_format(path)
    if format in ("csv", "tsv", "txt"):
        if format == "tsv":
            options.setdefault("sep", "\t")
        return read_csv(spark, path, schema=schema, **options)
    if format in ("json", "ndjson"):
        return read_json(spark, path, lines=format == "ndjson", schema=schema, **options)
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    return nan_to_null(reader.format(format).load(path))


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that occurs most often in the first lines."""
    lines = [r[0] for r in spark.read.text(path).limit(5).collect()]
    return max(DELIMITERS, key=lambda d: sum(line.count(d) for line in lines))


def file_encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Encoding -> files: UTF-8 unless some line of the file is not valid UTF-8; one pass over the text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("ok"))
    found: dict[str, list[str]] = {}
    for file, ok in lines.groupBy("file").agg(F.min("ok")).collect():
        found.setdefault(ENCODINGS[0] if ok else ENCODINGS[1], []).append(unquote(file))
    return found


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The encoding that reads every file below the path."""
    return ENCODINGS[1] if ENCODINGS[1] in file_encodings(spark, path) else ENCODINGS[0]


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str | None = None,
    encoding: str | None = None,
    multiline: bool = False,
    **options,
) -> DataFrame:
    """CSV/TSV/TXT scan with header; without a schema, types are inferred from all rows.

    A quote inside a quoted value is written twice. ``multiline`` lets quoted values hold line breaks (a file is then
    one split). Without ``encoding`` each file is read in its own.
    """
    sep = sep or detect_delimiter(spark, path)
    base = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multiline, "mode": "PERMISSIVE", **options}
    files = {encoding: [path]} if encoding else file_encodings(spark, path)
    if len(files) <= 1:
        reader = spark.read.options(**base, encoding=next(iter(files), ENCODINGS[0]))
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return nan_to_null(reader.csv(path))
    if schema is None:
        # types do not depend on how letters are decoded
        schema = spark.read.options(**base, encoding=ENCODINGS[1], inferSchema=True).csv(path).schema
    parts = [spark.read.options(**base, encoding=e).schema(schema).csv(own) for e, own in sorted(files.items())]
    return nan_to_null(reduce(DataFrame.unionByName, parts))


def read_json(spark: SparkSession, path: str, lines: bool = False, schema=None, envelope: str | None = "data", **options) -> DataFrame:
    """JSON array/object or NDJSON; rows wrapped as ``{"data": [...]}`` are unpacked."""
    reader = spark.read.options(multiLine=not lines, **options)
    reader = reader.schema(schema) if schema is not None else reader
    df = reader.json(path)
    field = next((f for f in df.schema.fields if f.name == envelope), None)
    if field is not None and isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
        df = df.select(F.inline(field.name))
    return nan_to_null(df)


def read_many(spark: SparkSession, paths: list[str], merge: bool = True) -> DataFrame | dict[str, DataFrame]:
    """Read several files; merged by column name, or kept apart by path."""
    frames = {p: read(spark, p) for p in paths}
    if not merge:
        return frames
    out = None
    for df in frames.values():
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_in_batches(spark: SparkSession, path: str, schema: T.StructType, format: str = "csv", files_per_batch: int = 1, **options) -> DataFrame:
    """Incremental read of a folder: a file stream whose batches hold a bounded number of files."""
    return (
        spark.readStream.format(format).schema(schema).options(**options).option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def schema_table(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def file_info(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """(path, bytes, rows, columns, modified) of every file behind a scan."""
    df = read(spark, path, format)
    meta = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
                     F.col("_metadata.file_modification_time").alias("modified"))
    return meta.groupBy("path", "bytes", "modified").agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
