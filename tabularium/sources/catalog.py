"""Named views over files, free SQL, and catalogue listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers


def register_file(spark: SparkSession, path: str, name: str, format: str | None = None, **options) -> DataFrame:
    """Expose a file as a temporary view; the scan stays lazy."""
    df = readers.read(spark, path, format, **options)
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, text: str, **params) -> DataFrame:
    """Any Spark SQL over registered views; errors are raised, never swallowed."""
    return spark.sql(text, args=params or None)


def sample_rows(spark: SparkSession, name: str, n: int = 5) -> DataFrame:
    return spark.table(name).limit(n)


def summary(spark: SparkSession, name: str) -> DataFrame:
    """(column, type, rows, missing) of a view from one aggregation."""
    df = spark.table(name)
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(f"__n{i}") for i, c in enumerate(df.columns)])
    fields = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("__rows").alias("rows"),
                 (F.col("__rows") - F.col(f"__n{i}")).alias("missing"))
        for i, f in enumerate(df.schema.fields)
    ]
    return row.select(F.inline(F.array(*fields)))


def tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table string, kind string, temporary boolean")


def columns(spark: SparkSession, name: str) -> DataFrame:
    rows = [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(name)]
    return spark.createDataFrame(rows, "column string, type string, nullable boolean")
