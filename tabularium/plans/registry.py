"""Registry of named queries over the driver tables, each with an optional SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one directory: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def views(self, *names: str) -> None:
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 6):
    """Register a query; ``floats`` lists double columns rounded the same way on both sides."""
    rounded = floats.split()

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c), digits) for c in rounded}) if rounded else df

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _rounded_sql(sql, rounded, digits)
        return fn

    return register


def _rounded_sql(sql: str, rounded: list[str], digits: int) -> str:
    sql = sql.strip().rstrip(";")
    if not rounded:
        return sql
    # adding zero turns -0.0 into 0.0
    fixes = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {c}" for c in rounded)
    return f"SELECT * REPLACE ({fixes}) FROM (\n{sql}\n) AS q"
