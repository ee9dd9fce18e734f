"""User functions: per column, per batch of rows, chains, and names for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guarded import col


def apply_columns(df: DataFrame, func: Callable, columns: list[str], type: str | None = None) -> DataFrame:
    """Apply to each column: a Column-to-Column function stays an expression; with ``type`` it gets pandas Series."""
    if type is None:
        return df.withColumns({c: func(col(c)) for c in columns})
    udf = F.pandas_udf(func, type)
    return df.withColumns({c: udf(col(c)) for c in columns})


def apply_rows(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Row function over pandas batches; order and batch borders carry no meaning."""

    def batches(frames):
        for frame in frames:
            yield func(frame)

    return df.mapInPandas(batches, schema)


def chain(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def register_function(spark: SparkSession, name: str, func: Callable, type: str) -> None:
    """Expose a pandas function to SQL."""
    spark.udf.register(name, F.pandas_udf(func, type))


