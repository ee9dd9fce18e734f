"""Automated batch job: impute, deduplicate, date parts, score, write."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.guarded import date_columns
from .cleaning import fill_missing
from .features import date_parts


def prepare_batch(df: DataFrame) -> DataFrame:
    """Fill gaps, then deduplicate and expand date columns."""
    out = fill_missing(df, drop_above=1.0).dropDuplicates()
    for c in date_columns(out):
        out = date_parts(out, c)
    return out


def run_batch(df: DataFrame, output: str, model=None, format: str = "parquet", mode: str = "overwrite") -> DataFrame:
    """Prepare, optionally score with a fitted model, write, and return what was written."""
    out = prepare_batch(df)
    if model is not None:
        out = model.transform(out)
    out.write.format(format).mode(mode).save(output)
    return df.sparkSession.read.format(format).load(output)
