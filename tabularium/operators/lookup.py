"""Joins against fitted lookup tables, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_lookup(df: DataFrame, table: DataFrame, on: list[str], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join a per-category table to the data; nothing runs while the plan is built.

    Spark sees the table's size in bytes when it has been aggregated: a small one is broadcast, and for a large one
    the hot keys of the data side are split over many tasks.
    """
    if not null_safe:
        return df.join(table, on, how)
    renamed = table.withColumnsRenamed({k: f"__k_{k}" for k in on})
    cond = [df[k].eqNullSafe(renamed[f"__k_{k}"]) for k in on]
    return df.join(renamed, cond, how).drop(*[f"__k_{k}" for k in on])
