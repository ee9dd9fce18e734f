"""File sinks, exports with a summary, and fact-table exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guarded import numeric_columns
from .jdbc import SAVE_MODES
from .readers import detect_format


def write(df: DataFrame, path: str, format: str | None = None, if_exists: str = "fail", partition_by: list[str] = (), **options) -> None:
    """csv, tsv, json, ndjson, parquet, orc or xml by suffix; the output is a folder of part files."""
    format = format or detect_format(path)
    if format in ("csv", "tsv", "txt", "json", "ndjson"):
        # times keep their microseconds
        options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", **options}
    writer = df.write.mode(SAVE_MODES[if_exists]).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format in ("csv", "tsv", "txt"):
        writer.options(header=True, sep="\t" if format == "tsv" else options.get("sep", ",")).csv(path)
    elif format == "xml":
        writer.options(rowTag=options.get("rowTag", "row")).format("xml").save(path)
    else:
        writer.format({"ndjson": "json"}.get(format, format)).save(path)


def export_summary(df: DataFrame) -> DataFrame:
    """(item, value): row and column counts and the mean of each numeric column."""
    from ..functions.guarded import col, wide_to_long

    numeric = numeric_columns(df)
    row = df.agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(numeric)])
    blocks = {"rows": {"value": F.col("n")}, "columns": {"value": F.lit(float(len(df.columns)))}}
    blocks |= {f"mean_{c}": {"value": F.col(f"m{i}")} for i, c in enumerate(numeric)}
    return wide_to_long(row, blocks, key="item")


def export_with_summary(df: DataFrame, folder: str, if_exists: str = "fail") -> DataFrame:
    """Write ``data`` and ``summary`` as CSV; returns the summary."""
    summary = export_summary(df)
    write(df, f"{folder}/data", "csv", if_exists)
    write(summary.coalesce(1), f"{folder}/summary", "csv", if_exists)
    return summary


def export_star(df: DataFrame, folder: str, dimensions: dict[str, list[str]], keys: list[str], if_exists: str = "fail", **named: dict[str, str]) -> DataFrame:
    """Write a fact table, its dimensions and its measures as CSV below ``folder``; returns the measures.

    A dimension holds the distinct rows of its columns, numbered from 1 in their order as ``<name>_id``; the fact table has
    the number in their place, so no column stands twice. Measures are those of ``aggregate.measures`` by ``keys``, given
    as ``distinct``, ``averages``, ``variances`` and ``totals``. Nulls are values of a dimension like others.
    """
    from ..functions.guarded import col
    from ..operators.aggregate import measures
    from ..operators.lookup import join_lookup
    from ..operators.ordered import row_numbers

    fact = df
    for name, columns in dimensions.items():
        table = row_numbers(df.select(*[col(c) for c in columns]).distinct(), [], columns, f"{name}_id")
        write(table, f"{folder}/{name}", "csv", if_exists)
        fact = join_lookup(fact, table, columns, null_safe=True).drop(*columns)
    write(fact, f"{folder}/fact", "csv", if_exists)
    made = measures(df, keys, **named)
    write(made, f"{folder}/measures", "csv", if_exists)
    return made
