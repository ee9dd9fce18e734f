"""URI dispatch: schemes to Hadoop paths or JDBC options, extensions to formats."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from . import jdbc, readers, writers

# fixed values: scheme -> Hadoop file-system scheme
STORE_SCHEMES = {"": "", "file": "file", "s3": "s3a", "s3a": "s3a", "gs": "gs", "azure": "abfss", "wasb": "wasb", "wasbs": "wasbs", "abfss": "abfss", "hdfs": "hdfs"}
# fixed values: scheme -> JDBC sub-protocol
DATABASE_SCHEMES = {"postgresql": "postgresql", "postgres": "postgresql", "mysql": "mysql", "sqlite": "sqlite", "mssql": "sqlserver", "oracle": "oracle"}


def kind(uri: str) -> str:
    """``store`` or ``database``; other schemes are refused."""
    scheme = urlparse(uri).scheme.split("+")[0].lower()
    if scheme in DATABASE_SCHEMES:
        return "database"
    if scheme in STORE_SCHEMES:
        return "store"
    raise ValueError(f"no reader for scheme {scheme!r}")


def store_path(uri: str) -> str:
    parts = urlparse(uri)
    scheme = STORE_SCHEMES[parts.scheme.lower()]
    return uri if not scheme else f"{scheme}://{parts.netloc}{parts.path}"


def store_format(path: str) -> str:
    """Format by extension, CSV when unknown."""
    try:
        return readers.detect_format(path)
    except ValueError:
        return "csv"


def read(spark: SparkSession, uri: str, table: str | None = None, query: str | None = None, **options) -> DataFrame:
    if kind(uri) == "database":
        return jdbc.read(spark, jdbc.url_options(uri), table=table, query=query, **options)
    path = store_path(uri)
    return readers.read(spark, path, store_format(path), **options)


def write(df: DataFrame, uri: str, table: str | None = None, if_exists: str = "fail", **options) -> None:
    if kind(uri) == "database":
        jdbc.write(df, jdbc.url_options(uri), table, if_exists)
        return
    path = store_path(uri)
    writers.write(df, path, store_format(path), if_exists=if_exists, **options)
