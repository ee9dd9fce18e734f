"""Database reads and writes over JDBC; the driver jar comes with the cluster."""

from __future__ import annotations

import datetime
import re
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

SAVE_MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


def url_options(uri: str) -> dict[str, str]:
    """url, user and password options of a database URI."""
    from .uri import DATABASE_SCHEMES

    parts = urlparse(uri)
    protocol = DATABASE_SCHEMES[parts.scheme.split("+")[0].lower()]
    host = parts.hostname or ""
    port = f":{parts.port}" if parts.port else ""
    name = parts.path.lstrip("/")
    if protocol == "sqlite":
        out = {"url": f"jdbc:sqlite:{parts.path}"}
    elif protocol == "sqlserver":
        out = {"url": f"jdbc:sqlserver://{host}{port};databaseName={name}"}
    elif protocol == "oracle":
        out = {"url": f"jdbc:oracle:thin:@{host}{port}/{name}"}
    else:
        out = {"url": f"jdbc:{protocol}://{host}{port}/{name}"}
    if parts.username:
        out |= {"user": parts.username, "password": parts.password or ""}
    return out


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return f"'{value.isoformat(sep=' ') if isinstance(value, datetime.datetime) else value.isoformat()}'"
    text = str(value)
    # some databases take a backslash for an escape, others for itself: no quoting is right for both
    if "\\" in text:
        raise ValueError("text with a backslash cannot be bound")
    return "'" + text.replace("'", "''") + "'"


#: what a name may not be looked for in: literals, quoted names, comments and casts; then the name itself
TOKENS = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|::|:([A-Za-z_]\w*)""", re.S)


def bind(query: str, params: dict[str, object] | None) -> str:
    """Replace ``:name`` by quoted literals outside of literals, quoted names and comments; every name must be given."""
    if not params:
        return query

    def replaced(m: re.Match) -> str:
        if m.group(1) is None:
            return m.group(0)
        if m.group(1) not in params:
            raise KeyError(f"no value for :{m.group(1)}")
        return literal(params[m.group(1)])

    return TOKENS.sub(replaced, query)


def read_options(
    base: dict[str, str],
    table: str | None = None,
    query: str | None = None,
    params: dict[str, object] | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
    fetch_rows: int = 10_000,
) -> dict[str, str]:
    """Reader options; a partition column with bounds splits the read over tasks."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    out = {**base, "fetchsize": str(fetch_rows)}
    if partition_column:
        source = table if table else f"({bind(query, params)}) AS q"
        out |= {
            "dbtable": source,
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions or 8),
        }
    elif table:
        out["dbtable"] = table
    else:
        out["query"] = bind(query, params)
    return out


def read(spark: SparkSession, base: dict[str, str], **options) -> DataFrame:
    return spark.read.format("jdbc").options(**read_options(base, **options)).load()


def write(df: DataFrame, base: dict[str, str], table: str, if_exists: str = "fail", batch_rows: int = 10_000) -> None:
    df.write.format("jdbc").options(**base, dbtable=table, batchsize=str(batch_rows)).mode(SAVE_MODES[if_exists]).save()
