import json

import pytest

from tabularium.sources import catalog, jdbc, readers, uri, writers
from tabularium.streaming import sources as S


def test_csv_inference_delimiter_and_encoding(spark, tmp_path):
    latin = tmp_path / "latin.csv"
    latin.write_bytes("name;n\nJosé;1\nZoë;2\n".encode("latin-1"))
    df = readers.read(spark, str(latin))
    assert [tuple(r) for r in df.orderBy("n").collect()] == [("José", 1), ("Zoë", 2)]
    tabbed = tmp_path / "t.txt"
    tabbed.write_text("a\tb\n1\tx\n")
    assert readers.read(spark, str(tabbed)).columns == ["a", "b"]


def test_json_forms(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    (tmp_path / "wrapped.json").write_text(json.dumps({"data": rows}))
    (tmp_path / "one.json").write_text(json.dumps(rows[0]))
    (tmp_path / "lines.ndjson").write_text("\n".join(json.dumps(r) for r in rows))
    counts = {n: readers.read(spark, str(tmp_path / n)).select("a").count() for n in ("array.json", "wrapped.json", "one.json", "lines.ndjson")}
    assert counts == {"array.json": 2, "wrapped.json": 2, "one.json": 1, "lines.ndjson": 2}


def test_large_csv_summary_example(spark, tmp_path):
    """10,000 rows with every tenth value missing."""
    lines = ["id,value,category,missing_col"] + [f"{i},{i / 7},{'ABC'[i % 3]},{'' if i % 10 == 0 else i}" for i in range(10_000)]
    path = tmp_path / "large.csv"
    path.write_text("\n".join(lines))
    catalog.register_file(spark, str(path), "sql_large")
    table = {r["column"]: r for r in catalog.summary(spark, "sql_large").collect()}
    assert table["missing_col"]["rows"] == 10_000 and table["missing_col"]["missing"] == 1_000
    assert catalog.sample_rows(spark, "sql_large", 5).count() == 5
    assert catalog.run_sql(spark, "SELECT count(*) AS n FROM sql_large WHERE category = :c", c="A").first()["n"] == 3334
    assert "sql_large" in {r["table"] for r in catalog.tables(spark).collect()}
    with pytest.raises(Exception):
        catalog.run_sql(spark, "SELECT nothing FROM sql_large").collect()


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    df = spark.range(3)
    writers.write(df, path)
    with pytest.raises(Exception):
        writers.write(df, path)
    writers.write(df, path, if_exists="append")
    assert readers.read(spark, path).count() == 6
    writers.write(df, path, if_exists="replace")
    assert readers.read(spark, path).count() == 3


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        readers.detect_format("x.bin")
    assert uri.store_format("x.bin") == "csv"


def test_uri_dispatch():
    assert uri.store_path("s3://bucket/a.parquet") == "s3a://bucket/a.parquet"
    assert uri.store_path("gs://bucket/a.csv") == "gs://bucket/a.csv"
    assert uri.kind("postgresql+psycopg2://h/db") == "database"
    with pytest.raises(ValueError):
        uri.kind("ftp://x/y")


def test_jdbc_options():
    base = jdbc.url_options("postgres://me:pw@host:5432/shop")
    assert base == {"url": "jdbc:postgresql://host:5432/shop", "user": "me", "password": "pw"}
    assert jdbc.url_options("mssql://h/db")["url"] == "jdbc:sqlserver://h;databaseName=db"
    out = jdbc.read_options(base, query="SELECT * FROM t WHERE a = :a AND b::text = :b", params={"a": 3, "b": "O'Hara"})
    assert out["query"] == "SELECT * FROM t WHERE a = 3 AND b::text = 'O''Hara'"
    split = jdbc.read_options(base, table="t", partition_column="id", bounds=(0, 100), partitions=4)
    assert split["dbtable"] == "t" and split["numPartitions"] == "4" and split["upperBound"] == "100"
    with pytest.raises(ValueError):
        jdbc.read_options(base)
    assert jdbc.SAVE_MODES == {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


def test_kafka_options():
    out = S.kafka_options(["a:1", "b:2"], "events", "latest", 500)
    assert out == {"kafka.bootstrap.servers": "a:1,b:2", "subscribe": "events", "startingOffsets": "latest", "maxOffsetsPerTrigger": "500"}


def test_metadata(spark, sf_dir):
    info = readers.file_info(spark, f"{sf_dir}/orders.parquet").first()
    assert info["rows"] == 1500 and info["columns"] == 6
    assert readers.schema_table(spark.read.parquet(f"{sf_dir}/nation.parquet")).count() == 3


def test_csv_as_people_write_it(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,t\n1,"x ""y"" z"\n2,"two\nlines"\n', encoding="utf-8")
    assert [r["t"] for r in readers.read_csv(spark, str(tmp_path / "q.csv"), multiline=True).orderBy("id").collect()] == ['x "y" z', "two\nlines"]
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a b.csv").write_bytes("id,name\n1,José\n".encode("utf-8"))
    (folder / "c.csv").write_bytes("id,name\n2,José\n3,Zoë\n".encode("latin-1"))
    rows = readers.read_csv(spark, str(folder)).orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in rows] == [(1, "José"), (2, "José"), (3, "Zoë")]


def test_bound_names_outside_of_literals_only():
    bound = jdbc.bind("""SELECT ':mm', "a:b", x::text /* :c */ FROM t -- :d
    WHERE at = :at AND name = :name AND note = 'it''s :name'""", {"at": 5, "name": "O'Hara :at"})
    assert bound == """SELECT ':mm', "a:b", x::text /* :c */ FROM t -- :d
    WHERE at = 5 AND name = 'O''Hara :at' AND note = 'it''s :name'"""
    with pytest.raises(KeyError, match="no value for :b"):
        jdbc.bind("SELECT :b", {"a": 1})
    with pytest.raises(ValueError, match="backslash"):
        jdbc.bind("SELECT :a", {"a": "x\\' OR 1=1 --"})
