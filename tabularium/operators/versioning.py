"""Dataset snapshots, a feature store and a model version table kept as Parquet on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guarded import col
from .monitoring import fingerprint


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if exists else None


class DatasetVersions:
    """Snapshots of a table under ``root``; equal content is stored once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self, name: str) -> DataFrame | None:
        return _read_or_none(self.spark, f"{self.root}/{name}/_registry")

    def save(self, df: DataFrame, name: str) -> int:
        """Write a snapshot and return its version; an identical earlier snapshot is reused."""
        known = self.versions(name)
        row = fingerprint(df).first()
        last = 0
        if known is not None:
            same = known.filter(F.col("content_hash") == row["content_hash"]).agg(F.min("version").alias("v")).first()["v"]
            if same is not None:
                return same
            last = known.agg(F.max("version").alias("v")).first()["v"]
        version = last + 1
        df.write.mode("errorifexists").parquet(f"{self.root}/{name}/data/version={version}")
        entry = self.spark.createDataFrame([(version, row["rows"], row["content_hash"])], "version int, rows bigint, content_hash string")
        entry.withColumn("created", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/{name}/_registry")
        return version

    def load(self, name: str, version: int | None = None) -> DataFrame:
        known = self.versions(name)
        if known is None:
            raise KeyError(name)
        if version is None:
            version = known.agg(F.max("version").alias("v")).first()["v"]
        return self.spark.read.parquet(f"{self.root}/{name}/data/version={version}")


class FeatureStore:
    """Feature groups by entity key; retrieval is a semi-join on the requested entities."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def register(self, group: str, df: DataFrame, key: str, description: str = "") -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{group}")
        features = [c for c in df.columns if c != key]
        entry = self.spark.createDataFrame([(group, key, features, description)], "feature_group string, key string, features array<string>, description string")
        entry.withColumn("registered", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/_groups")

    def groups(self) -> DataFrame:
        table = self.spark.read.parquet(f"{self.root}/_groups")
        latest = F.max_by(F.struct("key", "features", "description"), "registered").alias("g")
        return table.groupBy("feature_group").agg(latest).select("feature_group", "g.*")

    def features(self, group: str, entities: DataFrame | None = None, key: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{group}")
        return df if entities is None else select_entities(df, entities, key or entities.columns[0])


def select_entities(features: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    return features.join(entities.select(col(key)), key, "left_semi")


STAGES = ["none", "staging", "production", "archived"]


def register_model(spark: SparkSession, name: str, version: int, metrics: dict[str, float], path: str, at: str) -> DataFrame:
    """One registration event row."""
    schema = "model string, version int, event string, stage string, metrics map<string,double>, path string, at timestamp_ntz"
    import datetime

    return spark.createDataFrame([(name, version, "register", "none", {k: float(v) for k, v in metrics.items()}, path, datetime.datetime.fromisoformat(at))], schema)


def transition(spark: SparkSession, name: str, version: int, stage: str, at: str) -> DataFrame:
    """One stage-change event row."""
    if stage not in STAGES:
        raise ValueError(stage)
    import datetime

    schema = "model string, version int, event string, stage string, metrics map<string,double>, path string, at timestamp_ntz"
    return spark.createDataFrame([(name, version, "transition", stage, None, None, datetime.datetime.fromisoformat(at))], schema)


def model_versions(events: DataFrame) -> DataFrame:
    """(model, version, stage, metrics, path): current state of every version from its events."""
    return events.groupBy("model", "version").agg(
        F.max_by("stage", "at").alias("stage"),
        F.max_by("metrics", F.when(F.col("event") == "register", F.col("at"))).alias("metrics"),
        F.max_by("path", F.when(F.col("event") == "register", F.col("at"))).alias("path"),
    )


def latest_production(events: DataFrame) -> DataFrame:
    current = model_versions(events).filter(F.col("stage") == "production")
    return current.groupBy("model").agg(F.max_by(F.struct("version", "metrics", "path"), "version").alias("v")).select("model", "v.*")
