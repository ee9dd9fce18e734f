"""Removal of boilerplate lines by how many sites carry them.

Lines are hashed; a HyperLogLog sketch of sites per line hash is merged by aggregation, map side first, so a line on
every page of the corpus is as cheap as any other. Lines whose estimate lies within the sketch's error of the threshold
are counted exactly, over all their occurrences. A boilerplate line stays in the document of the smallest id that holds
it and leaves all others, so nothing is lost from the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import row_keys, written

BLANKS = " \t\r"


def line_hashes(line: Column) -> list[Column]:
    """128 bits of a line without blanks at its ends."""
    bare = F.btrim(line, F.lit(BLANKS))
    return [F.xxhash64(bare).alias("h1"), F.xxhash64(bare, F.lit(1)).alias("h2")]


def site_lines(documents: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row per line that is not blank: id, site ('' if null), h1, h2, key_a, key_b."""
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
                            *row_keys(id_col, text_col), F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("line"))
    return rows.filter(F.btrim("line", F.lit(BLANKS)) != "").select("id", "site", *line_hashes(F.col("line")), "key_a", "key_b")


def boilerplate(lines: DataFrame, min_sites: int, log_k: int) -> DataFrame:
    """(h1, h2, first_id) of lines on at least ``min_sites`` sites."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(log_k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    # a line has no more sites than occurrences
    seen = written(sketches.filter(F.col("n") >= min_sites).select("h1", "h2", "first_id", F.hll_sketch_estimate("sketch").alias("sites")), "line-sketches")
    error = 3 * 1.04 / (1 << log_k) ** 0.5
    low, high = int(min_sites * (1 - error)) - 1, min_sites * (1 + error) + 1
    near = seen.filter(F.col("sites").between(low, high))
    pairs = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact")).filter(F.col("exact") >= min_sites)
    sure = seen.filter(F.col("sites") > high).select("h1", "h2", "first_id")
    return sure.unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first_id"))


def remove_boilerplate(documents: DataFrame, min_sites: int = 10, log_k: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The documents with ``text_col`` freed of boilerplate lines, and n_lines and n_removed.

    Lines are split at line feeds and compared without blanks at their ends; blank lines are never removed. A null text
    stays null with 0 lines; a null site counts as one site. Repeated rows get equal results; where ids are null the
    line stays if no row with it has an id. Other columns are unchanged; columns named n_lines or n_removed are replaced.
    """
    lines = site_lines(documents, id_col, text_col, site_col)
    found = written(boilerplate(lines, min_sites, log_k), "boilerplate")
    drops = lines.join(found, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("first_id")))
    # at most the lines of one document in a group
    drops = drops.groupBy("key_a", "key_b").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    # the row goes along as one struct, so its column names meet no others
    keyed = documents.select(F.struct("*").alias("doc"), F.split(F.col(text_col), "\n").alias("own"), *row_keys(id_col, text_col))
    joined = keyed.join(drops, ["key_a", "key_b"], "left")
    stays = lambda line: (F.btrim(line, F.lit(BLANKS)) == "") | ~F.array_contains(F.col("drops"), F.struct(*line_hashes(line)))
    joined = joined.withColumn("kept", F.when(F.col("drops").isNull(), F.col("own")).otherwise(F.filter("own", stays)))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("bigint")
    text = F.when(F.col("drops").isNull(), F.col("doc").getField(text_col)).otherwise(F.array_join("kept", "\n"))
    columns = [(text if c == text_col else F.col("doc").getField(c)).alias(c) for c in documents.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, size("own").alias("n_lines"), (size("own") - size("kept")).alias("n_removed"))
