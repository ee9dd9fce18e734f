"""Connected components of an edge table by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def rooted(least: DataFrame) -> DataFrame:
    """Follow (id, to) with to <= id to the end of every chain, doubling the steps each time."""
    while True:
        further = least.select(F.col("id").alias("to"), F.col("to").alias("far"))
        now = written(least.join(further, "to", "left").select("id", F.coalesce("far", "to").alias("to"), (F.coalesce("far", "to") != F.col("to")).alias("moved")), "roots")
        least = now.select("id", "to")
        if now.filter("moved").limit(1).count() == 0:
            return least


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b); component is the smallest id that links reach.

    Each round points every id at its least neighbour, follows the pointers to their roots and contracts the links to
    links between roots, of which few are left. A round touches each link twice and is written. Self-links and repeated
    links change nothing; no links give no rows.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while labels is None or edges.limit(1).count() > 0:
        ends = edges.select(F.col("a").alias("id"), F.col("a").alias("to")).union(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        roots = rooted(written(ends.groupBy("id").agg(F.min("to").alias("to")), "least"))
        if labels is None:
            labels = roots
        else:
            labels = written(labels.join(roots.select(F.col("id").alias("to"), F.col("to").alias("far")), "to", "left").select("id", F.coalesce("far", "to").alias("to")), "labels")
        at_a = edges.join(roots.select(F.col("id").alias("a"), F.col("to").alias("root_a")), "a").select("root_a", "b")
        at_b = at_a.join(roots.select(F.col("id").alias("b"), F.col("to").alias("root_b")), "b").filter("root_a != root_b")
        edges = written(at_b.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
    return labels.select("id", F.col("to").alias("component"))
