"""Order-dependent operators that survive a hot key or no key at all.

Spark runs a window per key in one task. A key holding a third of the rows, or a window without a key, would put
an unbounded group there. Groups above ``spark.tabularium.maxGroupRows`` are therefore range-partitioned by
(key, order), each range gets a number, and results are stitched: bounded frames work on blocks of rows by place and borrow
the few rows they need from the blocks beside them, running aggregates add the totals of earlier ranges. Groups below the limit take the
plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.guarded import col
from ..session import ensure_checkpoint_dir, max_group_rows

_ALL = "__all"
_RANGE = "__range"


class Ordered:
    """Rows ordered ascending by ``order_by`` (end it with a unique column) inside each ``keys`` group."""

    def __init__(self, df: DataFrame, keys: list[str], order_by: list[str], max_rows: int | None = None):
        self.max_rows = max_rows or max_group_rows(df.sparkSession)
        self.columns = df.columns
        self.order_by = list(order_by)
        self.global_order = not keys
        if self.global_order:
            df = df.withColumn(_ALL, F.lit(0))
        self.keys = list(keys) or [_ALL]
        self.df = df
        self.cold, self.hot = self._split()

    def _split(self) -> tuple[DataFrame | None, DataFrame | None]:
        sizes = self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > self.max_rows)
        # at most (all rows / max_rows) keys can be this large
        big = sizes.collect()
        if not big:
            return self.df, None
        total = sum(r["__n"] for r in big)
        spark = self.df.sparkSession
        ensure_checkpoint_dir(spark)
        if self.global_order:
            cold, hot = None, self.df
        else:
            hot_keys = spark.createDataFrame([tuple(r)[:-1] for r in big], sizes.drop("__n").schema)
            renamed = F.broadcast(hot_keys.withColumnsRenamed({k: f"__h_{k}" for k in self.keys}))
            match = [self.df[k].eqNullSafe(renamed[f"__h_{k}"]) for k in self.keys]
            cold = self.df.join(renamed, match, "left_anti")
            hot = self.df.join(renamed, match, "left_semi")
        ranges = max(2, math.ceil(total / self.max_rows))
        hot = (
            hot.repartitionByRange(ranges, *[col(c) for c in self.keys + self.order_by])
            .withColumn(_RANGE, F.spark_partition_id())
            .checkpoint()
        )
        return cold, hot

    def _spec(self, *keys: str) -> WindowSpec:
        return Window.partitionBy(*[col(k) for k in keys]).orderBy(*[col(c) for c in self.order_by])

    def _finish(self, parts: list[DataFrame | None], added: list[str]) -> DataFrame:
        names = [c for c in self.columns if c not in added] + added
        parts = [p.select(*[col(n) for n in names]) for p in parts if p is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def bounded(self, preceding: int, following: int, build: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
        """Columns from ROWS frames (or lag/lead) reaching at most ``preceding``/``following`` rows away."""
        spec = self._spec(*self.keys)
        added = build(spec)
        cold = self.cold.withColumns(added) if self.cold is not None else None
        if self.hot is None:
            return self._finish([cold], list(added))
        # rows are counted off into blocks of a key, so a frame reaches into the next block on either side at most
        size = max(self.max_rows, preceding, following)
        place = F.col("__o_pos") % size
        after = F.when(place >= size - preceding, F.lit(1))
        before = F.when(place < following, F.lit(-1))
        rows = self._positions().withColumn("__o_step", F.explode(F.array_compact(F.array(F.lit(0), after, before))))
        rows = rows.withColumn("__o_block", F.floor(F.col("__o_pos") / size) + F.col("__o_step"))
        hot = rows.withColumns(build(self._spec(*self.keys, "__o_block"))).filter("__o_step = 0")
        return self._finish([cold, hot], list(added))

    def _positions(self) -> DataFrame:
        """Rows of hot keys with their 0-based place in the key: the place in the range plus the rows of earlier ranges."""
        rows = self.hot.withColumn("__o_rn", F.row_number().over(self._spec(*self.keys, _RANGE)).cast("long"))
        earlier = Window.partitionBy(*[col(k) for k in self.keys]).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
        starts = self.hot.groupBy(*self.keys, _RANGE).agg(F.count(F.lit(1)).alias("__o_n"))
        starts = starts.withColumn("__o_start", F.coalesce(F.sum("__o_n").over(earlier), F.lit(0))).drop("__o_n")
        placed = self._null_safe(rows, starts, [*self.keys, _RANGE])
        return placed.withColumn("__o_pos", F.col("__o_start") + F.col("__o_rn") - 1).drop("__o_start", "__o_rn")

    def running(
        self,
        sums: dict[str, Column] | None = None,
        ffill: dict[str, Column] | None = None,
        bfill: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Running sums, last non-null so far and next non-null, over an unbounded frame."""
        sums, ffill, bfill = sums or {}, ffill or {}, bfill or {}
        names = [*sums, *ffill, *bfill]

        def local_columns(spec: WindowSpec) -> dict[str, Column]:
            past = spec.rowsBetween(Window.unboundedPreceding, 0)
            future = spec.rowsBetween(0, Window.unboundedFollowing)
            out = {n: F.sum(c).over(past) for n, c in sums.items()}
            out |= {n: F.last(c, ignorenulls=True).over(past) for n, c in ffill.items()}
            out |= {n: F.first(c, ignorenulls=True).over(future) for n, c in bfill.items()}
            return out

        cold = self.cold.withColumns(local_columns(self._spec(*self.keys))) if self.cold is not None else None
        if self.hot is None:
            return self._finish([cold], names)
        hot = self.hot.withColumns(local_columns(self._spec(*self.keys, _RANGE)))
        order = F.struct(*[col(c) for c in self.order_by])
        totals = [F.sum(c).alias(f"__t_{n}") for n, c in sums.items()]
        totals += [F.max_by(c, F.when(c.isNotNull(), order)).alias(f"__t_{n}") for n, c in ffill.items()]
        totals += [F.min_by(c, F.when(c.isNotNull(), order)).alias(f"__t_{n}") for n, c in bfill.items()]
        by_key = Window.partitionBy(*[col(k) for k in self.keys]).orderBy(_RANGE)
        before = by_key.rowsBetween(Window.unboundedPreceding, -1)
        after = by_key.rowsBetween(1, Window.unboundedFollowing)
        carry = {f"__c_{n}": F.sum(f"__t_{n}").over(before) for n in sums}
        carry |= {f"__c_{n}": F.last(f"__t_{n}", ignorenulls=True).over(before) for n in ffill}
        carry |= {f"__c_{n}": F.first(f"__t_{n}", ignorenulls=True).over(after) for n in bfill}
        carried = self.hot.groupBy(*self.keys, _RANGE).agg(*totals).withColumns(carry)
        hot = self._null_safe(hot, carried, [*self.keys, _RANGE])
        joined = {
            n: F.when(col(n).isNull(), F.col(f"__c_{n}")).otherwise(
                col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))
            )
            for n in sums
        }
        joined |= {n: F.coalesce(col(n), F.col(f"__c_{n}")) for n in [*ffill, *bfill]}
        return self._finish([cold, hot.withColumns(joined)], names)

    @staticmethod
    def _null_safe(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
        """Join the per-range table (a few times rows / max_rows entries) to the rows; Spark sees its size at run time."""
        renamed = table.withColumnsRenamed({k: f"__j_{k}" for k in on})
        cond = [rows[k].eqNullSafe(renamed[f"__j_{k}"]) for k in on]
        return rows.join(renamed, cond, "left").drop(*[f"__j_{k}" for k in on])


def row_numbers(df: DataFrame, keys: list[str], order_by: list[str], name: str = "rn") -> DataFrame:
    """1-based position of each row in its group, split over ranges when the group is large."""
    return Ordered(df, keys, order_by).running(sums={name: F.lit(1).cast("long")})


def running_totals(df: DataFrame, keys: list[str], order_by: list[str], sums: dict[str, Column]) -> DataFrame:
    return Ordered(df, keys, order_by).running(sums=sums)
