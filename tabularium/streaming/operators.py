"""Windowed, keyed and stateful stream operators; each has the same result as its batch form on replayed data."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.guarded import col
from ..operators.ordered import row_numbers

#: groups of keys in a stateful stream; keys that are null or NaN have groups of their own
BUCKETS, NULL_BUCKET, NAN_BUCKET = 512, -1, -2

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep operator state outside the executor heap; needed by list and timer state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def chain(df: DataFrame, processors: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply processors in order, each to the previous output."""
    for p in processors:
        df = df.transform(p)
    return df


def tumbling(df: DataFrame, ts: str, duration: str, keys: list[str], aggs: list[Column], watermark: str | None = None) -> DataFrame:
    """Event-time windows; late rows beyond the watermark are dropped by the stream and kept by the batch form."""
    plain = isinstance(df.schema[ts].dataType, T.TimestampNTZType)
    if watermark:
        # watermarks need a zoned timestamp
        df = (df.withColumn(ts, col(ts).cast("timestamp")) if plain else df).withWatermark(ts, watermark)
    start = F.col("__w.start").cast("timestamp_ntz") if plain else F.col("__w.start")
    grouped = df.groupBy(F.window(col(ts), duration).alias("__w"), *[col(k) for k in keys]).agg(*aggs)
    return grouped.select(start.alias("window_start"), *[c for c in grouped.columns if c != "__w"])


def running_features(df: DataFrame, key: str, values: list[str], null_aware: bool = False) -> DataFrame:
    """(key, events, c_sum, c_avg): average over events, or over non-null values when ``null_aware``."""
    aggs = [F.count(F.lit(1)).alias("events")]
    for c in values:
        total = F.coalesce(F.sum(col(c)), F.lit(0))
        n = F.count(col(c)) if null_aware else F.count(F.lit(1))
        aggs += [total.alias(f"{c}_sum"), F.try_divide(total, n).alias(f"{c}_avg")]
    return df.groupBy(col(key)).agg(*aggs)


def count_windows(df: DataFrame, key: str, order_by: list[str], size: int, aggs: list[Column], full_only: bool = False) -> DataFrame:
    """Batch form of count windows: every ``size`` consecutive events of a key form a window."""
    numbered = row_numbers(df, [key], order_by, "__rn").withColumn("window", F.floor((F.col("__rn") - 1) / size))
    out = numbered.groupBy(col(key), "window").agg(F.count(F.lit(1)).alias("events"), *aggs)
    return out.filter(F.col("events") == size) if full_only else out


class BufferedWindow(StatefulProcessor):
    """Flush a key's buffer at ``size`` events, or ``seconds`` after its first event by processing time.

    Windows follow arrival: rows of one micro-batch are taken in ``order`` order, later batches come after; see
    ``event_windows`` for event order. The state of a key never exceeds ``size`` rows; limit the micro-batch (offsets or
    files per trigger) to bound what a hot key brings at once.
    """

    def __init__(self, key: str, fields: list[str], order: list[str], schema: str, size: int, seconds: int | None, processors: list[Callable[[pd.DataFrame], pd.DataFrame]]):
        self.key, self.fields, self.order, self.schema = key, fields, order, schema
        self.size, self.seconds, self.processors = size, seconds, processors

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", self.schema)
        self.flushed = handle.getValueState("flushed", "n bigint")

    def _flush(self, key, rows: list[tuple]) -> pd.DataFrame:
        number = self.flushed.get()[0] if self.flushed.exists() else 0
        self.flushed.update((number + 1,))
        out = pd.DataFrame(rows, columns=self.fields)
        for p in self.processors:
            out = p(out)
        out.insert(0, "window", number)
        out.insert(0, self.key, key[0])
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.buffer.get()) if self.buffer.exists() else []
        was_empty = not held
        arrived = pd.concat(list(rows)).sort_values(self.order)[self.fields]
        held += [tuple(r) for r in arrived.itertuples(index=False, name=None)]
        start = 0
        while len(held) - start >= self.size:
            yield self._flush(key, held[start : start + self.size])
            start += self.size
        rest = held[start:]
        if rest:
            self.buffer.put(rest)
        else:
            self.buffer.clear()
        if self.seconds and rest and (was_empty or start):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.seconds * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.buffer.get()) if self.buffer.exists() else []
        if held:
            self.buffer.clear()
            yield self._flush(key, held)

    def close(self) -> None:
        pass


def buffered_windows(
    df: DataFrame,
    key: str,
    fields: list[str],
    order: list[str],
    output: str,
    size: int,
    seconds: int | None,
    processors: list[Callable[[pd.DataFrame], pd.DataFrame]],
) -> DataFrame:
    """Stream of processed windows; ``output`` is the schema of (key, window, processed columns)."""
    use_rocksdb(df.sparkSession)
    kept = df.select(*[col(c) for c in dict.fromkeys([key, *fields, *order])])
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in fields)
    processor = BufferedWindow(key, fields, order, schema, size, seconds, processors)
    mode = "ProcessingTime" if seconds else "None"
    return kept.groupBy(key).transformWithStateInPandas(processor, output, "Append", mode)


class EventOrdered(StatefulProcessor):
    """Rows of each key in event-time order, whatever the order they arrive in.

    The state's group is a bucket of keys, as a call from Python to the state store costs more than the rows of most keys.
    Arrivals are held, a piece of state a micro-batch, until the watermark has passed them: an event-time timer at the
    earliest held row wakes the bucket, the rows at or below the watermark go key by key to ``step`` in order, the others
    stay. Rows behind the watermark never get here; Spark counts them (see ``late_rows``). A key whose events pause for more
    than ``idle`` seconds starts anew, and a timer frees its state then; without ``idle`` it is kept for good.

    ``step``, ``passed`` and ``forget`` change a key's ``state``, a dictionary of plain values, and yield what ``table``
    takes. Rows are tuples (microseconds, *fields); ``order`` names the fields that break ties.
    """

    #: rows in a piece of state, and items in a table
    PIECE = 50_000

    def __init__(self, fields: list[str], order: list[str], columns: list[str], idle: int | None):
        self.fields, self.order, self.columns = fields, order, columns
        self.idle = idle * 1_000_000 if idle else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "piece binary")
        self.states = handle.getValueState("states", "all binary")
        self.reached: dict[int, int] = {}

    def wake(self, at: int) -> None:
        # timers count milliseconds and fire once the watermark is past them
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            if part.empty:
                continue
            self.pending.appendList(self._pieces(part[["event_key", "at", *self.fields]]))
            first = int(part["at"].min())
            earliest = first if earliest is None else min(first, earliest)
        if earliest is not None:
            self.wake(earliest)
        return iter(())

    def _pieces(self, rows: pd.DataFrame) -> list[tuple]:
        return [(pickle.dumps(rows.iloc[i : i + self.PIECE]),) for i in range(0, len(rows), self.PIECE)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, bucket = timerValues.getCurrentWatermarkInMs() * 1000, int(key[0])
        if self.reached.get(bucket) == watermark:
            return
        self.reached[bucket] = watermark
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        due, waiting, wakes = self._due(bucket, watermark)
        items = []
        for name in list(dict.fromkeys([*due, *states])) if self.timed() else list(due):
            entry = states.setdefault(name, {"newest": None, "state": {}})
            items.extend(self._advance(name, entry, due.get(name, []), watermark, name in waiting))
            if entry["newest"] is None:
                del states[name]
            elif self.timed():
                wakes += self._wakes(entry, name in waiting)
            while len(items) >= self.PIECE:
                yield self.table(items[: self.PIECE])
                items = items[self.PIECE :]
        if items:
            yield self.table(items)
        if states:
            self.states.update((pickle.dumps(states),))
        else:
            self.states.clear()
        if wakes:
            self.wake(min(wakes))

    def _due(self, bucket: int, watermark: int) -> tuple[dict, set, list[int]]:
        """Rows the watermark has passed by key, in order; the keys of the others, and the time of the first of those."""
        held = [pickle.loads(r[0]) for r in self.pending.get()] if self.pending.exists() else []
        if not held:
            return {}, set(), []
        rows = pd.concat(held, ignore_index=True)
        if bucket < 0:
            rows["event_key"] = bucket
        passed = rows["at"] <= watermark
        later, rows = rows[~passed], rows[passed]
        if len(rows):
            if len(later):
                self.pending.put(self._pieces(later))
            else:
                self.pending.clear()
        rows = rows.sort_values(["at", *self.order], kind="stable")
        values = rows[["at", *self.fields]].astype(object)
        values = values.where(values.notna(), None)
        due: dict = {}
        for name, row in zip(rows["event_key"].tolist(), values.itertuples(index=False, name=None)):
            due.setdefault(self._name(bucket, name), []).append(row)
        waiting = {self._name(bucket, name) for name in later["event_key"].unique().tolist()}
        return due, waiting, [int(later["at"].min())] if len(later) else []

    @staticmethod
    def _name(bucket: int, name):
        """Null and NaN have buckets of their own."""
        return name if bucket >= 0 else None if bucket == NULL_BUCKET else "NaN"

    def _advance(self, name, entry: dict, rows: list[tuple], watermark: int, waits: bool) -> Iterator:
        key, newest, state = float("nan") if name == "NaN" and self.nan else name, entry["newest"], entry["state"]
        for run in self.without_pauses(rows):
            if newest is not None and self.idle and run[0][0] - newest > self.idle:
                yield from self.forget(key, state)
                state.clear()
            yield from self.step(key, state, run)
            newest = run[-1][0]
        yield from self.passed(key, state, watermark)
        if self.idle and newest is not None and newest + self.idle < watermark and not waits:
            yield from self.forget(key, state)
            newest = None
        entry["newest"] = newest

    def timed(self) -> bool:
        """Whether keys have something to do without events."""
        return bool(self.idle)

    def _wakes(self, entry: dict, waits: bool) -> list[int]:
        # a key with rows held is looked at again with them
        return [entry["newest"] + self.idle] if self.idle and not waits else []

    def without_pauses(self, rows: list[tuple]) -> Iterator[list[tuple]]:
        """Rows cut where the gap to the row before is a pause."""
        start = 0
        for i in range(1, len(rows)):
            if self.idle and rows[i][0] - rows[i - 1][0] > self.idle:
                yield rows[start:i]
                start = i
        if rows:
            yield rows[start:]

    def table(self, items: list) -> pd.DataFrame:
        return pd.DataFrame(items, columns=self.columns)

    def step(self, key, state: dict, rows: list[tuple]) -> Iterator:
        raise NotImplementedError

    def forget(self, key, state: dict) -> Iterator:
        return iter(())

    def passed(self, key, state: dict, watermark: int) -> Iterator:
        return iter(())

    def close(self) -> None:
        pass


def in_event_order(df: DataFrame, key: str, ts: str, order: list[str], fields: list[Column], watermark: str, build: Callable, output: str, buckets: int = BUCKETS) -> DataFrame:
    """Feed a processor: ``fields`` and tie breakers by key, under a watermark; rows without time never get there.

    ``order`` breaks ties of ``ts`` and has no nulls. ``buckets`` is the number of groups the keys are dealt to by hash; a
    running stream must keep it.
    """
    use_rocksdb(df.sparkSession)
    # rows reach Python as named tuples, which know no leading underscores, spaces or keywords
    made = {f"f{i}": c for i, c in enumerate(fields)} | {f"o{i}": col(c) for i, c in enumerate(order)}
    real = isinstance(df.schema[key].dataType, (T.FloatType, T.DoubleType))
    dealt = F.pmod(F.xxhash64(col(key)), F.lit(buckets)).cast("int")
    dealt = F.when(col(key).isNull(), NULL_BUCKET).when(F.isnan(col(key)) if real else F.lit(False), NAN_BUCKET).otherwise(dealt)
    kept = df.select(dealt.alias("bucket"), col(key).alias("event_key"), col(ts).cast("timestamp").alias("event_time"), *[c.alias(n) for n, c in made.items()])
    kept = kept.filter(F.col("event_time").isNotNull()).withWatermark("event_time", watermark).withColumn("at", F.unix_micros("event_time"))
    processor = build(list(made), [f"o{i}" for i in range(len(order))])
    processor.nan = real
    return kept.groupBy("bucket").transformWithStateInPandas(processor, output, "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, over the progress reports the query keeps."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


class EventWindows(EventOrdered):
    """Windows of ``size`` consecutive events, or of the events within ``seconds`` of their first one, by event time."""

    def __init__(self, *base, key: str, values: list[str], size: int, seconds: int | None, processors: list[Callable[[pd.DataFrame], pd.DataFrame]], idle: int | None):
        super().__init__(*base, [], idle)
        self.key, self.values, self.size, self.processors = key, values, size, processors
        self.span = seconds * 1_000_000 if seconds else None

    def _flush(self, key, state: dict) -> pd.DataFrame:
        number = state.get("flushed", 0)
        out = pd.DataFrame([r[1 : 1 + len(self.values)] for r in state["held"]], columns=self.values)
        state |= {"flushed": number + 1, "held": []}
        for p in self.processors:
            out = p(out)
        out.insert(0, "window", number)
        out.insert(0, self.key, key)
        return out

    def step(self, key, state: dict, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        state.setdefault("held", [])
        for row in rows:
            if state["held"] and self.span and row[0] - state["held"][0][0] >= self.span:
                yield self._flush(key, state)
            state["held"].append(row)
            if len(state["held"]) == self.size:
                yield self._flush(key, state)

    def passed(self, key, state: dict, watermark: int) -> Iterator[pd.DataFrame]:
        if self.span and state.get("held") and watermark >= state["held"][0][0] + self.span:
            yield self._flush(key, state)

    def forget(self, key, state: dict) -> Iterator[pd.DataFrame]:
        if state.get("held"):
            yield self._flush(key, state)

    def timed(self) -> bool:
        return bool(self.idle or self.span)

    def _wakes(self, entry: dict, waits: bool) -> list[int]:
        held = entry["state"].get("held")
        return super()._wakes(entry, waits) + ([held[0][0] + self.span] if self.span and held else [])

    def table(self, items: list) -> pd.DataFrame:
        return pd.concat(items, ignore_index=True)


def event_windows(
    df: DataFrame,
    key: str,
    ts: str,
    order: list[str],
    fields: list[str],
    output: str,
    size: int,
    watermark: str,
    processors: list[Callable[[pd.DataFrame], pd.DataFrame]],
    seconds: int | None = None,
    idle: int | None = None,
) -> DataFrame:
    """Stream of processed count windows in event order, the same as ``count_windows`` however late rows come.

    ``output`` is the schema of (key, window, processed columns). An open window is held; after a pause of ``idle`` seconds
    it is flushed short, and the key's numbers start again.
    """
    build = lambda *base: EventWindows(*base, key=key, values=fields, size=size, seconds=seconds, processors=processors, idle=idle)
    return in_event_order(df, key, ts, order, [col(c) for c in fields], watermark, build, output)


def trailing_z(values: np.ndarray, begin: int, window: int, min_rows: int) -> np.ndarray:
    """Largest |z| over the columns of each row from ``begin`` on, against the up to ``window`` rows before it."""
    n = values.shape[1]
    scores = np.zeros(n - begin)
    for i in range(begin, min(n, window)):
        if i >= min_rows:
            seen = values[:, :i]
            scores[i - begin] = (np.abs(values[:, i] - seen.mean(axis=1)) / (seen.std(axis=1) + 1e-8)).max()
    if window < min_rows:
        return scores
    for at in range(max(begin, window), n, 4096):
        stop = min(n, at + 4096)
        seen = np.lib.stride_tricks.sliding_window_view(values[:, at - window : stop - 1], window, axis=1)
        z = np.abs(values[:, at:stop] - seen.mean(axis=2)) / (seen.std(axis=2) + 1e-8)
        scores[at - begin : stop - begin] = z.max(axis=0)
    return scores


class TrailingScore(EventOrdered):
    """Largest |z| of each event against the last ``window`` events of its key, kept as a ring of values."""

    def __init__(self, *base, values: int, window: int, min_rows: int, idle: int | None):
        super().__init__(*base, idle)
        self.values, self.window, self.min_rows = values, window, min_rows

    def step(self, key, state: dict, rows: list[tuple]) -> Iterator[tuple]:
        past = state.get("ring", np.empty((self.values, 0)))
        fresh = np.array([[np.nan if r[2 + i] is None else r[2 + i] for r in rows] for i in range(self.values)], dtype=float)
        values = np.hstack([past, fresh])
        scores = trailing_z(values, past.shape[1], self.window, self.min_rows)
        state["ring"] = values[:, -self.window :].copy()
        yield from ((key, r[1], x) for r, x in zip(rows, scores.tolist()))


def anomaly_scores(
    df: DataFrame,
    key: str,
    row_id: str,
    columns: list[str],
    ts: str,
    order: list[str],
    watermark: str,
    window: int = 100,
    min_rows: int = 10,
    threshold: float = 3.0,
    idle: int | None = None,
) -> DataFrame:
    """Streaming twin of the trailing z-score, in event order."""
    types = {c: df.schema[c].dataType.simpleString() for c in (key, row_id)}
    output = f"{key} {types[key]}, {row_id} {types[row_id]}, score double"
    fields = [col(row_id), *[col(c).cast("double") for c in columns]]
    build = lambda *base: TrailingScore(*base, [key, row_id, "score"], values=len(columns), window=window, min_rows=min_rows, idle=idle)
    scored = in_event_order(df, key, ts, order, fields, watermark, build, output)
    return scored.withColumn("is_anomaly", (F.col("score") > threshold).cast("int"))


class LastOutcomes(EventOrdered):
    """Accuracy over the labelled events among the last N of each model, one row whenever the watermark passes events."""

    def __init__(self, *base, last: int, min_labelled: int, baseline: float, tolerance: float, idle: int | None):
        super().__init__(*base, idle)
        self.last, self.min_labelled, self.baseline, self.tolerance = last, min_labelled, baseline, tolerance

    def step(self, key, state: dict, rows: list[tuple]) -> Iterator[tuple]:
        # 1 right, 0 wrong, -1 not labelled
        state["log"] = (state.get("log", []) + [int(r[1]) for r in rows])[-self.last :]
        labelled = [x for x in state["log"] if x >= 0]
        enough = len(labelled) >= self.min_labelled
        accuracy = sum(labelled) / len(labelled) if enough else None
        alert = bool(enough and self.baseline - accuracy > self.tolerance)
        yield key, rows[-1][0], len(labelled), accuracy, alert


def live_accuracy(
    df: DataFrame,
    key: str,
    prediction: str,
    actual: str,
    ts: str,
    order: list[str],
    watermark: str,
    last: int = 100,
    min_labelled: int = 10,
    baseline: float = 1.0,
    tolerance: float = 0.1,
    idle: int | None = None,
) -> DataFrame:
    """Streaming model monitor in event order: alert when accuracy falls more than ``tolerance`` below ``baseline``.

    (key, upto, labelled, accuracy, alert): the state after the events up to ``upto`` (microseconds).
    """
    output = f"{key} {df.schema[key].dataType.simpleString()}, upto bigint, labelled bigint, accuracy double, alert boolean"
    outcome = F.when(col(actual).isNull(), F.lit(-1)).otherwise(col(prediction).eqNullSafe(col(actual)).cast("int"))
    columns = [key, "upto", "labelled", "accuracy", "alert"]
    build = lambda *base: LastOutcomes(*base, columns, last=last, min_labelled=min_labelled, baseline=baseline, tolerance=tolerance, idle=idle)
    return in_event_order(df, key, ts, order, [outcome], watermark, build, output)


class RunningFeatures(EventOrdered):
    """Events so far, and sums and averages of the values of a key, one row whenever the watermark passes events."""

    def __init__(self, *base, values: int, idle: int | None):
        super().__init__(*base, idle)
        self.values = values

    def step(self, key, state: dict, rows: list[tuple]) -> Iterator[tuple]:
        events, sums = state.get("total", (0, [0.0] * self.values))
        events += len(rows)
        sums = [s + sum(r[1 + i] or 0.0 for r in rows) for i, s in enumerate(sums)]
        state["total"] = (events, sums)
        yield key, rows[-1][0], events, *[x for s in sums for x in (s, s / events)]


def event_features(df: DataFrame, key: str, values: list[str], ts: str, order: list[str], watermark: str, idle: int | None = None) -> DataFrame:
    """Append-mode twin of ``running_features``: (key, upto, events, c_sum, c_avg); a key silent for ``idle`` seconds starts anew."""
    output = f"{key} {df.schema[key].dataType.simpleString()}, upto bigint, events bigint, " + ", ".join(f"{c}_sum double, {c}_avg double" for c in values)
    fields = [col(c).cast("double") for c in values]
    columns = [key, "upto", "events", *[f"{c}_{x}" for c in values for x in ("sum", "avg")]]
    build = lambda *base: RunningFeatures(*base, columns, values=len(values), idle=idle)
    return in_event_order(df, key, ts, order, fields, watermark, build, output)


def windowed_drift(df: DataFrame, reference: DataFrame, ts: str, duration: str, columns: list[str], threshold: float = 2.0, watermark: str | None = None) -> DataFrame:
    """(window_start, column, mean, z_score, drifted): window means against static reference statistics."""
    aggs = [x for i, c in enumerate(columns) for x in (F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}"))]
    fit = reference.agg(*aggs).first()
    means = tumbling(df, ts, duration, [], [F.avg(col(c)).alias(c) for c in columns], watermark)
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            col(c).alias("mean"),
            (F.abs(col(c) - F.lit(fit[f"m{i}"])) / (F.lit(fit[f"s{i}"]) + F.lit(1e-8))).alias("z_score"),
        )
        for i, c in enumerate(columns)
    ]
    out = means.select("window_start", F.inline(F.array(*entries)))
    return out.withColumn("drifted", F.col("z_score") > threshold)
