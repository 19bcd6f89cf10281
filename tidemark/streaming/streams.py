"""Structured Streaming forms of the keyed operators; each gives what its batch form gives over the same rows."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..sources.shared import shared_path, written


def read_ticks(spark: SparkSession, folder: str, names: str = "events.parquet", files: int = 8, usable: bool = True) -> DataFrame:
    """A stream of ticks from the Parquet files of a folder that have such names; only usable values pass, or every row."""
    schema = spark.read.parquet(f"{folder}/{names}").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).parquet(folder)
    rows = raw.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    return rows if not usable else rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > 0))


def stamped(ticks: DataFrame, seconds: int = 60, delay: str = "2 minutes") -> DataFrame:
    """Bars are known when they close: time plus a minute, on which the watermark stands."""
    return ticks.withColumn("closed_at", F.timestamp_add("SECOND", F.lit(seconds), "ts")).withWatermark("closed_at", delay)


def once(ticks: DataFrame) -> DataFrame:
    """The first row of each (symbol, time) within the watermark."""
    return ticks.dropDuplicatesWithinWatermark(["symbol", "ts"])


def windowed(ticks: DataFrame, length: str) -> DataFrame:
    """Rows and mean value per symbol and tumbling window, when the watermark has passed its end."""
    g = ticks.groupBy("symbol", F.window("closed_at", length).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max_by("value", "ts").alias("close"))
    return g.select("symbol", F.col("w.start").alias("start"), "n", "mean", "close")


def fold_stream(rows: DataFrame, key: str, key_type: str, order: list[str], step: Callable[[dict, object], tuple], schema: str) -> DataFrame:
    """An ordered fold by key whose state lives in the state store between batches; rows of a batch are ordered, and batches
    are taken to be in order."""
    names = rows.columns
    more = [c.split()[0] for c in schema.split(",")][len(names) :]

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pickle.loads(state.get[0]) if state.exists else {}
        group = pd.concat(list(batches)).sort_values(order, kind="mergesort").reset_index(drop=True)
        out = [step(own, r) for r in group[names].itertuples(index=False)]
        state.update((pickle.dumps(own),))
        yield pd.concat([group[names], pd.DataFrame(out, columns=more)], axis=1)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "own binary", "append", GroupStateTimeout.NoTimeout)


#: The state store of stateful processors: state of many keys lies on disk, changes go to the checkpoint.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _drained(stream: DataFrame, name: str) -> str:
    spark = stream.sparkSession
    out, was = shared_path(spark, name), spark.conf.get(STORE[0])
    try:
        spark.conf.set(*STORE)
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, f"{name}-progress")).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE[0], was)
    run.awaitTermination()
    return out


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what there is, into a table with exactly-once batches, and read the table."""
    out = _drained(stream, name)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def staged(stream: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """A stream over the table that another stream is drained into, for a step that may not follow it in one query; so many
    files a batch, in the order they were written, where ``files`` says so."""
    out = _drained(stream, name)
    reader = stream.sparkSession.readStream.schema(stream.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(out)


def fanned(stream: DataFrame, table: DataFrame, on: str, name: str) -> DataFrame:
    """A stream joined with a static table. The table is written once, not computed anew for every batch, and merged: a hash
    table would go through the driver with each batch, in pages of tens of MB however few its rows are."""
    return stream.join(written(table, name).hint("merge"), on)


def bars(ticks: DataFrame, length: str = "1 hour") -> DataFrame:
    """Bars (symbol, ts, open, high, low, close, volume) of stamped ticks, each when the watermark has passed its end."""
    g = ticks.groupBy("symbol", F.window("closed_at", length).alias("w")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


class KeyedSteps(StatefulProcessor):
    """An ordered fold by key on a state store: ``step`` of a dict of numbers and lists of numbers, and a row.

    Numbers are a map state, lists (the rings of windows, arrays of filters) a list state of named values: nothing that is
    stored depends on the code's classes. A batch's rows of a key are put in order, so the source's trigger has to bound a
    batch; state is read once and written once a key and batch. Rows of a table given as initial state are stepped through without output before the
    first live row: a warm-up by history.
    """

    def __init__(self, order: list[str], step: Callable[[dict, object], tuple | None], columns: list[str], more: list[str]) -> None:
        self.order, self.step, self.columns, self.more = order, step, columns, more

    def init(self, handle) -> None:
        self.numbers = handle.getMapState("numbers", "name string", "value double")
        self.lists = handle.getListState("lists", "name string, value double")

    def _read(self) -> dict:
        state = {k[0]: v[0] for k, v in self.numbers.iterator()} if self.numbers.exists() else {}
        for name, value in self.lists.get():
            state.setdefault(name, []).append(value)
        return state

    def _write(self, state: dict) -> None:
        flat = [(k, float(v)) for k, x in state.items() if isinstance(x, (list, tuple, np.ndarray)) for v in x]
        for k, v in state.items():
            if not isinstance(v, (list, tuple, np.ndarray)):
                self.numbers.updateValue((k,), (float(v),))
        self.lists.put(flat) if flat else self.lists.clear()

    def _stepped(self, frames: Iterator[pd.DataFrame], state: dict) -> Iterator[pd.DataFrame]:
        # Spark gives a key's rows of a batch in no order
        frame = pd.concat(list(frames)).sort_values(self.order, kind="mergesort")[self.columns]
        for low in range(0, len(frame), 10_000):
            part = frame.iloc[low : low + 10_000]
            found = [(i, out) for i, row in enumerate(part.itertuples(index=False)) if (out := self.step(state, row)) is not None]
            kept = part.iloc[[i for i, _ in found]].reset_index(drop=True)
            yield pd.concat([kept, pd.DataFrame([out for _, out in found], columns=self.more, dtype=None if found else object)], axis=1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._read()
        yield from self._stepped(rows, state)
        self._write(state)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        state = self._read()
        for _ in self._stepped(iter([initialState]), state):
            pass
        self._write(state)

    def close(self) -> None:
        pass


def keyed_steps(rows: DataFrame, key: str, order: list[str], step: Callable[[dict, object], tuple | None], schema: str, history: DataFrame | None = None) -> DataFrame:
    """``step`` over a stream's rows by key, its state in a store between batches; ``schema`` begins with the columns of rows.

    ``history`` has the same columns: its rows move the state before the stream's and give no output. Rows for which the step
    gives None have none either. Batches are taken to be in order.
    """
    names = rows.columns
    more = [c.split()[0] for c in schema.split(",")][len(names) :]
    processor = KeyedSteps(order, step, names, more)
    start = history.select(*names).groupBy(key) if history is not None else None
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "None", start)


def drain_batches(stream: DataFrame, name: str) -> DataFrame:
    """As ``drain``, by foreachBatch: each batch overwrites its own partition, so a repeated batch changes nothing."""
    spark = stream.sparkSession
    out = shared_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = stream.writeStream.foreachBatch(put).option("checkpointLocation", shared_path(spark, f"{name}-progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


class LateCounter:
    """Whether a row is older than, or equal to, the newest of its key before it; a row without a time is neither."""

    def step(self, state: dict, ts) -> tuple[bool, bool]:
        newest = state.get("newest")
        if pd.isna(ts):
            return False, False
        state["newest"] = ts if newest is None or ts > newest else newest
        return newest is not None and ts < newest, newest is not None and ts == newest


class SilenceAlarms(StatefulProcessor):
    """An alarm while a key is silent: a timer in event time is set with every row and goes off when the watermark passes it.

    A key that is never heard again is told too, as long as others move the watermark. What is told does not depend on how
    rows fall into batches: a row that comes more than the limit after the one before tells that silence itself, if the
    timer has not. Rows older than the newest of their key say nothing.
    """

    def __init__(self, limit: float) -> None:
        self.limit = int(limit * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "millis long, told boolean")

    def _alarms(self, key, since: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(since), "since": since, "told_at": since + self.limit})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Silences inside a batch are gaps of its sorted times; only the newest one needs a timer, so the store is called a
        few times a key and batch, whatever the rows."""
        newest, told = self.newest.get() if self.newest.exists() else (None, False)
        millis = np.unique(np.concatenate([frame["millis"].to_numpy(dtype="int64") for frame in rows]))
        if newest is not None:
            millis = millis[millis > newest]
        if not len(millis):
            return
        before = millis[:-1] if newest is None or told else np.concatenate([[newest], millis[:-1]])
        after = millis[len(millis) - len(before) :]
        if newest is not None and not told:
            self.handle.deleteTimer(newest + self.limit)
        self.handle.registerTimer(int(millis[-1]) + self.limit)
        self.newest.update((int(millis[-1]), False))
        silent = before[after > before + self.limit]
        if len(silent):
            yield self._alarms(key, silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, told = self.newest.get()
        if not told and expiredTimerInfo.getExpiryTimeInMs() == newest + self.limit:
            self.newest.update((newest, True))
            yield self._alarms(key, np.array([newest], dtype="int64"))

    def close(self) -> None:
        pass


def silence_alarms(rows: DataFrame, key: str, limit: float) -> DataFrame:
    """(key, since, told_at) in milliseconds: silences of more than ``limit`` seconds of a stream (key, ts), which has a watermark on ts."""
    own = rows.select(F.col(key).cast("string").alias("key"), "ts", F.unix_millis("ts").alias("millis"))
    return own.groupBy("key").transformWithStateInPandas(SilenceAlarms(limit), "key string, since long, told_at long", "Append", "EventTime")


class SessionBasket:
    """A basket's spread when the closes of all its members are in: log of the target less the mean log of the peers, its z by a
    fit that is frozen, and the position that a z beyond k sets until the other side does. Days before ``live_from`` move the
    state and give no rows."""

    def __init__(self, members: int, mean: float, deviation: float, k: float, live_from=None) -> None:
        self.members, self.mean, self.deviation, self.k, self.live_from = members, mean, deviation, k, live_from

    def step(self, state: dict, day, is_target: bool, close: float) -> tuple[float | None, int | None, bool | None]:
        open_days = state.setdefault("days", {})
        own = open_days.setdefault(day, [0, 0.0, 0.0])
        own[0] += 1
        own[1 if is_target else 2] += math.log(close)
        if own[0] < self.members:
            return None, None, None
        del open_days[day]
        z = round((own[1] - own[2] / (self.members - 1) - self.mean) / self.deviation, 6)
        before = state.get("position", 0)
        state["position"] = 1 if z < -self.k else -1 if z > self.k else before
        if self.live_from is not None and day < self.live_from:
            return None, None, None
        return z, state["position"], state["position"] != before
