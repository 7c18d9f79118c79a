"""Series operators over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row


def hourly_mean(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Hourly means of stream(key, ts, value), ts a timestamp; rows later than ``late`` are left out by the watermark."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), key)
    return g.agg(F.avg("value").alias("value"), F.count("*").alias("n")).select(key, F.col("window.start").alias("ts"), "value", "n")


def storms(stream: DataFrame, key: str, gap_hours: int = 8, wet: float = 0.01, late: str = "1 hour") -> DataFrame:
    """Events of wet samples; a new one starts after a gap of more than ``gap_hours`` hours."""
    g = stream.where(F.col("value") > wet).withWatermark("ts", late).groupBy(F.session_window("ts", f"{gap_hours} hours"), key)
    return g.agg(F.sum("value").alias("wet_depth"), F.max("value").alias("peak"), F.count("*").alias("wet_hours"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time")).drop("session_window")


def running_peak(stream: DataFrame, key: str) -> DataFrame:
    """Largest value so far of each key, in update mode."""
    return stream.groupBy(key).agg(F.max("value").alias("peak_value"), F.count("*").alias("n_values"))


def route(stream: DataFrame, key: str, ratio: float, low: float, high: float, initial: float) -> DataFrame:
    """Storage routing, outflow = ratio * storage, with (storage, outflow, inflow before) kept as state for each key.

    Rows of one batch are taken in order of ts; the source must deliver a key's hours in order across batches.
    """
    import pandas as pd

    kind = dict(stream.dtypes)[key]

    def run(name, frames, state: GroupState):
        pdf = pd.concat(list(frames)).sort_values("ts")
        rows = []
        held = state.get if state.exists else None
        for ts, q in zip(pdf["ts"], pdf["value"]):
            if held is None:
                held = (initial, ratio * low, float(q))
            else:
                s = min(max(held[0] + held[2] - held[1], low), high)
                held = (s, ratio * s, float(q))
            rows.append((name[0], ts, held[1], held[0]))
        state.update(held)
        yield pd.DataFrame(rows, columns=[key, "ts", "value", "storage"])

    return stream.select(key, "ts", "value").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, value double, storage double", "s double, q double, i double", "append", GroupStateTimeout.NoTimeout)


class OrderedRouting(StatefulProcessor):
    """Holds a key's samples until the watermark has passed them, then routes them in order of time.

    Waiting samples lie in a map by their time, with a timer each, so a batch touches only those that are due; the state
    that routing carries is one row a key.
    """

    def __init__(self, key: str, ratio: float, low: float, high: float, initial: float):
        self.key, self.ratio, self.low, self.high, self.initial = key, ratio, low, high, initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", "s double, q double, i double, ts long")
        self.waiting = handle.getMapState("waiting", "ms long", "inflows array<double>")

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        new: dict[int, list] = {}
        for r in rows:
            ms = r["ms"]
            if ms > mark:
                new.setdefault(ms, []).append(r["value"])
        for ms, inflows in new.items():
            if self.waiting.containsKey((ms,)):
                inflows = list(self.waiting.getValue((ms,))[0]) + inflows
            else:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), (inflows,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ms = expiredTimerInfo.getExpiryTimeInMs()
        inflows = sorted(self.waiting.getValue((ms,))[0])
        self.waiting.removeKey((ms,))
        held = self.carried.get() if self.carried.exists() else None
        if held is not None and held[3] > ms:
            raise RuntimeError(f"timers of {key} came out of order: {ms} after {held[3]}")
        for inflow in inflows:
            if held is None:
                held = (self.initial, self.ratio * self.low, inflow, ms)
            else:
                s = min(max(held[0] + held[2] - held[1], self.low), self.high)
                held = (s, self.ratio * s, inflow, ms)
            yield Row(**{self.key: key[0], "ms": ms, "value": held[1], "storage": held[0]})
        self.carried.update(tuple(held))

    def close(self) -> None:
        pass


def route_ordered(stream: DataFrame, key: str, ratio: float, low: float, high: float, initial: float, late: str = "1 hour") -> DataFrame:
    """``route`` for samples that come in any order: key, ts, value (outflow), storage, each once the watermark has passed its ts.

    Rows later than ``late`` are left out, rows without a time or value too; samples of one time are taken by size, as in
    batch routing. Times count in milliseconds. Needs the RocksDB state store (``state_store``).
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.where("ts is not null and value is not null").select(key, "ts", F.unix_millis("ts").alias("ms"), F.col("value").cast("double").alias("value")).withWatermark("ts", late)
    out = rows.groupBy(key).transformWithState(OrderedRouting(key, ratio, low, high, initial), f"{key} {kind}, ms long, value double, storage double", "Append", "EventTime")
    return out.select(key, F.timestamp_millis("ms").alias("ts"), "value", "storage")


def state_store(spark) -> None:
    """Sets the state store that timers and maps need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
