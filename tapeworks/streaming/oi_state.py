"""Open interest as keyed state: a symbol's readings of the last 150 minutes, its day's baseline, and its last structure and label.

Each sample gets what the batch operators give it, from the state alone; no history is read.  A symbol's samples are taken in
the order of time within a batch.  The kept readings are dropped by the samples' own time, not the clock's, so that a history
that is replayed gives the same; a symbol's state never holds more than 150 minutes of readings and two rows.  A sample
that is older than one that its symbol has had comes too late for the state, which has moved on: it gets a row without changes (null labels) and leaves the state alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeworks.operators.oi import ACCELERATING, FLAT_PCT, KEPT_MINUTES, LEAVING

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = (
    "symbol string, ts timestamp_ntz, oi double, close double, chg_15 double, chg_30 double, chg_60 double, prior_30 double, prior_60 double, accel double, accel_label string, trend_label string, "
    "price_chg_today double, oi_chg_today double, oi_day_chg double, structure string, stage string, break_signal string, accel_event boolean, kept int"
)


def pct(now: float | None, before: float | None) -> float | None:
    return None if now is None or before is None or before == 0 else (now - before) / before * 100


def label_of(accel: float | None) -> str | None:
    if accel is None:
        return None
    steps = ((accel > 2, ACCELERATING[0]), (accel >= 0.5, ACCELERATING[1]), (accel >= -0.3, "Stable"), (accel >= -2, "Weakening"), (True, LEAVING))
    return next(name for on, name in steps if on)


def structure_of(price: float | None, oi: float | None) -> str | None:
    if price is None or oi is None:
        return None
    way = lambda x: (x > FLAT_PCT) - (x < -FLAT_PCT)
    return {(1, 1): "Long Buildup", (-1, 1): "Short Buildup", (1, -1): "Short Covering", (-1, -1): "Long Unwinding"}.get((way(price), way(oi)), "Neutral")


class Symbol:
    """The state of a symbol; ``take`` moves it on by one sample."""

    def __init__(self, readings: list[tuple], day: tuple | None, last: tuple | None):
        self.readings, self.day, self.last = readings, day, last  # (ts, oi); (date, oi, close, prev, last oi); (ts, structure, label)

    def at(self, ts: dt.datetime, minutes: int) -> float | None:
        return next((oi for when, oi in reversed(self.readings) if when <= ts - dt.timedelta(minutes=minutes)), None)

    def take(self, ts: dt.datetime, oi: float | None, close: float | None) -> tuple:
        if self.last and ts < self.last[0]:
            return (*[None] * 6, "New", *[None] * 7, False, len(self.readings))
        self.readings = [r for r in self.readings if r[0] >= ts - dt.timedelta(minutes=KEPT_MINUTES)]
        then = {n: self.at(ts, n) for n in (15, 30, 60, 120)}
        change = {n: pct(oi, then[n]) for n in (15, 30, 60)}
        prior = pct(then[30], then[60]), pct(then[60], then[120])
        accel = None if change[30] is None or prior[0] is None else change[30] - prior[0]
        label = label_of(accel)
        if self.day is None or self.day[0] != ts.date():
            if oi is not None and close is not None:
                self.day = (ts.date(), oi, close, self.day and self.day[4], oi)
        elif oi is not None:
            self.day = (*self.day[:4], oi)
        own = self.day if self.day and self.day[0] == ts.date() and oi is not None and close is not None else None
        today = (pct(close, own[2]), pct(oi, own[1]), pct(oi, own[3])) if own else (None, None, None)
        structure = structure_of(*today[:2])
        _, structure_before, label_before = self.last or (None, None, None)
        fast = label in ACCELERATING
        stage = "New" if structure_before and structure and structure != structure_before else None
        broken = {"Long Buildup": "Break Up", "Short Buildup": "Break Down"}.get(structure) if fast else None
        event = fast and label_before not in ACCELERATING
        self.last = (ts, structure or structure_before, label or label_before)
        if oi is not None:
            self.readings.append((ts, oi))
        return (change[15], change[30], change[60], *prior, accel, label or "New", label, *today, structure, stage, broken, event, len(self.readings))


class OpenInterest(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.readings = handle.getListState("readings", "ts timestamp_ntz, oi double")
        self.day = handle.getValueState("day", "date date, oi double, close double, prev double, last double")
        self.last = handle.getValueState("last", "ts timestamp_ntz, structure string, label string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        day, last = (state.get() if state.exists() else None for state in (self.day, self.last))
        own = Symbol([tuple(r) for r in self.readings.get()], day and tuple(day), last and tuple(last))
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = []
        for ts, oi, close in zip(batch.ts.dt.to_pydatetime(), batch.oi, batch.close):
            oi, close = (None if pd.isna(x) else float(x) for x in (oi, close))
            *changes, trend, label, price, today, since, structure, stage, broken, event, kept = own.take(ts, oi, close)
            out.append((key[0], ts, oi, close, *changes, label, trend, price, today, since, structure, stage, broken, event, kept))
        self.readings.put(own.readings) if own.readings else self.readings.clear()
        if own.day:
            self.day.update(own.day)
        if own.last:
            self.last.update(own.last)
        names = [c.split()[0] for c in STATE.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({n: "float64" for n, k in (c.split() for c in STATE.split(", ")) if k == "double"})

    def close(self) -> None:
        pass


def oi_state_stream(samples: DataFrame) -> DataFrame:
    """A stream of samples (symbol, ts, oi, close) with the columns of the batch state, and kept: the readings that the state holds."""
    own = samples.select("symbol", "ts", "oi", "close").groupBy("symbol")
    return own.transformWithStateInPandas(OpenInterest(), outputStructType=STATE, outputMode="Update", timeMode="None")
