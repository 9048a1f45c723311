"""Stream operators with state by key and event-time timers.

Each key has at most one timer, at its next moment; when that moves, the old one
is deleted.  A timer fires when the watermark has passed its moment, so nothing
has to arrive on a key for its tones to become orphans or its state to go.  State
lives in the RocksDB store, outside the executors' heap.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from . import book as _book
from .book import Book, Slot

# Processors are first loaded by a process that does not see the files shipped to executors, so they carry their code.
register_pickle_by_value(_book)
register_pickle_by_value(sys.modules[__name__])

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_store(spark: SparkSession):
    """Queries started within use the RocksDB state store."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def _sorted(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(["ts_ms", "call_id"], kind="stable", ignore_index=True)


class _Timed(StatefulProcessor):
    """One timer a key, kept in state beside it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at bigint")

    def set_timer(self, moment: int | None) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == moment:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if moment is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(moment)
            self.timer.update((moment,))

    def close(self) -> None:
        pass


class ToneBook(_Timed):
    """A set of linked channels: pending tones, their successors and parked short calls, by channel."""

    def __init__(self, columns: list[str], **settings):
        self.columns, self.settings = columns, settings

    def init(self, handle) -> None:
        super().init(handle)
        slot = "calls array<bigint>, first bigint, last bigint, locked boolean"
        self.now = handle.getMapState("now", "channel bigint", slot)
        self.following = handle.getMapState("following", "channel bigint", slot)
        self.parked = handle.getMapState("parked", "channel bigint", "call bigint, came bigint")

    def _load(self) -> Book:
        slots = [{int(k[0]): Slot([int(c) for c in v[0]], int(v[1]), int(v[2]), bool(v[3])) for k, v in state.iterator()} for state in (self.now, self.following)]
        return Book(**self.settings, now=slots[0], following=slots[1], parked={int(k[0]): (int(v[0]), int(v[1])) for k, v in self.parked.iterator()})

    def _store(self, book: Book) -> None:
        for state, held in ((self.now, book.now), (self.following, book.following)):
            state.clear()
            for channel, s in held.items():
                state.updateValue((channel,), (s.calls, s.first, s.last, s.locked))
        self.parked.clear()
        for channel, waiting in book.parked.items():
            self.parked.updateValue((channel,), waiting)
        self.set_timer(book.due())

    def _rows(self, key: tuple, settled: list) -> pd.DataFrame:
        return pd.DataFrame([(*key, *s) for s in settled], columns=self.columns).astype({"voice_call": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        book, out = self._load(), []
        for r in _sorted(rows).itertuples():
            out += book.settle(r.kind, int(r.channel), int(r.call_id), int(r.ts_ms), float(r.voice_s))
        self._store(book)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        book = self._load()
        out = book.passed(expiredTimerInfo.getExpiryTimeInMs() + 1)
        self.timer.clear()  # it has fired
        self._store(book)
        yield self._rows(key, out)


def tone_book(stream: DataFrame, keys: list[str], delay: str = "0 seconds", **settings) -> DataFrame:
    """keys, kind, tone_call, voice_call, at_ms: how each call's tones ended.

    ``stream``: keys (of a set of linked channels), channel, kind (tone, lock or
    voice), call_id, ts_ms, at (its timestamp) and voice_s.  Rows later than
    ``delay`` behind the newest are dropped.  ``settings``: those of `Book`.
    """
    kinds = dict(stream.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", kind string, tone_call bigint, voice_call bigint, at_ms bigint"
    rows = stream.select(*keys, "channel", "kind", "call_id", "ts_ms", "voice_s", "at").withWatermark("at", delay)
    columns = [*keys, "kind", "tone_call", "voice_call", "at_ms"]
    return rows.groupBy(*keys).transformWithStateInPandas(ToneBook(columns, **settings), out, "Append", "eventTime")


class LastArrival(_Timed):
    """A key's last arrival, kept for a time to live after it."""

    def __init__(self, columns: list[str], window_ms: int, ttl_ms: int):
        self.columns, self.window_ms, self.ttl_ms = columns, window_ms, ttl_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0]) if self.last.exists() else None
        out = []
        for r in _sorted(rows).itertuples():
            if last is not None and r.ts_ms - last > self.ttl_ms:
                out.append((*key, "evicted", None, last))
                last = None
            out.append((*key, "duplicate" if last is not None and r.ts_ms - last <= self.window_ms else "first", r.call_id, r.ts_ms))
            last = int(r.ts_ms) if last is None else max(last, int(r.ts_ms))
        self.last.update((last,))
        self.set_timer(last + self.ttl_ms + 1)
        yield self._rows(out)

    def _rows(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.columns).astype({"call_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0])
        self.last.clear()
        self.timer.clear()
        yield self._rows([(*key, "evicted", None, last)])


def arrivals(stream: DataFrame, keys: list[str], window_ms: int, delay: str = "0 seconds", least_ttl_ms: int = 60_000) -> DataFrame:
    """keys, kind, call_id, ts_ms: each arrival as `first` or `duplicate` (within the window of the key's last one), and `evicted` with the last arrival's time where a key's state went.

    State goes when twice the window, or the least time to live, has passed since the last arrival.
    """
    kinds = dict(stream.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", kind string, call_id bigint, ts_ms bigint"
    rows = stream.select(*keys, "call_id", "ts_ms", "at").withWatermark("at", delay)
    processor = LastArrival([*keys, "kind", "call_id", "ts_ms"], window_ms, max(2 * window_ms, least_ttl_ms))
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "eventTime")


class Lockout(_Timed):
    """A key's failures in a row, and until when it is blocked."""

    def __init__(self, columns: list[str], most: int, block_ms: int):
        self.columns, self.most, self.block_ms = columns, most, block_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.record = handle.getValueState("record", "failures bigint, until bigint, last bigint")

    def _keep(self, failures: int, until: int | None, last: int) -> None:
        """A key without failures has no state; one whose block is over loses it two block times after its last attempt."""
        if failures:
            self.record.update((failures, until if until is not None else -1, last))
            self.set_timer(max(until, last + 2 * self.block_ms) + 1 if until is not None else None)
        else:
            self.record.clear()
            self.set_timer(None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures, until, last = self.record.get() if self.record.exists() else (0, -1, 0)
        failures, until, out = int(failures), None if until < 0 else int(until), []
        for r in _sorted(rows).itertuples():
            if until is not None and r.ts_ms > until:
                failures, until = 0, None
            blocked = until is not None
            last = int(r.ts_ms)
            if not blocked and r.failed:
                failures += 1
                until = last + self.block_ms if failures >= self.most else None
            elif not blocked:
                failures = 0
            out.append((*key, r.call_id, blocked, until - last if blocked else 0))
        self._keep(failures, until, last)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.record.clear()
        self.timer.clear()
        yield pd.DataFrame([], columns=self.columns)


def lockouts(stream: DataFrame, keys: list[str], most: int, block_ms: int, delay: str = "0 seconds") -> DataFrame:
    """keys, call_id, blocked, left_ms: for each attempt whether it met a block, and how much of that was left.

    ``most`` failures without a success between block a key for ``block_ms`` after the
    last of them; a blocked attempt is turned away and counts for nothing.
    """
    kinds = dict(stream.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", call_id bigint, blocked boolean, left_ms bigint"
    rows = stream.select(*keys, "call_id", "ts_ms", "failed", "at").withWatermark("at", delay)
    return rows.groupBy(*keys).transformWithStateInPandas(Lockout([*keys, "call_id", "blocked", "left_ms"], most, block_ms), out, "Append", "eventTime")
