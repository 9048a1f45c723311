"""Stateful stream operators: arrival duplicates, cooldowns, pending tones.

All keep their state by channel and sort a micro-batch's rows of a channel by
time; a row older than what the state has seen is handled when it comes, as the
arrival it is.  State is bounded: a few numbers a channel, except the claimed
calls of pending tones, which are one set of tones and one waiting successor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def in_time_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(parts), ignore_index=True)
    return rows.sort_values(["ts_ms", "call_id"], kind="stable", ignore_index=True)


def arrival_duplicates(stream: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """Marks calls that follow their channel's last one within the window; each arrival moves the clock, duplicate or not."""
    kinds = dict(stream.dtypes)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows, marks = in_time_order(parts), []
        for ts in rows["ts_ms"].tolist():
            marks.append(last is not None and ts - last <= window_ms)
            last = ts
        state.update((last,))
        yield pd.DataFrame({**{k: v for k, v in zip(keys, [[x] * len(rows) for x in key])}, "call_id": rows["call_id"], "duplicate": marks})

    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", call_id bigint, duplicate boolean"
    return stream.groupBy(*keys).applyInPandasWithState(run, out, "last bigint", "append", GroupStateTimeout.NoTimeout)


def cooldown(stream: DataFrame, keys: list[str], cooldown_ms: int) -> DataFrame:
    """The calls that fire: those at least the cooldown after their channel's last one that did."""
    kinds = dict(stream.dtypes)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows, fired = in_time_order(parts), []
        for ts, call in zip(rows["ts_ms"].tolist(), rows["call_id"].tolist()):
            if last is None or ts - last >= cooldown_ms:
                last = ts
                fired.append(call)
        state.update((last,))
        yield pd.DataFrame({**{k: v for k, v in zip(keys, [[x] * len(fired) for x in key])}, "call_id": fired})

    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", call_id bigint"
    return stream.groupBy(*keys).applyInPandasWithState(run, out, "last bigint", "append", GroupStateTimeout.NoTimeout)


class Pending:
    """A channel's pending tones: calls with tones that wait for the voice call that follows.

    Tones within ``window_ms`` of the pending ones join them; later ones replace
    them.  A voice call no earlier than the tones and within the window takes
    them; voice later than that finds them expired.
    """

    def __init__(self, window_ms: int, tones: list[int] | None = None, first_ms: int = 0, last_ms: int = 0):
        self.window_ms, self.tones, self.first_ms, self.last_ms = window_ms, tones or [], first_ms, last_ms

    def tone(self, call: int, ts: int) -> list[int]:
        """Adds a call's tones; returns the calls whose tones it replaced, which stay without voice."""
        lost: list[int] = []
        if self.tones and ts - self.last_ms > self.window_ms:
            lost, self.tones = self.tones, []
        if not self.tones:
            self.first_ms = ts
        self.tones.append(call)
        self.last_ms = ts
        return lost

    def voice(self, ts: int) -> list[int]:
        """The calls whose tones a voice call takes."""
        if not self.tones or ts < self.first_ms or ts - self.last_ms > self.window_ms:
            return []
        taken, self.tones = self.tones, []
        return taken


def pending_tones(stream: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """tone_call, voice_call for each tone call that a voice call took; ``stream`` has has_tones."""
    kinds = dict(stream.dtypes)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Pending(window_ms, [int(x) for x in state.get[0].split(",") if x], *state.get[1:]) if state.exists else Pending(window_ms)
        rows, out = in_time_order(parts), []
        for call, ts, tones in zip(rows["call_id"].tolist(), rows["ts_ms"].tolist(), rows["has_tones"].tolist()):
            if tones:
                held.tone(call, ts)
            else:
                out += [(tone, call) for tone in held.voice(ts)]
        state.update((",".join(map(str, held.tones)), held.first_ms, held.last_ms))
        yield pd.DataFrame([(*key, a, b) for a, b in out], columns=[*keys, "tone_call", "voice_call"])

    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", tone_call bigint, voice_call bigint"
    return stream.groupBy(*keys).applyInPandasWithState(run, out, "tones string, first_ms bigint, last_ms bigint", "append", GroupStateTimeout.NoTimeout)


def monitor(stream: DataFrame, keys: list[str], quiet_ms: int) -> DataFrame:
    """start_ms, end_ms of each silence of a channel longer than ``quiet_ms``, reported when it ends."""
    kinds = dict(stream.dtypes)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for ts in in_time_order(parts)["ts_ms"].tolist():
            if last is not None and ts - last > quiet_ms:
                out.append((*key, last, ts))
            last = ts if last is None else max(last, ts)
        state.update((last,))
        yield pd.DataFrame(out, columns=[*keys, "start_ms", "end_ms"])

    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", start_ms bigint, end_ms bigint"
    return stream.groupBy(*keys).applyInPandasWithState(run, out, "last bigint", "append", GroupStateTimeout.NoTimeout)
