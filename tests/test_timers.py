"""Operators with timers over several micro-batches, against a simulator with an event queue."""

import collections
import heapq
import random

import pytest
from pyspark.sql import functions as F

from beaconframe.streaming import timers
from beaconframe.streaming.sources import run_timed

SECOND = 1_000
LINKS = {1: {2}, 2: {1}}


def simulate(rows):
    """Each thing that happens is an entry of one queue; timers carry the anchor that they were set for."""
    queue = [(ts, 0, call, ("row", kind, channel, call, voice)) for channel, kind, call, ts, voice in rows]
    heapq.heapify(queue)
    pending, successor, short, out = {}, {}, {}, []

    def take(channel, voice_ts):
        own = pending.get(channel)
        if own and own["first"] <= voice_ts <= own["anchor"] + 120 * SECOND:
            return channel
        for other in sorted(pending):
            if channel in LINKS.get(other, ()) and pending[other]["first"] <= voice_ts <= pending[other]["anchor"] + 30 * SECOND:
                return other
        return None

    def give(channel, call, voice_ts, now):
        source = take(channel, voice_ts)
        if source is not None:
            out.extend(("attached", c, call, now) for c in pending.pop(source)["calls"])
            if source in successor:
                pending[source] = successor.pop(source)
                heapq.heappush(queue, (pending[source]["anchor"] + 60 * SECOND, 2, 0, ("orphan", source, pending[source]["anchor"])))

    while queue:
        now, _, _, (what, *more) = heapq.heappop(queue)
        if what == "short":
            channel, call, came = more
            if short.get(channel) == (call, came):
                del short[channel]
                give(channel, call, came, now)
        elif what == "orphan":
            channel, anchor = more
            if channel in pending and pending[channel]["anchor"] == anchor:
                out.extend(("orphan", c, None, now) for c in pending.pop(channel)["calls"])
                out.extend(("dropped", c, None, now) for c in successor.pop(channel, {"calls": []})["calls"])
                short.pop(channel, None)
        elif more[0] == "tone":
            _, channel, call, _ = more
            shelf = successor if channel in pending and pending[channel]["locked"] else pending
            held = shelf.setdefault(channel, {"calls": [], "first": now, "anchor": now, "locked": False})
            held["calls"].append(call)
            held["anchor"] = now
            if shelf is pending:
                heapq.heappush(queue, (now + 60 * SECOND, 2, 0, ("orphan", channel, now)))
        elif more[0] == "lock":
            if more[1] in pending:
                pending[more[1]]["locked"] = True
        else:
            _, channel, call, voice = more
            if voice >= 5:
                short.pop(channel, None)
                give(channel, call, now, now)
            elif take(channel, now) is not None:
                short[channel] = (call, now)
                heapq.heappush(queue, (now + 15 * SECOND, 1, 0, ("short", channel, call, now)))
    return out


def made_up(seed, n=400):
    rng = random.Random(seed)
    rows, ts = [], 0
    for call in range(n):
        ts += rng.choice([1, 2, 3, 7, 13, 29, 41, 67]) * SECOND + rng.randrange(1, 999)
        kind = rng.choices(["tone", "lock", "voice"], [4, 1, 3])[0]
        rows.append((rng.choice([1, 1, 1, 2, 3]), kind, call, ts, rng.choice([1.0, 2.0, 9.0])))
    return rows


def as_stream(spark, rows, folder, batches):
    """The rows in files of consecutive rows, one file a micro-batch, in order."""
    step = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * step : (i + 1) * step], "channel bigint, kind string, call_id bigint, ts_ms bigint, voice_s double").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("channel bigint, kind string, call_id bigint, ts_ms bigint, voice_s double").option("maxFilesPerTrigger", 1).parquet(folder).withColumn("at", F.timestamp_millis("ts_ms")).withColumn("book", F.when(F.col("channel") == 2, 1).otherwise(F.col("channel")).cast("bigint"))


@pytest.mark.parametrize("batches", [1, 5])
def test_tone_book(spark, tmp_path, batches):
    rows = made_up(batches)
    end = rows[-1][3] + 10 * 60 * SECOND
    rows.append((9, "lock", 10_000, end, 0.0))  # shows that all moments before it have passed
    got = run_timed(timers.tone_book(as_stream(spark, rows, f"{tmp_path}/in", batches), ["book"], links=LINKS)).collect()
    want = simulate(rows)
    assert {k for k, *_ in want} == {"attached", "orphan", "dropped"}
    assert collections.Counter((r.kind, r.tone_call, r.voice_call, r.at_ms) for r in got) == collections.Counter(want)


def test_timers_fire_without_a_row_of_their_key(spark, tmp_path):
    rows = [(1, "tone", 1, SECOND, 0.0), (3, "voice", 2, 200 * SECOND, 9.0)]
    got = run_timed(timers.tone_book(as_stream(spark, rows, f"{tmp_path}/in", 2), ["book"], links=LINKS)).collect()
    assert [tuple(r) for r in got] == [(1, "orphan", 1, None, 61 * SECOND)]


def test_state_goes(spark, tmp_path):
    """Every arrival is marked, whenever the key's state went; and it goes only after its time."""
    rows = [(c, k, i, ts * 40, v) for c, k, i, ts, v in made_up(7, 120)]
    got = run_timed(timers.arrivals(as_stream(spark, rows, f"{tmp_path}/in", 4), ["channel"], 30 * 60 * SECOND)).collect()
    last, marks, gone = {}, [], []
    for channel, _, call, ts, _ in rows:
        gap = ts - last[channel] if channel in last else None
        marks.append((channel, "duplicate" if gap is not None and gap <= 1_800_000 else "first", call, ts))
        if gap is not None and gap > 3_600_000:
            gone.append((channel, "evicted", None, last[channel]))
        last[channel] = ts
    newest = rows[-1][3]
    gone += [(c, "evicted", None, t) for c, t in last.items() if newest - t > 3_600_000]
    assert gone and any(m[1] == "duplicate" for m in marks)
    assert collections.Counter(map(tuple, got)) == collections.Counter(marks + gone)


def test_lockouts(spark, tmp_path):
    rows = made_up(11, 300)
    stream = as_stream(spark, rows, f"{tmp_path}/in", 4).withColumn("failed", F.col("call_id") % 7 != 0)
    got = run_timed(timers.lockouts(stream, ["channel"], 4, 60 * SECOND)).collect()
    count, until, want = {}, {}, []
    for channel, _, call, ts, _ in rows:
        if channel in until and ts > until[channel]:
            del until[channel]
            count[channel] = 0
        want.append((channel, call, channel in until, until[channel] - ts if channel in until else 0))
        if channel not in until:
            count[channel] = count.get(channel, 0) + 1 if call % 7 else 0
            if count[channel] == 4:
                until[channel] = ts + 60 * SECOND
    assert any(w[2] for w in want) and collections.Counter(map(tuple, got)) == collections.Counter(want)
