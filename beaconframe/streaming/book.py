"""Pending tones with linked channels, a successor slot, an orphan timer and a wait for longer voice.

One book holds the channels that are linked with one another.  Times are event
times in milliseconds.  Before an event is looked at, every moment that passed
before it is settled in the order of time, so the outcome does not depend on when
a timer gets to fire.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: kind, tone call, voice call, and the moment at which it was settled
Settled = tuple[str, int, int | None, int]


@dataclass
class Slot:
    """Tones that wait for voice: their calls, and the times of the first and the last."""

    calls: list[int] = field(default_factory=list)
    first: int = 0
    last: int = 0
    locked: bool = False


@dataclass
class Book:
    """``links``: which channels also hear a channel's tones.

    Kinds of outcome: attached (voice took the tones), orphan (nobody followed),
    expired (later tones replaced them), dropped (they waited behind orphans).
    """

    links: dict[int, set[int]] = field(default_factory=dict)
    window_ms: int = 120_000
    orphan_ms: int = 60_000
    wait_ms: int = 15_000
    link_ms: int = 30_000
    least_voice_s: float = 5.0
    now: dict[int, Slot] = field(default_factory=dict)
    following: dict[int, Slot] = field(default_factory=dict)
    parked: dict[int, tuple[int, int]] = field(default_factory=dict)  # a short call and when it came

    def settle(self, kind: str, channel: int, call: int, ts: int, voice_s: float) -> list[Settled]:
        """What an event settles; kinds of event: tone, lock (the tones are being claimed), voice."""
        out = self.passed(ts)
        if kind == "tone":
            out += self._tone(channel, call, ts)
        elif kind == "lock":
            self.lock(channel)
        elif voice_s >= self.least_voice_s:
            self.parked.pop(channel, None)
            out += self._attach(channel, call, ts, ts)
        elif self._source(channel, ts) is not None:
            self.parked[channel] = (call, ts)  # a newer short call replaces an older one
        return out

    def events(self, channel: int, call: int, ts: int, tones: bool, voice_s: float) -> list[tuple[str, int, int | None]]:
        """`settle` for calls with or without tones, without the moments."""
        return [s[:3] for s in self.settle("tone" if tones else "voice", channel, call, ts, voice_s)]

    def _tone(self, channel: int, call: int, ts: int) -> list[Settled]:
        out: list[Settled] = []
        slot = self.now.get(channel)
        if slot and slot.locked:
            slot = self.following.setdefault(channel, Slot(first=ts))
        elif slot and ts - slot.last > self.window_ms:
            out = [("expired", c, None, ts) for c in slot.calls]
            slot = self.now[channel] = Slot(first=ts)
        elif slot is None:
            slot = self.now[channel] = Slot(first=ts)
        slot.calls.append(call)
        slot.last = max(slot.last, ts)
        return out

    def _source(self, channel: int, ts: int) -> int | None:
        """The channel whose tones a voice call on ``channel`` may take: its own, else the least linked one's."""
        own = self.now.get(channel)
        if own and own.first <= ts <= own.last + self.window_ms:
            return channel
        heard = [c for c, slot in self.now.items() if channel in self.links.get(c, ()) and slot.first <= ts <= slot.last + self.link_ms]
        return min(heard, default=None)

    def _attach(self, channel: int, call: int, came: int, moment: int) -> list[Settled]:
        source = self._source(channel, came)
        if source is None:
            return []
        out: list[Settled] = [("attached", c, call, moment) for c in self.now.pop(source).calls]
        if source in self.following:
            self.now[source] = self.following.pop(source)
        return out

    def lock(self, channel: int) -> None:
        """From now on, and until these tones are taken, new ones go to the successor slot."""
        if channel in self.now:
            self.now[channel].locked = True

    def _moments(self) -> list[tuple[int, int, int]]:
        """When something happens by itself: the moment, whether it is an orphan, and the channel."""
        return [(came + self.wait_ms, 0, c) for c, (_, came) in self.parked.items()] + [(slot.last + self.orphan_ms, 1, c) for c, slot in self.now.items()]

    def due(self) -> int | None:
        return min((m[0] for m in self._moments()), default=None)

    def passed(self, ts: int) -> list[Settled]:
        """Settles all moments before ``ts``: short calls that waited, and tones that nobody followed."""
        out: list[Settled] = []
        while (moments := self._moments()) and (first := min(moments))[0] < ts:
            moment, orphan, channel = first
            if not orphan:
                call, came = self.parked.pop(channel)
                out += self._attach(channel, call, came, moment)
                continue
            out += [("orphan", c, None, moment) for c in self.now.pop(channel).calls]
            if channel in self.following:
                out += [("dropped", c, None, moment) for c in self.following.pop(channel).calls]
            self.parked.pop(channel, None)
        return out

    def empty(self) -> bool:
        return not (self.now or self.following or self.parked)
