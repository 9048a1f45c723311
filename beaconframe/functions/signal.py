"""Audio: energy profiles, tone segments and tone spans.  Array functions work on columns; the rest on numpy arrays."""

from __future__ import annotations

import hashlib
import io
import wave

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_S, RATE, SHIFTS, LEAST_FRAMES = 0.05, 8000, 10, 4
FFT, HOP = 2048, 256
BAND = (200.0, 5000.0)  # Hz
REFERENCE_S, QUIET_SHARE, NO_FLOOR_DB = 3.0, 0.2, -60.0
REMOVAL_HOP, REMOVAL_LEAST_S, REMOVAL_MAGNITUDE = 512, 0.5, 0.02


def best_cosine(a: Column, b: Column, shifts: int = SHIFTS, least: int = LEAST_FRAMES) -> Column:
    """The best cosine of two profiles shifted against each other; 0 if none is positive or too few frames overlap."""
    n = F.least(F.size(a), F.size(b))

    def cosine(s: Column) -> Column:
        x = F.slice(a, F.greatest(s, F.lit(0)) + 1, F.greatest(n - F.abs(s), F.lit(0)))
        y = F.slice(b, F.greatest(-s, F.lit(0)) + 1, F.greatest(n - F.abs(s), F.lit(0)))
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i.cast("double") * j), F.lit(0.0), lambda t, v: t + v)
        norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        return F.when((n - F.abs(s) >= least) & (norm > 0), dot(x, y) / norm).otherwise(0.0)

    return F.greatest(F.array_max(F.transform(F.sequence(F.lit(-shifts), F.lit(shifts)), cosine)), F.lit(0.0))


def pcm_of_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1 of a 16-bit WAV (channels averaged) and their rate."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("16-bit samples only")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float64) / 32768
        return x.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()


def wav_of_pcm(x: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def pcm_hash(x: np.ndarray) -> str:
    return hashlib.sha256((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()).hexdigest()


def energy_profile(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """RMS of each 50 ms frame, divided by the greatest; empty if there are fewer than four frames."""
    size = int(rate * FRAME_S)
    n = len(x) // size
    if n < LEAST_FRAMES:
        return np.empty(0)
    rms = np.sqrt((x[: n * size].reshape(n, size) ** 2).mean(axis=1))
    return rms / rms.max() if rms.max() > 0 else rms


def spectra(x: np.ndarray, rate: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames' starts in seconds and their magnitudes (a quarter of a sine's amplitude at its bin), 0 outside the band."""
    if len(x) < FFT:
        return np.empty(0), np.empty((0, FFT // 2 + 1))
    starts = np.arange(0, len(x) - FFT + 1, hop)
    found = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, FFT)[starts] * np.hanning(FFT), axis=1)) / FFT
    hz = np.arange(found.shape[1]) * rate / FFT
    found[:, (hz < BAND[0]) | (hz > BAND[1])] = 0
    found[:, -1] = 0
    return starts / rate, found


def refined(spectrum: np.ndarray, row: np.ndarray, peak: np.ndarray, rate: int) -> np.ndarray:
    """Frequencies of peaks, by a parabola through the peak and both neighbours."""
    a, b, c = (np.log(spectrum[row, peak + d] + 1e-12) for d in (-1, 0, 1))
    bend = a - 2 * b + c
    shift = np.where(np.abs(bend) > 1e-12, 0.5 * (a - c) / np.where(bend == 0, 1, bend), 0)
    return (peak + np.clip(shift, -0.5, 0.5)) * rate / FFT


def frames(x: np.ndarray, rate: int, hop: int = HOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each frame its start in seconds, the frequency of its strongest bin and that bin's magnitude."""
    start, spectrum = spectra(x, rate, hop)
    if not len(start):
        return start, np.empty(0), np.empty(0)
    peak, row = np.maximum(spectrum.argmax(axis=1), 1), np.arange(len(start))
    return start, refined(spectrum, row, peak, rate), spectrum[row, peak]


def relative_levels(magnitude: np.ndarray, rate: int, hop: int, reference_s: float | None = REFERENCE_S) -> tuple[np.ndarray, float]:
    """Frames' levels in dB against the loudest of the first seconds, and the noise floor.

    The floor is the middle one of the levels up to the one at a fifth of the
    sorted levels; a clip that is silent there has all levels at minus infinity.
    """
    if not len(magnitude):
        return np.empty(0), NO_FLOOR_DB
    early = magnitude if reference_s is None else magnitude[: int(reference_s * rate / hop) + 1]
    loudest = early.max()
    if loudest < 1e-20:
        return np.full(len(magnitude), -np.inf), NO_FLOOR_DB
    level = 20 * np.log10(np.maximum(magnitude, 1e-20) / loudest)
    ordered = np.sort(level)
    quiet = ordered[ordered <= ordered[int(len(ordered) * QUIET_SHARE)]]
    return level, float(quiet[len(quiet) // 2])


def tone_segments(x: np.ndarray, rate: int, least_s: float = 0.4, gate_db: float = -42.0, above_floor_db: float = 3.0, least_magnitude: float = 0.008) -> list[dict]:
    """Runs of frames of one frequency, as (frequency, start, end, duration, magnitude).

    A frame counts if it is loud enough by itself, against the clip's peak and
    above its noise floor; so a clip that is one tone throughout, without any
    quieter part, has none.  A run ends at a frame that does not count, or where
    the frequency moves by more than 2.5 %, or 30 Hz.
    """
    start, frequency, magnitude = frames(x, rate)
    level, floor = relative_levels(magnitude, rate, HOP)
    on = (magnitude > least_magnitude) & (level >= gate_db) & (level >= floor + above_floor_db)
    out, run = [], []

    def close() -> None:
        if run:
            begin, end = start[run[0]] + (FFT - HOP) / 2 / rate, start[run[-1]] + (FFT + HOP) / 2 / rate  # frames' middles
            if end - begin >= least_s:
                out.append({"frequency": float(np.median(frequency[run])), "start": float(begin), "end": float(end), "duration": float(end - begin), "magnitude": float(magnitude[run].max())})
        run.clear()

    for i in range(len(start)):
        moved = bool(run) and abs(frequency[i] - frequency[run[-1]]) > min(30.0, 0.025 * frequency[run[-1]])
        if not on[i] or moved:
            close()
        if on[i]:
            run.append(i)
    close()
    return out


def sustained_tones(x: np.ndarray, rate: int, gate_db: float = -28.0, above_floor_db: float = 6.0) -> list[dict]:
    """All tones of half a second or more, several at a time too, as (frequency, start, end, duration, magnitude): what removal cuts out.

    Every spectral peak above the least magnitude, in frames that pass the gates,
    extends the track within 20 Hz whose last frame it overlaps, or opens one.
    Tracks within 25 Hz and 0.1 s of each other become one.
    """
    start, spectrum = spectra(x, rate, REMOVAL_HOP)
    level, floor = relative_levels(spectrum.max(axis=1, initial=0.0), rate, REMOVAL_HOP, None)
    on = (level >= gate_db) & (level >= floor + above_floor_db)
    tracks: list[dict] = []
    for i in np.flatnonzero(on):
        s, begin, end = spectrum[i], float(start[i]), float(start[i] + FFT / rate)
        peaks = np.flatnonzero((s[1:-1] > REMOVAL_MAGNITUDE) & (s[1:-1] >= s[:-2]) & (s[1:-1] > s[2:])) + 1
        for hz, bin_ in zip(refined(spectrum, np.full(len(peaks), i), peaks, rate).tolist(), peaks.tolist()):
            near = [t for t in tracks if abs(t["frequency"] - hz) <= 20 and begin <= t["end"]]
            track = min(near, key=lambda t: abs(t["frequency"] - hz), default=None)
            if track is None:
                tracks.append({"frequency": hz, "start": begin, "end": end, "magnitude": float(s[bin_])})
                continue
            track["end"] = end
            if s[bin_] > track["magnitude"]:
                track |= {"frequency": hz, "magnitude": float(s[bin_])}
    out: list[dict] = []
    for t in sorted((t for t in tracks if t["end"] - t["start"] >= REMOVAL_LEAST_S), key=lambda t: t["start"]):
        same = next((o for o in out if abs(o["frequency"] - t["frequency"]) <= 25 and t["start"] <= o["end"] + 0.1), None)
        if same:
            same |= {"end": max(same["end"], t["end"]), "magnitude": max(same["magnitude"], t["magnitude"])}
        else:
            out.append(t)
    return [t | {"duration": t["end"] - t["start"]} for t in out]


def without_harmonics(tones: list[dict]) -> list[dict]:
    """Tones but for 2nd to 4th harmonics: onset within 0.2 s of a lower tone, 7 % off a multiple at most, hardly stronger.

    Tones are visited from the lowest on; one that was dropped drops no other.
    """
    kept: list[dict] = []
    for tone in sorted(tones, key=lambda t: (t["frequency"], t["start"])):
        if not any(abs(tone["frequency"] / low["frequency"] - n) <= 0.07 * n and abs(tone["start"] - low["start"]) <= 0.2 and tone["magnitude"] <= 1.15 * low["magnitude"] for low in kept for n in (2, 3, 4)):
            kept.append(tone)
    return sorted(kept, key=lambda t: t["start"])


def matches_set(tones: list[dict], tone_set: dict) -> bool:
    """Whether the tones hold the set's A then B (gap from minus A's duration to half a second), or its long tone."""
    tolerance = tone_set.get("tolerance", 10.0)
    tolerance = tolerance * 500 if tolerance < 1 else tolerance

    def fits(tone: dict, spec: dict | None) -> bool:
        return bool(spec) and abs(tone["frequency"] - spec["frequency"]) <= tolerance and tone["duration"] >= spec.get("min", 0) and tone["duration"] <= (spec.get("max") or 1e9)

    if tone_set.get("long"):
        return any(fits(t, tone_set["long"]) for t in tones)
    return any(fits(a, tone_set.get("a")) and fits(b, tone_set.get("b")) and -a["duration"] <= b["start"] - a["end"] <= 0.5 and b["start"] >= a["start"] for a in tones for b in tones if a is not b)


def paging_region(x: np.ndarray, rate: int, below_peak_db: float = 38.0, pad_s: float = 0.2) -> tuple[float, float] | None:
    """From the first to the last frame within 38 dB of the peak, with 0.2 s on both sides."""
    start, _, magnitude = frames(x, rate)
    loud = np.flatnonzero(magnitude >= magnitude.max() * 10 ** (-below_peak_db / 20)) if len(magnitude) and magnitude.max() > 0 else []
    if not len(loud):
        return None
    return max(0.0, start[loud[0]] - pad_s), min(len(x) / rate, start[loud[-1]] + FFT / rate + pad_s)


def kept_spans(duration: float, tones: list[tuple[float, float]], pad: float = 0.05, gap: float = 0.3, tail: float = 0.1) -> list[tuple[float, float]]:
    """What is left of a clip without its tones (each 50 ms longer on both sides): gaps of 0.3 s, a tail of 0.1 s; all of it if nothing is."""
    out, at = [], 0.0
    for a, b in sorted(tones):
        if a - pad - at >= gap:
            out.append((at, a - pad))
        at = max(at, b + pad)
    if duration - at >= tail:
        out.append((at, duration))
    return out or [(0.0, duration)]
