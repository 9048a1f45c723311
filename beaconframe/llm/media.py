"""Media columns: lossless 8-bit greyscale PNG in a binary column, and perceptual hashes.

``encode_png`` writes the signature, IHDR, zlib-compressed IDAT chunks of bounded
size and IEND, each with its CRC-32; ``decode_png`` checks the signature, the
order and CRC of each chunk, inflates the image data (zlib checks its Adler-32)
and undoes the five row filters with numpy.  The hash is taken from the lowest
frequencies of a two-dimensional cosine transform of the image, shrunk to
``SIDE`` x ``SIDE`` cells by averaging: one bit for each coefficient, set where it
is above their median.

A text becomes an image of ``WIDTH`` columns: its UTF-8 bytes, followed by zero
bytes up to a positive multiple of ``WIDTH``.  A null or empty text is one row of
zeros.  Images are handled one at a time, so a worker holds one text's pixels.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, slim

WIDTH = 64
SIDE = 32
LOW = 8
IDAT_BYTES = 1 << 16
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(pixels: np.ndarray, kind: int) -> np.ndarray:
    out = pixels.copy()
    if kind == SUB:
        out[:, 1:] -= pixels[:, :-1]
    elif kind == UP:
        out[1:] -= pixels[:-1]
    return out


def encode_png(pixels: np.ndarray, level: int = 4) -> bytes:
    """A PNG of a matrix of unsigned bytes; the filter that leaves the least magnitudes is used for all rows."""
    height, width = pixels.shape
    tries = [(kind, _filtered(pixels, kind)) for kind in (NONE, SUB, UP)]
    kind, best = min(tries, key=lambda t: (int(np.abs(t[1].view(np.int8).astype(np.int16)).sum()), t[0]))
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, best
    data = zlib.compress(rows.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


class BadImage(ValueError):
    pass


def read_chunks(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk; BadImage if anything about them is wrong."""
    if image[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at, kind = 8, b""
    while at < len(image):
        if at + 12 > len(image):
            raise BadImage("cut short")
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        data = image[at + 8 : at + 8 + n]
        if len(data) != n or image[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise BadImage(f"checksum of {kind!r}")
        yield kind, data
        at += 12 + n
    if kind != b"IEND":
        raise BadImage("no end")


def _unfilter_row(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == NONE:
        return row
    if kind == SUB:
        return np.cumsum(row, dtype=np.uint8)
    if kind == UP:
        return row + above
    if kind not in (AVERAGE, PAETH):
        raise BadImage(f"filter {kind}")
    out, left, corner = np.empty_like(row), 0, 0
    for x, (v, b) in enumerate(zip(row.tolist(), above.tolist())):
        if kind == AVERAGE:
            guess = (left + b) // 2
        else:
            p = left + b - corner
            guess = min((left, b, corner), key=lambda c: abs(p - c))
        left = (v + guess) & 255
        corner = b
        out[x] = left
    return out


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pixels from filtered rows; a run of rows with one simple filter is undone at once."""
    out = np.empty_like(rows)
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]).tolist()
    for a, b in zip(starts, [*starts[1:], len(kinds)]):
        kind, above = int(kinds[a]), out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind == NONE:
            out[a:b] = rows[a:b]
        elif kind == SUB:
            np.cumsum(rows[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == UP:
            np.cumsum(rows[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        else:
            for y in range(a, b):
                out[y] = above = _unfilter_row(kind, rows[y], above)
    return out


def decode_png(image: bytes) -> np.ndarray:
    """The matrix of an 8-bit greyscale PNG without interlacing; BadImage for anything else."""
    shape, data = None, []
    for i, (kind, body) in enumerate(read_chunks(image)):
        if (kind == b"IHDR") != (i == 0):
            raise BadImage("header not first")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0] or not width or not height:
                raise BadImage("not 8-bit greyscale")
            shape = height, width
        elif kind == b"IDAT":
            data.append(body)
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise BadImage(str(e)) from e
    height, width = shape
    if len(raw) != height * (width + 1):
        raise BadImage("size")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _shrink(size: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``side`` cells: first index, last index and how many, over ``size`` lines."""
    cells = np.arange(side)
    first = cells * size // side
    last = np.maximum((cells + 1) * size // side, first + 1)
    return first, last, (last - first)


_K = np.arange(LOW)[:, None] * (2 * np.arange(SIDE)[None, :] + 1) * np.pi / (2 * SIDE)
#: The first LOW rows of the cosine transform of SIDE values.
COSINES = np.cos(_K)


def low_frequency_hash(pixels: np.ndarray) -> bytes:
    """LOW*LOW bits: which low-frequency coefficients exceed their median (the constant term is left out of it)."""
    height, width = pixels.shape
    total = np.zeros((height + 1, width + 1), np.int64)
    if height <= 4 * SIDE:
        np.cumsum(np.cumsum(pixels, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])
        r0, r1, rn = _shrink(height, SIDE)
        c0, c1, cn = _shrink(width, SIDE)
        cells = total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]
    else:  # tall: sum whole bands of rows, so that no table as large as the image is needed
        r0, r1, rn = _shrink(height, SIDE)
        bands = np.add.reduceat(pixels, r0, axis=0, dtype=np.int64)
        c0, c1, cn = _shrink(width, SIDE)
        sums = np.concatenate([np.zeros((SIDE, 1), np.int64), np.cumsum(bands, axis=1)], axis=1)
        cells = sums[:, c1] - sums[:, c0]
    mean = cells / (rn[:, None] * cn[None, :])
    low = np.round(COSINES @ mean @ COSINES.T, 6)
    return np.packbits(low.ravel() > np.median(low.ravel()[1:])).tobytes()


def text_payload(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def media_columns(docs: DataFrame, level: int = 4, keep_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, media (the PNG), payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    What describes the payload is computed from the image as read back.  Without
    ``keep_media`` the images themselves are left out.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                n, payload = text_payload(text)
                image = encode_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH), level)
                pixels = decode_png(image)
                back = pixels.tobytes()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(image), hashlib.sha256(image).hexdigest(), low_frequency_hash(pixels).hex(), *[image] * keep_media))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", *names[: len(columns)]])

    return slim(docs).mapInArrow(run, schema)
