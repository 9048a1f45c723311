"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks of ``chunk`` characters, each with ``overlap`` more
characters after it.  Chunks are pre-tokenised independently, each from its own
first character, so a chunk's first boundaries may be wrong.  A match of the
pattern depends only on what follows its start; so where the boundaries of two
neighbours agree at one position inside their overlap, they agree from there on.
There the chunks are stitched: the left one's pre-tokens up to that position,
the right one's after it.  Where an overlap holds no such position (a word longer
than it), the left chunk's pre-tokenisation simply goes on until it meets the
right one's, so the result is the whole text's in every case.  Each pre-token is
then encoded by itself, and decoding concatenates the bytes of the ids.

This one path serves texts of every size: most documents have several chunks.
Texts up to ``long_chars`` characters are chunked, encoded and stitched within one
task, without any shuffle.  Only the chunks of longer ones are dealt out over the
cluster, encoded there, and streamed back in order, one chunk at a time, to the
task that stitches them.

Null and empty texts have no ids.  Repeated rows (same id, same text) are stitched
once when long, and returned as often as they occur.  An empty table gives no rows.
Special tokens inside a text are ordinary characters.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, slim

CHUNK = 2_048
OVERLAP = 96
LONG_CHARS = 65_536
CACHE_ROWS = 200_000
CACHED_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}


class Codec(dict):
    """Pre-tokenises, encodes and decodes; as a dict, the ids of pre-tokens met so far."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        super().__init__()
        ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        if self.pattern.groups:
            raise ValueError("a pattern without groups is needed")
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece

    def __missing__(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        found = self.library._encode_single_piece(piece)
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHE_ROWS:
                self.clear()
            self[piece] = found
        return found

    def local(self, view: str, last: bool) -> tuple[list[int], list[list[int]]]:
        """The chunk's own pre-tokens: where each ends, and its ids.

        Unless it is the text's last, the view's end may have cut the final two matches short.
        """
        pieces = self.pattern.findall(view)
        pieces = pieces if last else pieces[:-2]
        return list(accumulate(map(len, pieces))), list(map(self.__getitem__, pieces))

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Ids of the whole text."""
        ids: list[int] = []
        stitcher = Stitcher(self)
        for start in range(0, len(text), chunk):
            view, last = text[start : start + chunk + overlap], start + chunk >= len(text)
            ids += stitcher.feed(start, view, last, *self.local(view, last))
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_KEPT: dict[tuple[str, str], Codec] = {}


def kept_codec(path: str, pattern: str) -> Codec:
    """The worker's codec; what it has encoded serves all of the worker's tasks."""
    if (path, pattern) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, pattern] = Codec(path, pattern)
    return _KEPT[path, pattern]


def packed(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


SHORT_SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def encode_short(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """Each row's ids and the bytes they decode to (with ``digest``: their SHA-256), within its own task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_codec(path, pattern)
        for batch in slices(batches):
            counts, ids, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                found = codec.encode(text, chunk, overlap)
                counts.append(len(found))
                a, b = packed(found), codec.decode(found)
                ids.append(hashlib.sha256(a).digest() if digest else a)
                decoded.append(hashlib.sha256(b).digest() if digest else b)
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.mapInArrow(run, SHORT_SCHEMA)


CHUNK_SCHEMA = "doc_id long, text_key binary, chunk long, start long, last boolean, text string, ends binary, counts binary, ids binary"


def chunk_rows(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """A row for each chunk: its text with what overlaps the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                key = hashlib.sha256(text.encode()).digest()
                starts = list(range(0, len(text), chunk))
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": doc_id, "text_key": key, "chunk": i, "start": s, "last": s + chunk >= len(text), "text": text[s : s + chunk + overlap]} for i, s in enumerate(starts)],
                    schema=pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("chunk", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())]),
                )

    return docs.mapInArrow(run, "doc_id long, text_key binary, chunk long, start long, last boolean, text string")


def encode_chunks(chunks: DataFrame, path: str, pattern: str) -> DataFrame:
    """Each chunk pre-tokenised and encoded from its own start; its text stays for the stitching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_codec(path, pattern)
        for batch in slices(batches):
            rows = []
            for r in batch.to_pylist():
                ends, pieces = codec.local(r["text"], r["last"])
                rows.append({k: r[k] for k in ("doc_id", "text_key", "chunk", "start", "last", "text")} | {"ends": packed(ends), "counts": packed([len(p) for p in pieces]), "ids": packed([i for p in pieces for i in p])})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("chunk", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string()), ("ends", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())]))

    return chunks.mapInArrow(run, CHUNK_SCHEMA)


def unpacked(row: dict) -> tuple[list[int], list[list[int]]]:
    ends, ids = np.frombuffer(row["ends"], "<u4").tolist(), np.frombuffer(row["ids"], "<u4").tolist()
    cuts = np.cumsum(np.frombuffer(row["counts"], "<u4")).tolist()
    return ends, [ids[a:b] for a, b in zip([0, *cuts], cuts)]


class Stitcher:
    """Takes a text's chunks in order and hands on its ids, chunk by chunk."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.at = 0  # where what has been handed on ends
        self.held = ""  # the text from there on, as far as it is known

    def feed(self, start: int, view: str, last: bool, ends: list[int], pieces: list) -> list[int]:
        """``ends`` and ``pieces``: the chunk's own pre-tokens, ends counted from ``start``."""
        if start > 0 and start + len(view) <= self.at:
            return []
        self.held += view[max(0, self.at + len(self.held) - start) :]
        reach, done, out = start + (ends[-1] if ends else 0), 0, []
        while done < len(self.held):
            here = self.at + done - start
            if 0 <= here < reach - start and (not here or ends[bisect_left(ends, here)] == here):  # both agree: take the rest from the chunk
                out += chain.from_iterable(pieces[bisect_left(ends, here + 1) if here else 0 :])
                done = reach - self.at
                continue
            m = self.codec.pattern.match(self.held, done)
            if not last and m.end() + 1 >= len(self.held):
                break  # it may go on in the next chunk
            out += self.codec[m.group()]
            done = m.end()
        self.at += done
        self.held = self.held[done:]
        return out


def encode_long(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """As encode_short, with each document's chunks dealt out over the cluster."""
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = chunk_rows(docs, chunk, overlap).repartition(tasks, "text_key", "chunk")
    encoded = encode_chunks(chunks, path, pattern).repartition(tasks, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_codec(path, pattern)
        key, last, copies = None, -1, 1

        def done():
            if digest:
                return pa.RecordBatch.from_pylist([{"doc_id": key[0], "n_tokens": n, "ids": a.digest(), "decoded": b.digest()}] * copies, schema=schema)
            return pa.RecordBatch.from_pylist([{"doc_id": key[0], "n_tokens": n, "ids": bytes(a), "decoded": bytes(b)}] * copies, schema=schema)

        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["doc_id"], row["text_key"]) != key:
                    if key:
                        yield done()
                    key, last, copies, n = (row["doc_id"], row["text_key"]), -1, 1, 0
                    a, b = (hashlib.sha256(), hashlib.sha256()) if digest else (bytearray(), bytearray())
                    stitcher = Stitcher(codec)
                if row["chunk"] == last:  # a chunk of an equal row
                    copies += row["chunk"] == 0
                    continue
                last = row["chunk"]
                ids = stitcher.feed(row["start"], row["text"], row["last"], *unpacked(row))
                n += len(ids)
                for sink, data in ((a, packed(ids)), (b, codec.decode(ids))):
                    sink.update(data) if digest else sink.extend(data)
        if key:
            yield done()

    return encoded.mapInArrow(run, SHORT_SCHEMA)


def encode_decode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, long_chars: int = LONG_CHARS, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (bytes) for each row of ``docs``.

    With ``digest`` the last two are SHA-256 digests instead.
    """
    whole = slim(docs)
    size = F.char_length("text")
    short = encode_short(whole.where(size <= long_chars), path, pattern, chunk, overlap, digest)
    return short.unionByName(encode_long(whole.where(size > long_chars), path, pattern, chunk, overlap, digest))
