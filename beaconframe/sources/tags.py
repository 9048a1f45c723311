"""Audio files with ID3 tags: the frames read in Arrow batches, the recorder's fields parsed by Spark.

ID3v2.2 to v2.4 (unsynchronised or not, with or without an extended header, text in
any of the four encodings) and ID3v1.  A file without a tag, or with a broken one,
gives nulls.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship

FIELDS = ("title", "artist", "album", "comment")
#: Frames by field, as versions 3 and 4, and as version 2 name them.
FRAMES = {"TIT2": "title", "TT2": "title", "TPE1": "artist", "TP1": "artist", "TALB": "album", "TAL": "album", "COMM": "comment", "COM": "comment"}
_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _syncsafe(raw: bytes) -> int:
    out = 0
    for b in raw:
        out = out << 7 | b & 0x7F
    return out


def _text(raw: bytes, is_comment: bool) -> str:
    """A text frame; of a comment what follows its language and description."""
    kind = raw[0] if raw and raw[0] < 4 else 0
    body, wide = raw[1:], kind in (1, 2)
    stop = b"\0\0" if wide else b"\0"
    if is_comment:
        body = body[3:]
        at = next((i for i in range(0, len(body), len(stop)) if body[i : i + len(stop)] == stop), None)
        mark = body[:2] if kind == 1 and body[:2] in (b"\xff\xfe", b"\xfe\xff") else b""
        body = body[at + len(stop) :] if at is not None else body
        body = body if not mark or body[:2] in (b"\xff\xfe", b"\xfe\xff") else mark + body
    return body.decode(_ENCODINGS[kind], errors="replace").split("\0")[0].strip()


def read_tag(data: bytes) -> dict[str, str]:
    """The FIELDS that a file's tag has."""
    out: dict[str, str] = {}
    if data[:3] == b"ID3" and len(data) >= 10:
        version, flags, size = data[3], data[5], _syncsafe(data[6:10])
        body = data[10 : 10 + size]
        if flags & 0x80 and version < 4:
            body = body.replace(b"\xff\x00", b"\xff")
        if flags & 0x40 and version > 2 and len(body) >= 4:
            body = body[_syncsafe(body[:4]) :] if version == 4 else body[4 + struct.unpack(">I", body[:4])[0] :]
        wide = 3 if version == 2 else 4
        head = 6 if version == 2 else 10
        at = 0
        while at + head <= len(body) and body[at] != 0:
            name = body[at : at + wide].decode("latin-1")
            raw = body[at + wide : at + 2 * wide]
            n = _syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
            frame = body[at + head : at + head + n]
            if version == 4 and body[at + 9] & 0x02:
                frame = frame.replace(b"\xff\x00", b"\xff")
            if version == 4 and body[at + 9] & 0x01:
                frame = frame[4:]
            if (field := FRAMES.get(name)) and field not in out and frame:
                out[field] = _text(frame, field == "comment")
            at += head + n
    if not out and len(data) >= 128 and data[-128:-125] == b"TAG":
        tail = data[-125:]
        plain = lambda raw: raw.split(b"\0")[0].decode("latin-1").strip()
        out = {"title": plain(tail[:30]), "artist": plain(tail[30:60]), "album": plain(tail[60:90]), "comment": plain(tail[94:124])}
    return {k: v for k, v in out.items() if v}


def write_tag(fields: dict[str, str], audio: bytes, version: int = 3, encoding: int = 1) -> bytes:
    """``audio`` behind a tag of version 3 or 4 with these FIELDS."""
    names = {field: frame for frame, field in FRAMES.items() if len(frame) == 4}
    spell = (lambda n: bytes(n >> s & 0x7F for s in (21, 14, 7, 0))) if version == 4 else (lambda n: n.to_bytes(4, "big"))
    stop = b"\0\0" if encoding in (1, 2) else b"\0"
    body = b""
    for field, text in fields.items():
        raw = text.encode(_ENCODINGS[encoding])
        frame = bytes([encoding]) + (b"eng" + stop + raw if field == "comment" else raw)
        body += names[field].encode() + spell(len(frame)) + b"\0\0" + frame
    return b"ID3" + bytes([version, 0, 0]) + bytes(len(body) >> s & 0x7F for s in (21, 14, 7, 0)) + body + audio


def audio_files(spark: SparkSession, path: str, pattern: str = "*.mp3") -> DataFrame:
    """path, content of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def with_tags(files: DataFrame) -> DataFrame:
    """path and the FIELDS of each row of ``files`` (path, content); null contents have none."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = [read_tag(c.as_buffer().to_pybytes()) if c.is_valid else {} for c in batch.column("content")]
            yield pa.record_batch([batch.column("path"), *[pa.array([t.get(f) for t in tags], pa.string()) for f in FIELDS]], names=["path", *FIELDS])

    return files.select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{f} string" for f in FIELDS))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def tagged_calls(files: DataFrame) -> DataFrame:
    """path, unit_ref, unit_label, ts_ms, frequency, system_label, talkgroup_ref, talkgroup_label, patches of recorded calls.

    The artist is the unit and its label, the title the channel, its label in quotes and
    its patches in brackets, and the comment holds date (taken as UTC), frequency and
    system.  References and frequencies of zero count as absent.
    """
    positive = lambda c: F.nullif(F.try_to_number(c, F.lit("9" * 18)).cast("bigint"), F.lit(0))
    unit = positive(_found(F.col("artist"), "^([0-9]+) ?(.*)$"))
    when = F.try_to_timestamp(_found(F.col("comment"), "Date:([^;]+);"), F.lit("yyyy-MM-dd HH:mm:ss[.SSS][.SS][.S]"))
    listed = F.from_json(_found(F.col("title"), r"(\[.+\])"), "array<double>")
    return with_tags(files).select(
        "path",
        unit.alias("unit_ref"),
        F.when(unit.isNotNull(), F.nullif(F.trim(_found(F.col("artist"), "^([0-9]+) ?(.*)$", 2)), F.lit(""))).alias("unit_label"),
        F.unix_millis(when).alias("ts_ms"),
        positive(_found(F.col("comment"), "Frequency:([0-9]+);")).alias("frequency"),
        _found(F.col("comment"), "System:([^;]+);").alias("system_label"),
        positive(_found(F.col("title"), "([0-9]+)")).alias("talkgroup_ref"),
        _found(F.col("title"), '"([^"]+)"').alias("talkgroup_label"),
        F.transform(F.filter(listed, lambda p: p > 0), lambda p: p.cast("bigint")).alias("patches"),
    )
