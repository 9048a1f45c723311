"""ID3 tags of every version and encoding, as files."""

import struct

import pytest

from beaconframe.sources import tags

FIELDS = {"title": '101 "Fire É" [5,0,7]', "artist": "12 Engine é", "comment": "Date:2024-05-06 07:08:09.250;System:County;Frequency:154310000;"}


@pytest.mark.parametrize("version", [3, 4])
@pytest.mark.parametrize("encoding", [0, 1, 2, 3])
def test_round_trip(version, encoding):
    assert tags.read_tag(tags.write_tag(FIELDS, b"\xff\xfb" * 50, version, encoding)) == FIELDS


def test_other_forms():
    frame = lambda name, body: name + len(body).to_bytes(3, "big") + body
    body = frame(b"TT2", b"\0Old title") + frame(b"COM", b"\0engwhat\0Old comment") + frame(b"TP1", b"\x01\xff\xfeA\0b\0")
    assert tags.read_tag(b"ID3\x02\0\0" + bytes([0, 0, 0, len(body)]) + body + b"\0" * 10) == {"title": "Old title", "comment": "Old comment", "artist": "Ab"}
    plain = tags.write_tag({"title": "ÿ\x00"[:1] + "x"}, b"", 3, 0)
    body = plain[10:].replace(b"\xff", b"\xff\x00")
    assert tags.read_tag(b"ID3\x03\0\x80" + bytes([0, 0, 0, len(body)]) + body) == {"title": "ÿx"}
    extended = struct.pack(">I", 6) + b"\0" * 6 + plain[10:]
    assert tags.read_tag(b"ID3\x03\0\x40" + bytes([0, 0, 0, len(extended)]) + extended) == {"title": "ÿx"}
    old = b"audio" * 40 + b"TAG" + b"Title".ljust(30, b"\0") + b"12 Unit".ljust(30) + b"Album".ljust(30, b"\0") + b"2024" + b"Note".ljust(30, b"\0") + b"\0"
    assert tags.read_tag(old) == {"title": "Title", "artist": "12 Unit", "album": "Album", "comment": "Note"}
    for broken in (b"", b"ID3", b"ID3\x03\0\0\x7f\x7f\x7f\x7fTIT2", b"RIFF" * 100, b"ID3\x03\0\0\0\0\0\x0aTIT2\xff\xff\xff\xff\0\0"):
        assert tags.read_tag(broken) == {}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.mp3").write_bytes(tags.write_tag(FIELDS, b"\xff\xfb" * 50))
    (tmp_path / "2.mp3").write_bytes(b"no tag")
    (tmp_path / "3.mp3").write_bytes(tags.write_tag({"title": "none", "artist": "0 x", "comment": "Date:never;Frequency:0;"}, b"", 4, 3))
    (tmp_path / "4.txt").write_bytes(b"other")
    got = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in tags.tagged_calls(tags.audio_files(spark, str(tmp_path))).collect()}
    assert got == {
        "1.mp3": (12, "Engine é", 1_714_979_289_250, 154_310_000, "County", 101, "Fire É", [5, 7]),
        "2.mp3": (None,) * 8,
        "3.mp3": (None,) * 8,
    }
