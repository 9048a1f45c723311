"""Kernels of the training-data operators on small cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from beaconframe.llm import bpe, fingerprint, media, ngram_join, quality, tokencount  # noqa: E402


def random_text(rng, alphabets, most=150):
    letters = rng.choice(alphabets)
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))


def test_bpe_chunks_match_the_library():
    codec = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(2)
    for _ in range(1500):
        text = random_text(rng, ["ab  \n\n'sdt1.é", "a", "ab \n", " \n", "'s ve.,1", "字a '", "'relv "])
        ids = codec.encode(text, rng.randint(3, 30), rng.randint(1, 40))
        assert ids == codec.library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_token_lengths_match_the_library():
    model = P.path("piece_bpe_32k.model")
    lengths, library = tokencount.Lengths(model, {}), tokencount.load_processor(model)
    assert tokencount.supports(library)
    rng = random.Random(1)
    for _ in range(1500):
        text = random_text(rng, [" ▁ \n\t\rab<s></s>é字😀.　 ();"], 20)
        assert lengths.count(text) == len(library.encode(text))


def test_png_round_trip_and_checks():
    rng = np.random.default_rng(0)
    for shape in ((1, 64), (3, 64), (200, 64), (7, 5)):
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        image = media.encode_png(pixels)
        assert (media.decode_png(image) == pixels).all()
        for at in (0, 20, len(image) // 2, len(image) - 2):
            with pytest.raises(media.BadImage):
                media.decode_png(image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :])
    with pytest.raises(media.BadImage):
        media.decode_png(image[:-12])


def test_png_filters():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (5, 9), dtype=np.uint8)
    rows = np.zeros((5, 10), np.uint8)
    for y in range(5):
        rows[y, 0] = y
        for x in range(9):
            a = int(pixels[y, x - 1]) if x else 0
            b = int(pixels[y - 1, x]) if y else 0
            c = int(pixels[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            rows[y, x + 1] = (int(pixels[y, x]) - (0, a, b, (a + b) // 2, near)[y]) & 255
    assert (media.unfilter(rows[:, 0], rows[:, 1:]) == pixels).all()


@pytest.mark.parametrize("n, want", [(0, 64), (1, 64), (64, 64), (65, 128)])
def test_payload(n, want):
    size, payload = media.text_payload("x" * n)
    assert (size, len(payload)) == (n, want)


def entropy_classes_slow(data):
    out = []
    for i in range(len(data) - 63):
        total = int(fingerprint._F[np.bincount(data[i : i + 64])].sum())
        out.append((fingerprint._FULL - total) * fingerprint.CLASSES // fingerprint._FULL)
    return out


def test_entropy_is_that_of_each_window():
    data = np.frombuffer(("the quick brown fox " * 12 + "zzzzzzzz" * 20).encode(), np.uint8)
    assert fingerprint._entropy_classes(data).tolist() == entropy_classes_slow(data)


def test_fingerprints_do_not_depend_on_neighbours():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ,.") for _ in range(rng.randint(0, 3000))).encode() for _ in range(30)] + [b"", b"a"]
    together = fingerprint.digests(texts)
    assert together == [fingerprint.digest(t) for t in texts]
    assert fingerprint.digest(b"") == b"" and fingerprint.likeness(b"", b"") == 1.0
    assert fingerprint.likeness(b"", together[0]) == 0.0
    long = "".join(rng.choice("abcdefghijklmnop ,.") for _ in range(6000))
    half = fingerprint.likeness(*(fingerprint.digest(t.encode()) for t in (long, fingerprint.edited(long, long[::-1]))))
    assert 0.3 < half < 0.8


def test_edited():
    assert fingerprint.edited("abcdef", "XYZ") == "abcXYZ"
    assert fingerprint.edited("abcde", "X") == "abcX"
    assert fingerprint.edited("a", "X") == "a" and fingerprint.edited("", "X") == ""


def test_shingles():
    s = ngram_join.Shingler()(["", "a b", "a b c d e", "A B c d e f", "a b c d e a b c d e"])
    assert [len(x) for x in s] == [0, 1, 1, 2, 5]
    assert set(s[2].tolist()) <= set(s[3].tolist())


def test_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[20:]] for a in sets[:20]]
    assert ngram_join.common_counts(sets[:20], sets[20:]).tolist() == want
    assert ngram_join.alike(10, 8, 8) and not ngram_join.alike(10, 10, 8)


def test_recall_needs_runs():
    assert 1 - (1 - ngram_join.survival(3)) ** ngram_join.runs_for(0.997) >= 0.997
    assert ngram_join.survival(1) > ngram_join.survival(3) > 0.3


def test_forest_learns():
    rng = np.random.default_rng(7)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.grow(x[:2000], y[:2000], trees=40)
    assert (((forest.probability(x[2000:]) >= 0.5) == y[2000:]).mean()) > 0.95
    assert quality.grow(x[:0], y[:0]).probability(x[:3]).tolist() == [0.5] * 3
    assert quality.statistics("") == [0.0] * len(quality.FEATURES)
    assert len(quality.statistics("a \n\n b!")) == len(quality.FEATURES)


def test_hashes_in_use():
    assert zlib.crc32(b"") == 0 and len(hashlib.sha256(b"").digest()) == 32
