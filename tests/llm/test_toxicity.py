"""Restored words against a search of every path, and what is scored."""

import numpy as np
import pytest

pytest.importorskip("beaconframe.llm")

from beaconframe.llm import toxicity  # noqa: E402

TEXT = "you are an idiot and a moron , the clown says stupid things in the trash to a loser " * 40


@pytest.fixture(scope="module")
def restorer():
    codes = toxicity.TABLE[np.frombuffer(f"  {TEXT}  ".encode("latin-1"), np.uint8)]
    counts = np.bincount((codes[:-2] * toxicity.SYMBOLS + codes[1:-1]) * toxicity.SYMBOLS + codes[2:], minlength=toxicity.SYMBOLS**3)
    return toxicity.Restorer(toxicity.trigram_costs(counts))


def every_path(restorer, token, parted):
    """(cost, text) of all paths through the lattice."""
    latin = toxicity.of_two_scripts(token)
    paths = [(0.0, (0, 0), "", "")]  # cost, last two symbols, last kept, text

    def put(path, t):
        cost, (a, b), last, text = path
        if t == " " and b == 0:
            return path
        s = toxicity.symbol(t)
        return cost + restorer.costs[a][b][s], (b, s), t, text + t

    for i, c in enumerate(token):
        arcs, drop, same = restorer.arcs(token, i, latin)
        if parted and i and c.isalpha():
            paths += [put((p[0] + toxicity.BREAK_LETTER, *p[1:]), " ") for p in paths if p[1][1]]
        paths = [put((p[0] + extra, *p[1:]), t) for p in paths for extra, t in arcs] + ([(p[0] + drop, *p[1:]) for p in paths if not same or p[2] == c] if drop is not None else [])
    return [(cost + restorer.costs[a][b][0], text.strip()) for cost, (a, b), _, text in paths]


@pytest.mark.parametrize("parted", [False, True])
@pytest.mark.parametrize("token", ["1d10t", "m0r0n", "iidiot", "i-d-t", "anidi", "st*d", "a $cu", "id iot", "lоser", "b", "88", "a.b c"])
def test_decode_is_the_least_path(restorer, token, parted, monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 10**9)
    paths = every_path(restorer, token, parted)
    least = min(cost for cost, _ in paths)
    assert restorer.decode(token, parted) in {text for cost, text in paths if cost < least + 1e-9}


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("i-d-i-o-t", "idiot"), ("st*pid", "stupid"), ("tr@sh", "trash"), ("iiidiottt", "idiot"), ("іdiot", "idiot"), ("id iot", "idiot"), ("mo ron", "moron"), ("l.o.s.e.r", "loser"), ("idiot###", "idiot")])
def test_restored_words(restorer, token, word):
    assert word in restorer.words(token)


def test_no_cut_in_long_tokens(restorer):
    for before in (0, 40, 47, 90, 500):
        assert restorer.decode("x" * before + "-i-d-i-o-t").split()[-1].endswith("idiot")
    assert len(restorer.decode("ab1" * 3_000)) > 3_000


def test_spaced_words_next_to_each_other(restorer):
    for text in ("y o u a r e a n i d i o t", "(a m o r o n), ok", "y.o.u i-d-i-o-t", "m o r o n, ok"):
        words = {w for t in toxicity.tokens_of(text) for w in restorer.words(t)}
        assert "idiot" in words or "moron" in words, text
    words = {w for t in toxicity.tokens_of("y o u a r e a n i d i o t") for w in restorer.words(t)}
    assert {"you", "are", "an", "idiot"} <= words


def test_pairs_of_short_words():
    assert {"mo ron", "id iot"} <= toxicity.tokens_of("a mo ron or id iot there")
    assert not any(" " in t for t in toxicity.tokens_of("longer words everywhere here"))


def test_ordinary_words_stay(restorer):
    for word in ("clown", "the", "Stupid", "things,"):
        assert word.lower().strip(",") in restorer.words(word)
    assert restorer.words("...") == [] and toxicity.tokens_of("") == set()


def test_scores_are_those_of_all_features():
    """What is skipped by the words' heads has no feature."""
    model = toxicity.ToxicityModel(np.zeros((28, 28, 28)), ["=idiot", "mor", "clow"], np.array([1.0, 2.0, 3.0]), -4.0)
    counts = model.scorer()
    plain = toxicity.Restorer(model.costs)
    for text in ("an idiot and a moron", "morose clowns, idiots", "", "none of them"):
        found = {}
        for token in toxicity.tokens_of(text):
            for f in toxicity.features_of(plain.words(token)):
                if f in model.features:
                    i = model.features.index(f)
                    found[i] = found.get(i, 0) + 1
        assert dict(counts(text)) == found
        margin = model.bias + sum(model.weights[i] * np.log1p(n) for i, n in found.items())
        assert np.isclose(model.scores(counts, [text])[0], 1 / (1 + np.exp(-margin)))
