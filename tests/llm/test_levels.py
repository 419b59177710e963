"""The search by levels of the words' trie against the one word by word."""

import random

import pytest

from quern.llm import pieces
from quern.llm.queries import PIECES

from .test_brute import viterbi


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PIECES)


def words(seed: int, letters: str, longest: int, count: int) -> list[str]:
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(count)})


def test_levels_give_what_depth_gives(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "STACK", 700)
    for seed in range(60):
        found = words(seed, "abest▁\n\0é漢😀́", 1 + seed, 40 * (1 + seed % 30))
        by_depth, got = {}, {}
        vocabulary._by_depth(found, by_depth)
        vocabulary.segment(found, got)
        assert got == by_depth


def test_short_words_are_not_taken_a_character_at_a_time(vocabulary, monkeypatch):
    monkeypatch.setattr(vocabulary, "_by_depth", None)
    texts = [" ".join(words(seed, "aeinrstöé漢\0", 9, 50)) for seed in range(20)] + ["", "a", "  ", "é" * 39]
    for text, got in zip(texts, vocabulary.encode(texts)):
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == viterbi(vocabulary, text)


def test_long_words_are_not_kept():
    fresh = pieces.load(PIECES)
    first = fresh.encode(["ab" * 60 + " cd", "ab" * 60])
    assert set(fresh.cache) == {"▁cd"} and fresh.encode(["ab" * 60 + " cd", "ab" * 60]) == first


def test_of_equal_scores_the_longer_piece_wins():
    letters = [f"<0x{b:02X}>" for b in range(256)]
    own = {"▁": -1.0, "a": -1.0, "aa": -2.0, "aaa": -3.0, "ba": -2.0, "b": -1.0}
    v = pieces.Vocabulary([*letters, *own], [0.0] * 256 + list(own.values()), "B" * 256 + "N" * len(own))
    found = words(1, "▁abz", 12, 500)
    by_depth, got = {}, {}
    v._by_depth(found, by_depth)
    v.segment(found, got)
    assert got == by_depth and v.spoken[int.from_bytes(got[max(w for w in found if set(w) == {"a"})][-4:], "little")].startswith(b"aa")
