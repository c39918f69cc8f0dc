"""Word hashes: one per word, equal for equal words only, whatever surrounds them."""

import numpy as np
import pytest

from cases import prose
from shelfprice.llm import shingles
from shelfprice.llm.shingles import windows, word_hashes

TEXTS = [b"", b" \t\n", b"one", b" one  two\x0b\x0cthree\r\n", "é ü  x \U0001F600 é".encode(), b"a\x00b \x1c \x85 \xa0", b"x" * 5000 + b" y"]


@pytest.mark.parametrize("raw", TEXTS)
def test_words_as_split_has_them(raw):
    alone = [int(word_hashes(w)[0]) for w in raw.split()]
    assert word_hashes(raw).tolist() == alone


def test_no_two_words_share_a_hash():
    words = {w for k in range(400) for w in prose(200, k)} | {f"{a}{b}" for a in range(300) for b in range(300)} | {"a" * k for k in range(1, 300)}
    assert len({int(word_hashes(w.encode())[0]) for w in words}) == len(words)


def test_portions_do_not_matter(monkeypatch):
    raw = " ".join([*prose(3000, 1), "z" * 700, *prose(50, 2)]).encode()
    whole = word_hashes(raw)
    for portion in (1, 10, 333):
        monkeypatch.setattr(shingles, "PORTION", portion)
        assert (word_hashes(raw) == whole).all()
    assert (np.bincount(whole % np.uint64(16)) > 100).all()


def test_windows_depend_on_their_words_only():
    a, b = prose(60, 3), prose(40, 4)
    left = windows(word_hashes(" ".join(a + b).encode()), 5)
    right = windows(word_hashes(" ".join(b).encode()), 5)
    assert left[-36:].tolist() == right.tolist() and len(set(left.tolist())) == 96
