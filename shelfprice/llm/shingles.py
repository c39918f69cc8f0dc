"""Word hashes and word shingles of texts, for the operators that compare texts by numpy in tasks."""

from __future__ import annotations

import re

import numpy as np

PORTION = 1 << 20
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


#: A 64-bit number for every byte, and where words end: at ASCII white space.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_SPACES = b" \t\n\x0b\x0c\r"
_SPACE = re.compile(b"[ \t-\r]")
_IS_LETTER = np.ones(256, bool)
_IS_LETTER[list(_SPACES)] = False
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """The first ``n`` or more powers of an odd number, remembered up to the longest word so far."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.append(np.uint64(1), np.full(2 * n, _BASE, np.uint64)), dtype=np.uint64)
    return _powers


def _hashed(raw: bytes) -> np.ndarray:
    dense = np.frombuffer(raw.translate(None, _SPACES), np.uint8)
    if not len(dense):
        return np.zeros(0, np.uint64)
    letter = _IS_LETTER.take(np.frombuffer(raw, np.uint8))
    bounds = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    bounds = np.concatenate(([0] if letter[0] else [], bounds, [len(raw)] if letter[-1] else [])).astype(np.int64)
    lengths = bounds[1::2] - bounds[::2]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(dense)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_BYTES.take(dense) * _powers_to(int(lengths.max())).take(place), first)
    return mixed(mixed(sums) + lengths.astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, in order, all by numpy.

    A word's hash is a polynomial over its bytes modulo 2 ** 64. Long texts are taken in portions of
    about ``PORTION`` bytes that end where a word ends.
    """
    if len(raw) <= PORTION:
        return _hashed(raw)
    found, start = [], 0
    while start < len(raw):
        space = _SPACE.search(raw, start + PORTION)
        end = space.start() if space else len(raw)
        found.append(_hashed(raw[start:end]))
        start = end
    return np.concatenate(found)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter, not empty text is one run.

    Runs of 1, 2, 4, ... words are put together, so the work per word is logarithmic in the width.
    """
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    count = n - width + 1
    run, size, out, done = hashes, 1, np.zeros(count, np.uint64), 0
    while True:
        if width & size:
            out = out * np.uint64(pow(_STEP, size, 1 << 64)) + run[done:done + count]
            done += size
        if done == width:
            return mixed(out)
        run = run[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + run[size:]
        size *= 2
