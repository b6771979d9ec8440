"""Words of whole texts and their hashes, found on the UTF-8 bytes of many texts at once.

A word is a run of characters other than ASCII punctuation, white space and controls, after A-Z are lower-cased.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from foliomill.llm.common import mixed

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True

_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 2**63, 1 << 12, dtype=np.uint64) | np.uint64(1)


class Words(NamedTuple):
    low: np.ndarray  # the lower-cased bytes
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past its last
    hash: np.ndarray  # 64 bits of each word
    first: np.ndarray  # first word of each text, and one more


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[data]
    inside = IN_WORD[low]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # A text's border is a border of its words.
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(low))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(low, start, end, hashes(low[inside], end - start), np.searchsorted(start, offsets))


def hashes(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of words whose bytes follow one another in ``letters``."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    values = _BYTE[letters] * _PLACE[place & (len(_PLACE) - 1)]
    return mixed(np.add.reduceat(values, at) + lengths.astype(np.uint64))


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """At each place the hash of the ``size`` words that end there; the first ``size`` - 1 places hold no use."""
    out = np.zeros(len(words), np.uint64)
    for back in range(size):
        out[back:] += mixed(words[: max(len(words) - back, 0)] + np.uint64(back * 0x9E3779B97F4A7C15 % 2**64)) * _PLACE[back]
    return mixed(out)
