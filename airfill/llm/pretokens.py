"""Splitting text into the pre-tokens of the public byte-level vocabularies, whole batches
at a time.

The published pattern (``public_tokenizers.PATTERN``) is: a contraction such as ``'s``; or
letters, or numbers, or other signs, each with at most one leading space; or white space,
without its last character where text follows. Which characters start a pre-token then
follows from the classes of neighbouring characters alone, so it is computed on arrays of
code points instead of with one regular-expression match per word.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER, EDGE = 0, 1, 2, 3, 4
# Code points with the Unicode property White_Space; endings of contractions
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    out[WHITE] = SPACE
    return out


def split(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of UTF-8 ``texts``: (buffer, starts, ends, count per text), the first two
    as byte offsets into the buffer, in text order."""
    buffer = b"\0".join([*texts, b""])
    points = np.frombuffer(buffer.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    place = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=place[1:])
    sizes = np.array([len(t) for t in texts], np.int64)
    edges = np.searchsorted(place, np.cumsum(sizes + 1) - 1)
    kind = classes()[points]
    kind[edges] = EDGE
    before = np.empty_like(kind)
    before[:1], before[1:] = EDGE, kind[:-1]
    after = np.empty_like(kind)
    after[-1:], after[:-1] = EDGE, kind[1:]
    blank = points == 0x20
    blank[edges] = False
    blank_before = np.zeros(len(points), bool)
    blank_before[1:] = blank[:-1]
    run = kind != before
    starts = np.where(kind == SPACE, run | ((after != SPACE) & (after != EDGE)), run & ~blank_before)
    starts[edges] = True
    # a lone apostrophe that starts a pre-token and stands before an ending takes it along
    for i in np.flatnonzero((points == 0x27) & starts & (after == LETTER)):
        for ending in CONTRACTIONS:
            stop = i + 1 + len(ending)
            if points[i + 1:stop].tobytes() == ending.encode("utf-32-le"):
                starts[i + 1:stop] = False
                starts[stop] |= kind[stop] == LETTER
                break
    at = np.flatnonzero(starts)
    begin, end = place[at], place[np.append(at[1:], len(points))] if len(at) else place[at]
    real = kind[at] != EDGE
    per_text = np.diff(np.searchsorted(at[real], np.concatenate([[0], edges]))) if len(texts) else np.zeros(0, np.int64)
    return buffer, begin[real], end[real], per_text
