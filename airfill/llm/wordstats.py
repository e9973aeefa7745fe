"""Counts over a batch of whole texts at a time: words as runs of bytes that aren't ASCII white
space, and which of them lie in repeated windows."""

from __future__ import annotations

import numpy as np

# Fixed values
WHITE = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
SYMBOLS = b"#*$%&|<>"


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, each word's number in text order, words per text)."""
    words = [t.split() for t in texts]
    index: dict[bytes, int] = {}
    numbers = np.fromiter((index.setdefault(w, len(index)) for own in words for w in own), np.int64)
    return list(index), numbers, np.array([len(w) for w in words], np.int64)


def sums(values: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Totals of ``values`` (in text order) per text."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(per_text)
    return total[ends] - total[ends - per_text]


def repeated_words(numbers: np.ndarray, per_text: np.ndarray, window: int = 8) -> np.ndarray:
    """Per text, how many words lie in a ``window`` of words found twice or more in that text.

    Windows are numbered by doubling - pairs, pairs of pairs, ... - so equal numbers are equal
    windows, without hashing; ``window`` is a power of two."""
    n = len(numbers)
    if not n:
        return np.zeros(len(per_text), np.int64)
    text = np.repeat(np.arange(len(per_text)), per_text)
    place = np.arange(n) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    fits = np.repeat(per_text, per_text) - place >= window
    _, now = np.unique(text * (int(numbers.max()) + 1) + numbers, return_inverse=True)
    size = 1
    while size < window:
        other = np.concatenate([now[size:], np.zeros(min(size, n), now.dtype)])[:n]
        _, now = np.unique(now * (int(now.max()) + 1) + other, return_inverse=True)
        size *= 2
    many = np.bincount(now[fits], minlength=int(now.max()) + 1) > 1
    start = np.flatnonzero(fits & many[now])
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + window, -1)
    return sums((np.cumsum(change[:-1]) > 0).astype(np.int64), per_text)


def word_chars(text: bytes) -> int:
    """Code points in words: those that aren't ASCII white space."""
    return len(text.decode("utf-8")) - sum(text.count(w) for w in WHITE)


def symbols(text: bytes) -> int:
    return sum(text.count(bytes([c])) for c in SYMBOLS)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))
