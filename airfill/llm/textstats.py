"""Statistics of whole texts for classifiers: shares and means over characters, words and lines."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

from airfill.llm import wordstats

STATISTICS = ["words", "mean_word", "symbols", "uppers", "digits", "signs", "exclaims", "repeated_lines",
              "repeated_words", "stutter", "distinct", "top_word", "line_words", "closed_lines", "letters"]
_UPPER, _DIGIT, _LETTER, _SIGN = 1, 2, 4, 8


@lru_cache(1)
def flags() -> np.ndarray:
    """Bits of every code point: upper case, digit, letter, other sign."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))
        out[i] = ((_UPPER if kind in ("Lu", "Lt") else 0) | (_DIGIT if kind[0] == "N" else 0)
                  | (_LETTER if kind[0] == "L" else 0) | (_SIGN if kind[0] in "PS" else 0))
    return out


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``STATISTICS`` per text; a share of nothing is 0."""
    words, numbers, per_text = wordstats.numbered(texts)
    decoded = [t.decode("utf-8") for t in texts]
    sizes = np.array([len(t) for t in decoded], np.int64)
    bits = flags()[np.frombuffer("".join(decoded).encode("utf-32-le"), np.uint32)]
    count = lambda bit: wordstats.sums((bits & bit > 0).astype(np.int64), sizes)
    chars = np.array([wordstats.word_chars(t) for t in texts])
    upper, digit, letter, sign = map(count, (_UPPER, _DIGIT, _LETTER, _SIGN))
    text = np.repeat(np.arange(len(texts)), per_text)
    same = np.zeros(len(numbers), np.int64)
    same[1:] = (numbers[1:] == numbers[:-1]) & (text[1:] == text[:-1])
    keys, n = np.unique(text * (len(words) + 1) + numbers, return_counts=True)
    distinct = np.bincount(keys // (len(words) + 1), minlength=len(texts))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, keys // (len(words) + 1), n)
    lines = [[x.strip() for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines])
    closed = np.array([sum(x.endswith((b".", b"!", b"?", b":", b";")) for x in own) for own in lines])
    repeated = np.array([len(x) - len(set(x)) for x in lines])
    some = lambda x: np.maximum(x, 1)
    return np.column_stack([
        np.log1p(per_text), chars / some(per_text), np.array([wordstats.symbols(t) for t in texts]) / some(chars),
        upper / some(letter), digit / some(chars), sign / some(chars),
        np.array([t.count(b"!") for t in texts]) / some(per_text), repeated / some(n_lines),
        wordstats.repeated_words(numbers, per_text) / some(per_text), wordstats.sums(same, per_text) / some(per_text),
        distinct / some(per_text), top / some(per_text), per_text / some(n_lines), closed / some(n_lines),
        letter / some(chars)]).astype(float)
