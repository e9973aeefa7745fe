"""Byte-pair merges of many short words at once, on arrays.

All words lie one after the other in one array of token ids beside the rank of each id's pair with
the next. A round takes the lowest rank of every word, merges its leftmost pair of that rank, and
looks up the two pairs that are new; words without a pair left leave the arrays. The number of
rounds is that of the longest word's merges.
"""

from __future__ import annotations

import json

import numpy as np

#: No merge.
NONE = np.int32(2**31 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    """The merges of a byte-pair vocabulary: (left id, right id, merged id) in rank order."""

    def __init__(self, byte_ids: list[int], merges: list[tuple[int, int, int]]):
        self.byte_ids = np.array(byte_ids, np.int32)
        table = np.array(merges, np.int64).reshape(-1, 3)
        self.made = table[:, 2].astype(np.int32)
        keys = self._keys(table[:, 0], table[:, 1])
        bits = max(10, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << bits, NONE, np.int32)
        left = np.arange(len(keys) - 1, -1, -1)  # of a pair listed twice the first rank counts
        _, first = np.unique(keys, return_index=True)
        left = left[np.isin(left, first)]
        slot = self._slots(keys)
        while len(left):
            free = left[self.rank[slot[left]] == NONE]
            at, own = np.unique(slot[free], return_index=True)
            self.key[at], self.rank[at] = keys[free[own]], free[own]
            left = np.setdiff1d(left, free[own])
            slot[left] = slot[left] + 1 & self.mask

    @classmethod
    def of_library(cls, library, letters: dict[str, int]) -> Merges:
        """The merges of a byte-level ``tokenizers`` model; ``letters`` are the bytes of its characters."""
        model = json.loads(library.to_str())["model"]
        ids = model["vocab"]
        byte_ids = [0] * 256
        for c, b in letters.items():
            byte_ids[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls(byte_ids, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _ODD >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair."""
        keys = self._keys(left, right)
        slot = self._slots(keys)
        out = self.rank[slot]
        other = np.flatnonzero((self.key[slot] != keys) & (out != NONE))
        out[other] = NONE
        while len(other):
            slot[other] = at = slot[other] + 1 & self.mask
            rank, same = self.rank[at], self.key[at] == keys[other]
            out[other[same]] = rank[same]
            other = other[~same & (rank != NONE)]
        return out

    def merge(self, octets: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, given as their bytes one after the other and their sizes (1 at least),
        and how many ids each word has."""
        ids, size = self.byte_ids[octets], size.astype(np.int64)
        number = np.arange(len(size))
        start = np.cumsum(size) - size
        rank = np.full(len(ids), NONE, np.int32)
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[start + size - 1] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(size):
            best = np.minimum.reduceat(rank, start)
            over = best == NONE
            if over.any():
                of = np.repeat(over, size)
                done.append((number[over], size[over], ids[of]))
                ids, rank, number, size, best = ids[~of], rank[~of], number[~over], size[~over], best[~over]
                start = np.cumsum(size) - size
                if not len(size):
                    break
            low = np.flatnonzero(rank == np.repeat(best, size))
            word = np.searchsorted(start, low, "right") - 1
            at = low[np.concatenate([[True], word[1:] != word[:-1]])]  # the leftmost of each word
            ids[at] = self.made[best]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            size = size - 1
            start = np.cumsum(size) - size
            at = at - np.arange(len(at))
            rank[at] = NONE
            more = at[at + 1 < start + size]
            rank[more] = self.ranks(ids[more], ids[more + 1])
            more = at[at > start]
            rank[more - 1] = self.ranks(ids[more - 1], ids[more])
        if not done:
            return np.zeros(0, np.int32), size
        number, size, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(number, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        count = size[order]
        step = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
        return ids[np.repeat(begin, count) + step], count
