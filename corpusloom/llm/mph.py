"""Minimal perfect hashing of 64-bit keys in numpy, with the keys stored by slot to verify look-ups.

Each round marks the places that one key alone hashes to, in a table of twice as many bits as keys are left; the others go to
the next round. A key's slot is the number of marks before its own. Any key finds some slot or none, so its stored key decides.
"""

from __future__ import annotations

import numpy as np

_ROUNDS = 64


def mixed(keys: np.ndarray, turn: int) -> np.ndarray:
    """Another hash of unsigned 64-bit keys for each turn; one to one."""
    x = (keys ^ np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Table:
    """Slots 0 to n - 1 of n different keys. ``keys`` has them by slot."""

    def __init__(self, keys: np.ndarray):
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []  # words of 64 marks, and how many marks were before each word
        left, before = np.asarray(keys, np.uint64), 0
        self.keys = np.empty(len(left), np.uint64)
        while len(left):
            if len(self.rounds) == _ROUNDS:
                raise ValueError("keys are not all different")
            words = -(-max(64, 2 * len(left)) // 64)
            place = mixed(left, len(self.rounds)) % np.uint64(64 * words)
            alone = np.bincount(place.astype(np.int64), minlength=64 * words) == 1
            marks = np.packbits(alone.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
            counts = np.bitwise_count(marks).astype(np.int64)
            self.rounds.append((marks, before + np.cumsum(counts) - counts))
            hit = alone[place.astype(np.int64)]
            self.keys[self._slots(left[hit], place[hit], -1)] = left[hit]
            before += int(counts.sum())
            left = left[~hit]

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, keys: np.ndarray, place: np.ndarray, turn: int) -> np.ndarray:
        marks, before = self.rounds[turn]
        word = (place >> np.uint64(6)).astype(np.int64)
        lower = (np.uint64(1) << (place & np.uint64(63))) - np.uint64(1)
        return before[word] + np.bitwise_count(marks[word] & lower).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the table."""
        out = np.full(len(keys), -1, np.int64)
        at, left = np.arange(len(keys)), np.asarray(keys, np.uint64)
        for turn, (marks, _) in enumerate(self.rounds):
            place = mixed(left, turn) % np.uint64(64 * len(marks))
            hit = (marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            slots = self._slots(left[hit], place[hit], turn)
            same = self.keys[slots] == left[hit]
            out[at[hit][same]] = slots[same]
            at, left = at[~hit], left[~hit]
            if not len(at):
                break
        return out
