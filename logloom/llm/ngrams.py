"""Packed character n-grams and sorted-array counts, shared by the language models and filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters worked on at once; longer runs of texts are cut, n-grams across a cut are kept.
PART = 1 << 20
#: Distinct n-grams a task holds before it hands its counts on; Spark adds them up again.
HELD = 1 << 21


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def parts(codes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """codes in pieces of about PART, each with the n - 1 symbols before it."""
    for at in range(0, max(len(codes) - n + 1, 1), PART):
        yield codes[at : at + PART + n - 1]


def merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted array of keys with the sums of their counts."""
    if len(counts) == 1:
        return counts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in counts]), len(keys)).astype(np.int64)


class Counts:
    """Counts by label, held as sorted arrays and merged as they double in size."""

    def __init__(self) -> None:
        self.of: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, label: str, keys: np.ndarray) -> None:
        own = self.of.setdefault(label, [])
        own.append(np.unique(keys, return_counts=True))
        while len(own) > 1 and len(own[-2][0]) <= 2 * len(own[-1][0]):
            own[-2:] = [merged(own[-2:])]

    def size(self) -> int:
        return sum(len(k) for own in self.of.values() for k, _ in own)

    def take(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for label, own in self.of.items():
            yield label, *merged(own)
        self.of = {}
