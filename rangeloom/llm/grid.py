"""Segment popcounts of fingerprints, their grid points, and runs of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENTS = 16  # two-bit segments in each half
POWERS = 3 ** np.arange(SEGMENTS, dtype=np.int64)


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """(n, 2, 16) bit counts of the two-bit segments of both halves."""
    fp = fp.astype(np.uint64)
    pairs = (fp & np.uint64(0x5555555555555555)) + ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return ((pairs[:, None] >> shifts) & np.uint64(3)).astype(np.int64).reshape(-1, 2, SEGMENTS)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the segment counts of two fingerprint arrays."""
    return np.abs(segment_counts(a) - segment_counts(b)).sum(axis=(1, 2))


def grid_points(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points within ``reach`` of both halves of each fingerprint: (row, point)."""
    counts = segment_counts(fp)
    rows, points = [], []
    for half in range(2):
        layer = [(np.arange(len(fp)), counts[:, half] @ POWERS + half * 3**SEGMENTS, np.full(len(fp), -1), counts[:, half])]
        for step in range(reach + 1):
            rows += [r for r, *_ in layer]
            points += [p for _, p, *_ in layer]
            if step == reach:
                break
            grown = []
            for r, p, top, c in layer:
                for i in range(SEGMENTS):
                    for sign in (1, -1):
                        ok = (top <= i) & (c[:, i] + sign >= 0) & (c[:, i] + sign <= 2)
                        if ok.any():
                            moved = c[ok].copy()
                            moved[:, i] += sign
                            grown.append((r[ok], p[ok] + sign * POWERS[i], np.full(int(ok.sum()), i), moved))
            layer = grown
    return np.concatenate(rows), np.concatenate(points)


class Groups:
    """Cuts sorted batches into runs of whole groups; the group that goes on is held back."""

    def __init__(self) -> None:
        self.held: list[list[np.ndarray]] = []

    def add(self, cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        """Columns of the groups that end in ``cols``, whose first column names the group."""
        if not len(cols[0]):
            return
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last or (self.held and self.held[0][0][0] != cols[0][0]):
            first = [c[:last] for c in cols]
            yield [np.concatenate(parts) for parts in zip(*self.held, first, strict=True)] if self.held else first
            self.held = []
        self.held.append([c[last:] for c in cols])

    def rest(self) -> Iterator[list[np.ndarray]]:
        if self.held:
            yield [np.concatenate(parts) for parts in zip(*self.held, strict=True)]
