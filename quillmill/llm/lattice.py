"""The E8 lattice: nearest points and nearest neighbouring cells, vectorised."""

from __future__ import annotations

import functools
import itertools

import numpy as np


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer vectors with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(near.sum(1).astype(np.int64) % 2)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1, -1)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest lattice points of rows of eight coordinates."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors, which lead to the neighbouring cells."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def probes(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest point and `count` neighbouring points, nearest first
    (rows, count + 1, 8), and how much farther they are than the nearest, squared."""
    home = nearest(x)
    gain = (x - home) @ neighbours().T
    best = np.argsort(-gain, axis=1, kind="stable")[:, :count]
    farther = 2 - 2 * np.take_along_axis(gain, best, 1)
    points = np.concatenate([home[:, None], home[:, None] + neighbours()[best]], 1)
    return points, np.concatenate([np.zeros((len(x), 1)), farther], 1)
