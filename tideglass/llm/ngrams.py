"""Hashed character n-grams of whole texts, computed on a block of texts at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_PLACES = np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x9E3779B1, 0xB5297A4D, 0x68E31DA5, 0x1B56C4E9], np.uint32)
#: ASCII other than letters counts as a space.
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def code_points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters of all texts in a row, each text between two spaces, and where each begins."""
    own = [f" {t.lower()} " if t else "  " for t in texts]
    first = np.concatenate(([0], np.cumsum([len(t) for t in own]))).astype(np.int64)
    points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    plain = points < 128
    points[plain] = _ASCII[points[plain]]
    return points, first


def hashed(points: np.ndarray, first: np.ndarray, orders: Sequence[int], bits: int) -> list[np.ndarray]:
    """For each order a number below 2^bits at every place; 2^bits where the n-gram would leave its text."""
    n, out, total, size = len(points), [], np.zeros(len(points), np.uint32), 0
    padded = np.concatenate((points, np.zeros(max(orders), np.uint32)))
    for order in sorted(orders):
        for k in range(size, order):
            total = total + padded[k : k + n] * _PLACES[k]
        size = order
        x = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(order)
        x = ((x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)) >> np.uint32(32 - bits)
        x = x.astype(np.int32)
        for k in range(order - 1):
            at = first[1:] - 1 - k
            x[at[at >= 0]] = 1 << bits
        out.append(x)
    return out
