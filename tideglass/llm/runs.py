"""Runs of like bytes in whole texts (terms, symbols) as 64-bit hashes, computed on a block of texts at once.

A table gives every byte a kind; 0 parts runs, and neighbouring bytes of one kind form a run. A-Z are lower-cased.
Different runs share a hash with a chance of about 2^-64 for each pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tideglass.llm.words import mixed, text_bytes

#: Letters and digits of ASCII and all bytes of other characters: the terms of ranked search.
TERMS = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)], np.uint8)
#: The same, and other printable ASCII as a second kind: words and symbols.
SYMBOLS = np.where(TERMS == 1, 1, np.array([2 if 0x20 < c < 0x7F else 0 for c in range(256)])).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Runs:
    """Hashes of all runs in a row; ``first[d]`` to ``first[d + 1]`` are those of text ``d``."""

    hashes: np.ndarray
    first: np.ndarray


def split_runs(texts: pa.Array, kinds: np.ndarray = TERMS) -> Runs:
    """Runs of every text; a null has none, and no run crosses two texts."""
    raw, offsets = text_bytes(texts)
    n = len(raw)
    if not n:
        return Runs(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    kind = kinds[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero((kind > 0) & edge[:-1])
    sizes = np.flatnonzero((kind > 0) & edge[1:]) + 1 - starts
    padded = np.concatenate((_LOWER[raw], np.zeros(8, np.uint8)))
    eight = np.ndarray((n + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    hashes = mixed(eight[starts] & _MASKS[np.minimum(sizes, 8)] ^ (sizes.astype(np.uint64) * _STEP))
    rest, at = np.flatnonzero(sizes > 8), 8
    while len(rest):
        hashes[rest] = mixed((hashes[rest] + _STEP) ^ (eight[starts[rest] + at] & _MASKS[np.minimum(sizes[rest] - at, 8)]))
        at += 8
        rest = rest[sizes[rest] > at]
    return Runs(hashes, np.searchsorted(starts, offsets))
