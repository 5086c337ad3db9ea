"""Words and word shingles of whole texts as 64-bit hashes, computed on a block of texts at once.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. Different words share a hash with a
chance of about 2^-64 for each pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Odd factors of the places in a shingle.
_PLACES = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xD6E8FEB86659FD93, 0xCA5A826395121157, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a block: hashes and byte places; ``first[d]`` to ``first[d + 1]`` are those of text ``d``."""

    hashes: np.ndarray
    starts: np.ndarray  # byte places in the text
    ends: np.ndarray
    first: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins; a null is empty."""
    texts = texts.cast(pa.large_binary())
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.frombuffer(b"".join(x for x in texts.to_pylist() if x), np.uint8)
    return raw, offsets


def split_words(texts: pa.Array) -> Words:
    raw, offsets = text_bytes(texts)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(texts) + 1, np.int64))
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    padded = np.concatenate((_LOWER[raw], np.zeros(8, np.uint8)))
    eight = np.ndarray((n + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    sizes = ends - starts
    hashes = mixed(eight[starts] & _MASKS[np.minimum(sizes, 8)] ^ (sizes.astype(np.uint64) * _M1))
    rest, at = np.flatnonzero(sizes > 8), 8
    while len(rest):
        hashes[rest] = mixed((hashes[rest] + _M1) ^ (eight[starts[rest] + at] & _MASKS[np.minimum(sizes[rest] - at, 8)]))
        at += 8
        rest = rest[sizes[rest] > at]
    first = np.searchsorted(starts, offsets)
    owner = np.repeat(offsets[:-1], np.diff(first))
    return Words(hashes, starts - owner, ends - owner, first)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in a row, repeats included, and where those of each text begin.

    A text with fewer words than ``size`` has its whole sequence as its one shingle, a text without words none.
    """
    counts = np.diff(words.first)
    n = len(words.hashes)
    own = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(own)))
    if not n:
        return np.zeros(0, np.uint64), first
    padded = np.concatenate((words.hashes, np.zeros(size, np.uint64)))
    whole = np.zeros(n, np.uint64)
    for k in range(size):
        whole += padded[k : k + n] * _PLACES[k]
    # Places of the shingles: all but the last size - 1 words of a text.
    place = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], own)
    out = whole[place]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        own = words.hashes[words.first[d] : words.first[d + 1]]
        out[first[d] : first[d] + 1] = np.sum(own * _PLACES[: len(own)], keepdims=True) + counts[d : d + 1].astype(np.uint64) * _M1
    return mixed(out), first
