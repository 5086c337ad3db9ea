"""Suffix arrays with common-prefix values by external induced sorting, in NumPy.

Suffixes are of type S (smaller than the next one) or L. The seeds, S suffixes behind an L one, are sorted first: their
stretches up to the next seed get names in sorted order, and the string of names, about a third as long, is sorted by
doubling ranks. From the sorted seeds all L and then all S suffixes are induced: each sorted suffix yields the one
before it, which goes to the queue of its first byte. Rows enter a queue in sorted order, so the queues together are a
priority queue by (byte, rank of the rest). They carry suffix places and common-prefix values and spill to unnamed
temporary files of the task. The value of two induced suffixes is one more than the least value between their sources.

Work goes in waves: all known suffixes of one first byte are taken together, so Python runs a few steps for each byte
and run length, not for each suffix.
"""

from __future__ import annotations

import tempfile

import numpy as np

BIG = np.int32(2**31 - 2)
MEMORY_ROWS = 1_000_000


class DiskQueue:
    """First-in first-out rows (place, common prefix with the row before) that spill to a file."""

    def __init__(self, memory_rows: int):
        self.memory_rows, self.held, self.rows, self.file, self.used = memory_rows, [], 0, None, False

    def put(self, places: np.ndarray, values: np.ndarray) -> None:
        self.used = True
        self.held.append(np.stack((places.astype(np.int32), values.astype(np.int32)), axis=1))
        self.rows += len(places)
        if self.rows > self.memory_rows:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # noqa: SIM115  unnamed: gone with the task
            for x in self.held:
                self.file.write(x.tobytes())
            self.held, self.rows = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts = self.held
        if self.file is not None:
            self.file.seek(0)
            parts = [np.frombuffer(self.file.read(), np.int32).reshape(-1, 2), *parts]
            self.file.close()
        self.held, self.rows, self.file = [], 0, None
        rows = np.concatenate(parts) if parts else np.zeros((0, 2), np.int32)
        return rows[:, 0].astype(np.int64), rows[:, 1]


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of ``values[low:high]`` for each pair; no range is empty."""
    out = np.empty(len(low), values.dtype)
    level_of = np.frexp((high - low).astype(float))[1] - 1
    order = np.argsort(level_of, kind="stable")
    cuts = np.searchsorted(level_of[order], np.arange(int(level_of.max(initial=0)) + 2))
    table = values
    for level in range(len(cuts) - 1):
        own = order[cuts[level] : cuts[level + 1]]
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << level)])
        if level + 2 < len(cuts):
            table = np.minimum(table[: -(1 << level)], table[1 << level :])
    return out


class _Lane:
    """The queues of one induction, with the least value since the last row of each byte."""

    def __init__(self, memory_rows: int):
        self.queues = [DiskQueue(memory_rows) for _ in range(256)]
        self.least = np.full(256, BIG, np.int32)

    def induce(self, chars: np.ndarray, places: np.ndarray, values: np.ndarray, chosen: np.ndarray) -> None:
        """Queue what precedes the chosen rows of a sorted wave; ``values[i]`` compares row i with the one before."""
        at = np.flatnonzero(chosen)
        at = at[np.argsort(chars[at], kind="stable")]
        own = chars[at]
        least = np.minimum(self.least, values.min())
        if len(at):
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            ends = np.concatenate((starts[1:], [len(at)]))
            inner = np.ones(len(at), bool)
            inner[starts] = False
            inner = np.flatnonzero(inner)
            common = np.empty(len(at), np.int32)
            common[inner] = _range_min(values, at[inner - 1] + 1, at[inner] + 1)
            common[starts] = np.minimum(np.minimum.accumulate(values)[at[starts]], self.least[own[starts]])
            common += 1
            tail = np.append(np.minimum.accumulate(values[::-1])[::-1], BIG)
            least[own[starts]] = tail[at[ends - 1] + 1]
            for c, a, b in zip(own[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
                if not self.queues[c].used:
                    common[a] = 0  # nothing smaller begins with this byte here
                self.queues[c].put(places[at[a:b]] - 1, common[a:b])
        self.least = least


def _names(text: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the stretches from each seed to the next (included), in sorted order; their sizes."""
    sizes = np.append(np.diff(seeds) + 1, 1)
    padded = np.concatenate((text, np.full(8, 255, np.uint8)))
    eight = np.ndarray((len(text) + 1,), ">u8", padded.data, 0, (1,))
    # A stretch that ends is larger than one that goes on with the same bytes: the end counts as the highest byte.
    fill = np.array([(1 << (8 * (8 - k))) - 1 for k in range(9)], np.uint64)

    def key(own: np.ndarray, at: int) -> np.ndarray:
        return eight[seeds[own] + at].astype(np.uint64) | fill[np.minimum(sizes[own] - at, 8)]

    names = np.unique(key(np.arange(len(seeds)), 0), return_inverse=True)[1].astype(np.int64)
    at = 8
    while True:
        many = np.bincount(names)
        open_ = many[names] > 1
        longer = np.zeros(len(many), bool)
        longer[names[open_ & (sizes > at)]] = True
        rest = np.flatnonzero(longer[names])
        if not len(rest):
            return names, sizes
        # Only groups that still have longer members are split; all other names keep their order.
        has = sizes[rest] > at
        more = np.full(len(rest), 2**64 - 1, np.uint64)
        more[has] = key(rest[has], at)
        order = np.lexsort((more, names[rest]))
        new = np.concatenate(([False], (names[rest][order][1:] == names[rest][order][:-1]) & (more[order][1:] != more[order][:-1])))
        inside = np.cumsum(new)
        group = np.concatenate(([True], names[rest][order][1:] != names[rest][order][:-1]))
        inside -= np.maximum.accumulate(np.where(group, inside, 0))
        wide = names * np.int64(len(rest) + 1)
        wide[rest[order]] += inside
        names = np.unique(wide, return_inverse=True)[1].astype(np.int64)
        at += 8


def _sorted_names(names: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the suffixes of a string of names whose last is unique, and their ranks by 1, 2, 4, ... names."""
    n = len(names)
    rank = names.astype(np.int32)
    ranks, step = [rank], 1
    counts = np.bincount(rank)
    start = np.concatenate(([0], np.cumsum(counts)))
    rank = start[rank].astype(np.int32)  # the first place of the group
    while True:
        sized = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(sized[rank] > 1)
        if not len(open_):
            break
        follow = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)], -1).astype(np.int64)
        key = (rank[open_].astype(np.int64) << 32) | (follow + 1)
        order = np.argsort(key, kind="stable")
        own, sorted_key = open_[order], key[order]
        group = sorted_key >> 32
        begins = np.concatenate(([True], group[1:] != group[:-1]))
        differs = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        where = np.arange(len(own))
        base = np.maximum.accumulate(np.where(begins, where, 0))
        rank = rank.copy()
        rank[own] = (group + np.maximum.accumulate(np.where(differs, where, 0)) - base).astype(np.int32)
        ranks.append(rank)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, ranks


def _seed_order(text: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds in suffix order and the bytes each shares with the one before."""
    names, _ = _names(text, seeds)
    order, ranks = _sorted_names(names)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        same = ranks[level][np.minimum(a, len(seeds) - 1)] == ranks[level][np.minimum(b, len(seeds) - 1)]
        a, b = a + (same << level), b + (same << level)
    shared = seeds[a] - seeds[order[:-1]]
    # The names that differ may still begin alike.
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(text) + 1,), "<u8", padded.data, 0, (1,))
    x, y, todo = seeds[a].copy(), seeds[b].copy(), np.arange(len(a))
    while len(todo):
        d = eight[np.minimum(x[todo], len(text))] ^ eight[np.minimum(y[todo], len(text))]
        low = d & (~d + np.uint64(1))
        same = np.where(d == 0, 8, (np.frexp(low.astype(float))[1] - 1) // 8)
        x[todo] += same
        y[todo] += same
        shared[todo] += same
        todo = todo[d == 0]
    return seeds[order], np.concatenate(([0], shared)).astype(np.int32)


def suffix_array(text: np.ndarray, memory_rows: int = MEMORY_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes of ``text`` (bytes 1 to 254) in order, and the bytes each shares with the one before."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    text = np.append(np.asarray(text, np.uint8), np.uint8(0))
    n = len(text)
    begins = np.concatenate(([0], np.flatnonzero(text[1:] != text[:-1]) + 1))
    sizes = np.diff(np.append(begins, n))
    rising = np.append(text[begins[1:]] > text[begins[:-1]], True)
    small, run_end = np.repeat(rising, sizes), np.repeat(begins + sizes, sizes)
    seeds, shared = _seed_order(text, np.flatnonzero(small[1:] & ~small[:-1]) + 1)
    bucket = np.searchsorted(text[seeds], np.arange(257))

    def border(one: int, two: int) -> int:
        """Common prefix of an L and an S suffix of the same byte: the shorter run of it."""
        return int(min(run_end[one] - one, run_end[two] - two))

    def induce(lane: _Lane, places: np.ndarray, values: np.ndarray, of_type: bool) -> None:
        before = np.maximum(places - 1, 0)
        lane.induce(text[before], places, values, (places > 0) & (small[before] == of_type))

    lane, large = _Lane(memory_rows), {}
    for c in range(256):
        waves = []
        while (wave := lane.queues[c].take())[0].size:
            waves.append(wave)
            induce(lane, *wave, False)
        if waves:
            large[c] = tuple(np.concatenate(x) for x in zip(*waves, strict=True))
        a, b = bucket[c], bucket[c + 1]
        if b > a:
            values = shared[a:b].copy()
            values[0] = border(large[c][0][-1], seeds[a]) if waves else 0
            induce(lane, seeds[a:b], values, False)
    lane, ends = _Lane(memory_rows), []
    for c in range(255, 0, -1):
        waves = []
        while (wave := lane.queues[c].take())[0].size:
            waves.append(wave)
            induce(lane, *wave, True)
        down, values = (np.concatenate(x) for x in zip(*waves, strict=True)) if waves else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        up, own = large.pop(c, (np.zeros(0, np.int64), np.zeros(0, np.int32)))
        edge = np.array([border(up[-1], down[-1])] if len(up) and len(down) else [0], np.int32)
        if len(up):
            induce(lane, up[::-1], np.concatenate((edge, own[1:][::-1])), True)
        if len(down):
            ends.append((down[::-1], np.concatenate((edge, values[1:][::-1]))))
        if len(up):
            ends.append((up, own))
    ends.reverse()
    return np.concatenate([x for x, _ in ends]), np.concatenate([v for _, v in ends])
