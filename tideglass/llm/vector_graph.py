"""A robust-pruned flat graph over one block of unit vectors, and range search in it."""

from __future__ import annotations

import numpy as np

DEGREE = 16
POOL = 48
RANDOM = 12
ALPHA = 1.2
BEAM = 24
STEP = 20_000


def build(x: np.ndarray) -> np.ndarray:
    """Adjacency of each vector, padded with -1: pruned neighbours, and the vectors that have it as one.

    Candidates are the nearest and some random vectors. The nearest one that is left is taken, and those that are nearer
    to it, by the factor ALPHA, than to the vector itself are dropped, so long edges stay and parts hang together.
    """
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1, np.int32)
    near = np.empty((n, min(POOL, n - 1)), np.int32)
    for a in range(0, n, 1_024):
        s = x[a : a + 1_024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -3
        near[a : a + 1_024] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    pool = np.concatenate((near, np.random.default_rng(5).integers(0, n, (n, RANDOM), dtype=np.int32)), axis=1)
    d = np.empty(pool.shape)
    for a in range(0, n, 256):
        d[a : a + 256] = 2 - 2 * np.einsum("nd,nkd->nk", x[a : a + 256], x[pool[a : a + 256]])
    d[pool == np.arange(n)[:, None]] = np.inf
    rows, heads = np.arange(n), []
    for _ in range(DEGREE):
        at = d.argmin(axis=1)
        sure = np.isfinite(d[rows, at])
        if not sure.any():
            break
        head = np.where(sure, pool[rows, at], -1).astype(np.int32)
        heads.append(head)
        for a in range(0, n, 256):
            own = slice(a, a + 256)
            to = 2 - 2 * np.einsum("nd,nkd->nk", x[head[own]], x[pool[own]])
            d[own][(ALPHA * to <= d[own]) | (pool[own] == head[own][:, None])] = np.inf
        d[rows, at] = np.inf
    if not heads:  # all equal
        heads = [np.roll(rows, 1).astype(np.int32)]
    out = np.stack(heads, axis=1)
    # The lists of both directions are united.
    a, k = np.nonzero(out >= 0)
    b = out[a, k].astype(np.int64)
    edges = np.unique(np.concatenate((a * n + b, b * n + a)))
    a, b = edges // n, edges % n
    counts = np.bincount(a, minlength=n)
    both = np.full((n, counts.max()), -1, np.int32)
    both[a, np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)] = b
    return both


def medoids(x: np.ndarray, count: int = 8) -> np.ndarray:
    """The vector nearest to the mean, and then those farthest from all that were taken."""
    first = int((x @ x.mean(axis=0)).argmax())
    out, best = [first], x @ x[first]
    for _ in range(min(count, len(x)) - 1):
        out.append(int(best.argmin()))
        best = np.maximum(best, x @ x[out[-1]])
    return np.array(out)


def range_search(x: np.ndarray, near: np.ndarray, queries: np.ndarray, least: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) with a dot product of ``least`` or more that the search finds.

    A greedy search with a beam goes from the medoids towards each query. All vectors in range that it meets, and the
    query itself if it is one of them (``own``), are then expanded until none in range is new.
    """
    n, q = len(x), len(queries)
    seen = np.zeros((q, n), bool)
    hit = np.zeros((q, n), bool)
    start = np.broadcast_to(medoids(x), (q, len(medoids(x))))
    ids = np.full((q, BEAM), -1, np.int32)
    sims = np.full((q, BEAM), -3.0)
    sims[:, : start.shape[1]] = queries @ x[start[0]].T
    ids[:, : start.shape[1]] = start
    seen[:, start[0]] = True
    hit[:, start[0]] = sims[:, : start.shape[1]] >= least
    done = ids < 0
    active = np.arange(q)
    while len(active):
        best = np.where(done[active], -3, sims[active]).argmax(axis=1)
        live = ~done[active, best]
        active, best = active[live], best[live]
        if not len(active):
            break
        done[active, best] = True
        for a in range(0, len(active), 1_024):
            rows = active[a : a + 1_024]
            step = near[ids[rows, best[a : a + 1_024]]]
            fresh = (step >= 0) & ~seen[rows[:, None], np.maximum(step, 0)]
            s = np.where(fresh, np.einsum("nd,nkd->nk", queries[rows], x[np.maximum(step, 0)]), -3)
            r, k = np.nonzero(fresh)
            seen[rows[r], step[r, k]] = True
            hit[rows[r], step[r, k]] = s[r, k] >= least
            all_s, all_i = np.concatenate((sims[rows], s), axis=1), np.concatenate((ids[rows], np.where(fresh, step, -1)), axis=1)
            all_d = np.concatenate((done[rows], ~fresh), axis=1)
            top = np.argpartition(-all_s, BEAM - 1, axis=1)[:, :BEAM]
            sims[rows], ids[rows], done[rows] = (np.take_along_axis(y, top, axis=1) for y in (all_s, all_i, all_d))
    if own is not None:
        hit[np.arange(q), own] = True
        seen[np.arange(q), own] = True
    a, b = np.nonzero(hit)
    while len(a):
        new_a, new_b = [], []
        for k in range(0, len(a), STEP):
            i = np.repeat(a[k : k + STEP], near.shape[1])
            j = near[b[k : k + STEP]].ravel()
            fresh = (j >= 0) & ~seen[i, np.maximum(j, 0)]
            pairs = np.unique(i[fresh].astype(np.int64) * n + j[fresh])
            i, j = pairs // n, pairs % n
            seen[i, j] = True
            keep = np.concatenate([np.einsum("nd,nd->n", queries[i[m : m + STEP]], x[j[m : m + STEP]]) >= least for m in range(0, len(i), STEP)]) if len(i) else np.zeros(0, bool)
            new_a.append(i[keep])
            new_b.append(j[keep])
        a, b = np.concatenate(new_a), np.concatenate(new_b)
        hit[a, b] = True
    return np.nonzero(hit)
