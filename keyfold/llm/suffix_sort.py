"""Blockwise suffix sorting with a difference cover, in numpy.

A set of residues modulo ``v`` is a difference cover when any two residues reach it by the same
shift below ``v``.  Positions in the cover are ranked once; two suffixes that agree on ``v`` bytes
are then ordered by the ranks at their common shift, however long they agree.  So suffixes can be
sorted one block at a time, each block by a few bytes and its long ties by lookups.
"""

from __future__ import annotations

import functools

import numpy as np

V = 32
BLOCK = 1 << 18


@functools.cache
def difference_cover(v: int = V) -> tuple[np.ndarray, np.ndarray]:
    """(residues, shift): greedy cover, and the shift that takes residues i and j into it."""
    cover, reached = [0], {0}
    while len(reached) < v:
        gain = lambda c: len({(c - x) % v for x in cover} | {(x - c) % v for x in cover} | reached)
        best = max((c for c in range(v) if c not in cover), key=gain)
        cover.append(best)
        reached |= {(best - x) % v for x in cover} | {(x - best) % v for x in cover}
    cover.sort()
    inside = np.isin(np.arange(v), cover)
    shift = np.zeros((v, v), np.int64)
    for i in range(v):
        for j in range(v):
            shift[i, j] = next(d for d in range(v) if inside[(i + d) % v] and inside[(j + d) % v])
    return np.array(cover), shift


def _dense(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(True, differs))
    return out


def byte_keys(padded: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes at each place as a big-endian number."""
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        m = (n - o + 7) // 8
        out[o::8] = padded[o : o + 8 * m].view(">u8")
    return out


def cover_ranks(keys: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Rank (from 1) of the cover's positions by at least ``depth`` bytes; 0 elsewhere and past the end."""
    cover, _ = difference_cover()
    at = (np.arange(0, n, V)[:, None] + cover).ravel()
    at = at[at < n]
    rank = np.zeros(len(keys) + 2 * max(depth, V), np.int64)
    if not len(at):
        return rank
    order = np.lexsort([keys[at + o] for o in range(V - 8, -1, -8)])
    differs = np.zeros(len(at) - 1, bool)
    for o in range(0, V, 8):
        k = keys[at + o][order]
        differs |= k[1:] != k[:-1]
    rank[at] = _dense(order, differs)
    have = V
    while have < depth:
        pair = (rank[at] << 32) | rank[at + have]
        order = np.argsort(pair, kind="stable")
        p = pair[order]
        rank[at] = _dense(order, p[1:] != p[:-1])
        have *= 2
    return rank


def _sort_ties(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sort the members of each group (they agree on V bytes) by cover ranks: quicksort of all groups at once."""
    _, shift = difference_cover()
    at, live = at.copy(), np.arange(len(at))
    group = group.copy()
    while len(live):
        x, g = at[live], group[live]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(first, len(g)))
        pivot = np.repeat(x[first + size // 2], size)
        d = shift[x % V, pivot % V]
        side = np.sign(rank[x + d] - rank[pivot + d]) + 1
        key = np.repeat(np.arange(len(first)), size) * 3 + side
        order = np.argsort(key, kind="stable")
        at[live] = x[order]
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        number = np.cumsum(new) - 1
        group[live] = number
        alone = np.bincount(number)[number] == 1
        live = live[~alone & (key % 3 != 1)]
    return at


def sorted_blocks(text: np.ndarray, at: np.ndarray, depth: int):
    """Suffixes ``at`` in order of their first ``depth`` bytes at least, as (block, starts-a-new-prefix) pairs.

    The second array tells for each suffix whether its first ``depth`` bytes differ from its
    predecessor's; blocks hold whole ranges of the first eight bytes.
    """
    n = len(text)
    padded = np.zeros(n + depth + 2 * V + 16, np.uint8)
    padded[:n] = text
    keys = byte_keys(padded, n + depth + 2 * V)
    rank = cover_ranks(keys, n, depth)
    head = keys[at]
    if len(at) > BLOCK:
        picks = np.unique(np.sort(head[:: max(1, len(at) // (8 * (len(at) // BLOCK + 1)))])[::8])
        block = np.searchsorted(picks, head, side="right")
        by = np.argsort(block, kind="stable")
        parts = np.split(at[by], np.flatnonzero(np.diff(block[by])) + 1)
    else:
        parts = [at] if len(at) else []
    steps = [*range(0, depth - 7, 8), depth - 8]
    for part in parts:
        order = np.lexsort([keys[part + o] for o in range(V - 8, -1, -8)])
        x = part[order]
        differs = np.zeros(len(x) - 1, bool)
        for o in range(0, V, 8):
            k = keys[x + o]
            differs |= k[1:] != k[:-1]
        group = np.cumsum(np.append(0, differs))
        tied = np.bincount(group)[group] > 1
        x[tied] = _sort_ties(x[tied], group[tied], rank)
        same = np.flatnonzero(~differs)
        for o in steps:
            same = same[keys[x[same] + o] == keys[x[same + 1] + o]]
        new = np.ones(len(x), bool)
        new[same + 1] = False
        yield x, new


def repeated(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Those places of ``at`` (ascending) whose ``length`` bytes also start at another; a bool array."""
    out = np.zeros(len(text) + 1, bool)
    for x, new in sorted_blocks(text, at, length):
        alone = new & np.append(new[1:], True)
        out[x[~alone]] = True
    return out[at]
