"""Hashes of words and of runs of symbols, vectorised in numpy.

Nothing here is linear: a word's value chains its bytes, eight at a time, through a mixer, and the
hash of a run of symbols is built by doubling from the mixed hashes of its halves.  (Polynomial
sums modulo a power of two collide on Thue-Morse sequences whatever their base.)  Hashes choose
candidates; what is removed or linked is compared by its own words or bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: White space of every contract: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer words are hashed one by one.
LONG_WORD = 64

_ONE, _TWO, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring runs from theirs."""
    return mix(left * _ONE + right * _TWO)


def windows(values: np.ndarray, k: int, stride: int = 1) -> np.ndarray:
    """Hash of each run of ``k`` symbols, ``stride`` places apart; their number is part of it."""
    if len(values) <= (k - 1) * stride:
        return np.zeros(0, np.uint64)
    out, have = values, 1
    while have < k:
        step = min(have, k - have)
        out = join(out[: len(out) - step * stride], out[step * stride :])
        have += step
    return mix(out + np.uint64(k * int(_LENGTH) & 0xFFFFFFFFFFFFFFFF))


def fold(columns: np.ndarray) -> np.ndarray:
    """One hash for each row of a matrix."""
    out = mix(columns[:, 0].astype(np.uint64))
    for c in columns.T[1:]:
        out = join(out, c.astype(np.uint64))
    return out


def eights(data: np.ndarray, n: int | None = None) -> np.ndarray:
    """The eight bytes from each place on as a number; past the end are zeros."""
    n = len(data) if n is None else n
    padded = np.zeros(max(n, len(data)) + 16, np.uint8)
    padded[: len(data)] = data
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        m = (n - o + 7) // 8
        out[o::8] = padded[o : o + 8 * m].view("<u8")
    return out


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` bytes, a multiple of eight."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    return windows(mix(eights(data, len(data) - 7)), k // 8, 8)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are not white space."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~SPACE[data]
    edges = np.diff(solid)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word; words of at most eight bytes and one length never share one."""
    left = ends - starts
    out = mix(left.astype(np.uint64) * _LENGTH)
    if not len(left):
        return out
    chunks, at, live = eights(data), starts.copy(), np.arange(len(left))
    long = left > LONG_WORD
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    if long.any():
        live = live[~long]
    while len(live):
        n = left[live]
        out[live] = mix(out[live] + (chunks[at[live]] & _FIRST_BYTES[np.minimum(n, 8)]))
        live = live[n > 8]
        left[live] -= 8
        at[live] += 8
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive items, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def chosen_places(grams: np.ndarray, w: int) -> np.ndarray:
    """Places that some window of ``w`` grams chooses as its smallest (winnowing).

    Equal windows choose equal offsets.  Among equal grams a window chooses the last; each
    place that could be meant is returned.
    """
    m = len(grams) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    low = sliding_min(grams, w)
    entering = np.flatnonzero(grams[w - 1 :] == low) + w - 1
    risen = np.append(0, np.flatnonzero(low[1:] > low[:-1]) + 1)
    view, inside = np.lib.stride_tricks.sliding_window_view(grams, w), []
    for a in range(0, len(risen), 1024):
        part = risen[a : a + 1024]
        i, j = np.nonzero(view[part] == low[part][:, None])
        inside.append(part[i] + j)
    return np.unique(np.concatenate([entering, *inside]))


def window_places(grams: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` grams, the place of its smallest gram, the last of equals."""
    at = np.arange(len(grams))
    have = 1
    while have < w:
        step = min(have, w - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(grams[right] <= grams[left], right, left)
        have += step
    return at[: max(0, len(grams) - w + 1)]


def blocks(n: int, length: int, size: int = 1 << 19):
    """(start, end) symbol ranges that hold each window of ``length`` symbols exactly once."""
    for a in range(0, n - length + 1, size):
        yield a, min(n, a + size + length - 1)
