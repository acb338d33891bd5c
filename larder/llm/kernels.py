"""Vectorised hashing over packed texts, for use inside tasks."""

from __future__ import annotations

import numpy as np

#: Base of the polynomial hashes and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, factor in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, factor, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ranges() takes the hash of any range."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values))[0], out=out[1:])
    return out


def ranges(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]; equal ranges have equal hashes, wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, a space after each text; where each text begins (and where the last one's successor would)."""
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8), at


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each text."""
    edge = np.diff((~IS_SPACE[buf]).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, np.searchsorted(starts, at)


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values, for each position that has n."""
    m = max(0, len(values) - n + 1)
    prefix = prefix_hashes(values)
    return mix((prefix[n : n + m] - prefix[:m]) * powers(len(prefix))[1][:m])


def member(owner: np.ndarray, value: np.ndarray, of_owner: np.ndarray, of_value: np.ndarray) -> np.ndarray:
    """Whether each (owner, value) is among the others, by a 64-bit mix of both."""
    blend = lambda o, v: mix(v.view(np.uint64) ^ mix(o.astype(np.uint64) + np.uint64(1)))
    return np.isin(blend(owner, value), blend(of_owner, of_value))


def window_argmin(h: np.ndarray, width: int, tile: int = 1 << 22) -> np.ndarray:
    """Position of the smallest (first of equals) of h[i:i+width], for each i with width values."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.empty(m, dtype=np.int64)
    for lo in range(0, m, tile):
        hi = min(m, lo + tile)
        part = h[lo : hi + width - 1]
        low = np.uint64((1 << 24) - 1)
        full = -(-len(part) // width) * width
        key = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
        key[: len(part)] = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        grid = key.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        out[lo:hi] = lo + (np.minimum(back[: hi - lo], ahead[width - 1 : width - 1 + hi - lo]) & low).astype(np.int64)
    return out


def fingerprints(h: np.ndarray, width: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their smallest gram.

    h: gram hashes; a window is width of them. first, last: the first window of each text, and one past its last.
    Returns per run: the text's number, first window, one past the last window, fingerprint. A fingerprint is a function of
    the window's content alone, so equal windows of any two texts have the same; a run ends where the fingerprint changes.
    """
    least = window_argmin(h, width)
    n = np.maximum(last - first, 0)
    owner = np.repeat(np.arange(len(first)), n)
    if not len(owner):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    win = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    fp = h[least[win]]
    new = np.ones(len(win), dtype=bool)
    new[1:] = (fp[1:] != fp[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(win)) - 1
    return owner[at], win[at], win[end] + 1, fp[at].view(np.int64)


def least_positions(h: np.ndarray, width: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, fingerprint) of each distinct position that is some window's smallest gram."""
    least = window_argmin(h, width)
    n = np.maximum(last - first, 0)
    owner = np.repeat(np.arange(len(first)), n)
    if not len(owner):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    pos = least[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (pos[1:] != pos[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[pos[new]].view(np.int64)


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, sorted intervals that cover the same points; touching ones are joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    at = np.flatnonzero(new)
    return s[at], np.append(e[at[1:] - 1], e[-1])
