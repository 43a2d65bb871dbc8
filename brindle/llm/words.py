"""Words of many texts at once, as 64-bit hashes in numpy, and runs of words.

Words are the maximal runs of letters and digits of any script, after problem 4's consistent form and in lower case.
A batch is laid out as one array of code points; a word's hash is a difference of prefix sums of a polynomial modulo
2^64, so that no Python object is made for a word.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .canonical import transducer

BASE = 0x9E3779B97F4A7C15
#: Code points laid out at a time; a longer single text is laid out alone.
BLOCK = 400_000


@cache
def _alnum() -> np.ndarray:
    t = np.zeros(0x110000, bool)
    t[[c for c in range(0x32000) if chr(c).isalnum()]] = True
    return t


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 70_000)
        inverse = pow(BASE, -1, 1 << 64)
        for name, b in (("up", BASE), ("down", inverse)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:  # doubling: p[done:2*done] = p[:done] * b^done
                take = min(done, size - done)
                p[done : done + take] = p[:take] * np.uint64(pow(b, done, 1 << 64))
                done += take
            _POWERS[name] = p
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def plain(text: str) -> str:
    return transducer()(text).lower()


def _block(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(n)
    if not len(chars):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    flag = np.zeros(len(chars) + 2, np.int8)
    flag[1:-1] = _alnum()[chars]
    step = np.diff(flag)
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _powers(len(chars))
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(0x1234567)) * up, out=total[1:])
    words = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    at = np.zeros(len(texts) + 1, np.int64)
    at[1:] = np.searchsorted(start, ends)
    return words, at


def grid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (which are in plain form already), and where each text's words begin; the last
    entry is their number."""
    parts, offsets, base, now, size = [], [np.zeros(1, np.int64)], 0, [], 0

    def flush() -> None:
        nonlocal base, now, size
        if now:
            w, at = _block(now)
            parts.append(w)
            offsets.append(at[1:] + base)
            base += len(w)
            now, size = [], 0

    for t in texts:
        if size and size + len(t) > BLOCK:
            flush()
        now.append(t)
        size += len(t) + 1
    flush()
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate(offsets)


def runs(words: np.ndarray, at: np.ndarray, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words in a row and where each text's runs begin. A text of fewer than n words is one
    run (of no word at all, too)."""
    length = np.diff(at)
    count = np.maximum(length - n + 1, 1)
    to = np.zeros(len(at), np.int64)
    np.cumsum(count, out=to[1:])
    if not len(length):
        return np.empty(0, np.uint64), to
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    first = np.repeat(at[:-1] - to[:-1], count) + np.arange(to[-1])
    h = np.zeros(len(first), np.uint64)
    short = np.repeat(length < n, count)
    left = np.repeat(length, count)
    for k in range(n):
        w = padded[np.minimum(first + k, len(padded) - 1)]
        if short.any():
            w = np.where(short & (k >= left), np.uint64(0x5BD1E995), w)
        h = mix(h * np.uint64(BASE) + w + np.uint64(k + 1))
    return h, to


def text_hashes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash of each text's whole sequence of words."""
    n = len(words)
    up, down = _powers(max(n, 1) + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    lo, hi = at[:-1], at[1:]
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))
