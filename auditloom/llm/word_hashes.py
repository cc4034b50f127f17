"""Hashes of the words of many texts at once, in numpy, over the bytes of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text joined at once (a longer text is alone), and bytes whose words are hashed at once.
AT_ONCE = 1 << 19
HASHED = 1 << 18
ODD = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the power 0 .. n-1, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, HASHED + 1024), base, np.uint64)
        steps[0] = 1
        _powers[base] = known = np.multiply.accumulate(steps)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about AT_ONCE bytes together."""
    start = size = 0
    for k, x in enumerate(texts):
        if size and size + len(x) > AT_ONCE:
            yield start, k
            start, size = k, 0
        size += len(x) + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, A-Z lowered, each text followed by a line feed; and where each text begins."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    return raw, np.cumsum([0, *(len(x) + 1 for x in texts)])


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of bytes other than space and 9 to 13; raw ends with such a byte.

    A word's hash depends on its bytes alone, so words are hashed in stretches of HASHED bytes; only a longer word needs more.
    """
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    h, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        first = starts[k]
        stop = max(k + 1, int(np.searchsorted(ends, first + HASHED, "right")))
        a, b = starts[k:stop] - first, ends[k:stop] - first
        total = np.zeros(b[-1] + 1, np.uint64)
        np.cumsum((raw[first : ends[stop - 1]].astype(np.uint64) + np.uint64(1)) * powers(ODD, b[-1]), out=total[1:])
        h[k:stop] = (total[b] - total[a]) * powers(INVERSE, b[-1] + 1)[a]
        k = stop
    return starts, ends, mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n hashes, in order."""
    size = len(h) - n + 1
    out = np.zeros(max(size, 0), np.uint64)
    for i in range(n if size > 0 else 0):
        out = mixed(out * np.uint64(3) + h[i : i + size] + np.uint64(i + 1))
    return out
