"""Words of many texts at once, as hashes, with NumPy alone."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (BASE, INVERSE):
            x = np.full(size, b)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def table(breaks: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(breaks)] = True
    return out


SPACE = table(b" \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x00")
#: ASCII white space and punctuation
PUNCT = SPACE | table(bytes(c for c in range(128) if not chr(c).isalnum()))


def buffer(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, a line end after each, and where each begins; one more for the end."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), starts


def spans(buf: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of every word of a buffer that ends with a break."""
    gap = breaks[buf]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    return edge[0::2], edge[1::2]


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever it stands."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.multiply(buf, up[:-1], out=sums[1:], casting="unsafe", dtype=np.uint64)
    sums[1:] += up[:-1]
    np.cumsum(sums[1:], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
