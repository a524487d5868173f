"""Content-sampled suffixes of byte strings, in numpy.

A window is a run of ``window`` bytes.  Of the ``gram``-byte strings inside a
window the leftmost one of least hash is the window's *anchor*, so two equal
windows have equal anchors at equal offsets: comparing the suffixes that start
at anchors is enough to compare all windows.  Neighbouring windows mostly share
their anchor; a maximal run of such windows is a *span*.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_SEED = 0x5EED


def _inverse(x: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    y = x
    for _ in range(6):
        y = y * (2 - x * y) & (1 << 64) - 1
    return y


_BASE = 0x9E3779B97F4A7C15 | 5
_LETTERS = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, _inverse(_BASE)):
        steps = np.full(n, base, dtype=U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit word over all others."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Rolling:
    """Hashes of any substrings of one byte array, each in constant time."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(10, int(len(data)).bit_length())
        self.up, self.down = _powers(n)
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(_LETTERS[data] * self.up[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """Of all substrings of one size."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours (van Herk, 1992)."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    block = padded.reshape(rows, width)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def spans(data: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """The spans of texts laid end to end.

    ``ends`` has the end of each text in ``data``.  Returns arrays: first and
    last window start of the span, hash of its anchor, hash of all its bytes
    (with the anchor's place in it), and the Rolling itself.
    """
    roll = Rolling(data)
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < window:
        return empty, empty, empty.astype(U), empty.astype(U), roll
    grams = roll.every(gram)
    place = np.arange(len(grams), dtype=U)
    least = _sliding_min((grams & U(0xFFFFFFFF00000000)) | place, window - gram + 1)
    anchor = (least & U(0xFFFFFFFF)).astype(np.int64)
    n = len(anchor)
    inside = np.ones(n, dtype=bool)
    edge = np.zeros(n + 1, dtype=np.int32)  # windows that cross the end of a text
    inner = ends[:-1] if len(ends) and ends[-1] == len(data) else ends
    np.add.at(edge, np.clip(inner - window + 1, 0, n), 1)
    np.add.at(edge, np.clip(inner, 0, n), -1)
    inside = np.cumsum(edge[:-1]) == 0
    new = np.ones(n, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new |= ~inside
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    at = anchor[first]
    whole = roll.at(first, last + window)
    shape = ((at - first).astype(U) << U(20)) + (last - first).astype(U)
    return first, last, grams[at], mix(whole ^ mix(shape + U(1))), roll
