"""QR codes of versions 3 and 4, level L, byte mode (ISO/IEC 18004)."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Version, data codewords, error-correction codewords.
VERSIONS = ((3, 55, 15), (4, 80, 20))
FIELD = 0x11D
QUIET = 4


@cache
def _field() -> tuple[list[int], list[int]]:
    """Powers of 2 in GF(256), twice over, and logarithms."""
    powers, x = [], 1
    for _ in range(255):
        powers.append(x)
        x = x << 1 ^ (FIELD if x & 128 else 0)
    logs = [0] * 256
    for i, v in enumerate(powers):
        logs[v] = i
    return powers * 2, logs


def multiply(a: int, b: int) -> int:
    powers, logs = _field()
    return powers[logs[a] + logs[b]] if a and b else 0


@cache
def generator(n: int) -> tuple[int, ...]:
    """Coefficients of (x - 1)(x - 2)...(x - 2**(n-1)), highest first."""
    out = [1]
    for i in range(n):
        root = _field()[0][i]
        out = [a ^ multiply(b, root) for a, b in zip([*out, 0], [0, *out], strict=True)]
    return tuple(out)


def check_words(data: bytes, n: int) -> bytes:
    """Remainder of the data, times x**n, by the generator."""
    rest = list(data) + [0] * n
    for i in range(len(data)):
        lead = rest[i]
        for k, g in enumerate(generator(n)):
            rest[i + k] ^= multiply(g, lead)
    return bytes(rest[-n:])


def pick_version(size: int) -> tuple[int, int, int] | None:
    return next((v for v in VERSIONS if size + 2 <= v[1]), None)


def codewords(text: bytes, words: int, checks: int) -> bytes:
    """Mode, length, bytes, end and padding, then the check words."""
    bits = f"0100{len(text):08b}" + "".join(f"{b:08b}" for b in text)
    bits += "0" * min(4, words * 8 - len(bits))
    bits += "0" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    data = (data + b"\xec\x11" * words)[:words]
    return data + check_words(data, checks)


@cache
def _frame(version: int) -> tuple[np.ndarray, np.ndarray]:
    """(modules, which are fixed) of the finders, timing, alignment and format areas."""
    n = 17 + 4 * version
    dark, fixed = np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=bool)
    ring = lambda size, *radii: np.isin(np.maximum(*np.abs(np.mgrid[:size, :size] - size // 2)), radii)
    fixed[:9, :9] = fixed[:9, -8:] = fixed[-8:, :9] = True
    for y, x in ((0, 0), (0, n - 7), (n - 7, 0)):
        dark[y : y + 7, x : x + 7] = ring(7, 0, 1, 3)
    line = np.arange(8, n - 8)
    dark[6, line] = dark[line, 6] = line % 2 == 0
    fixed[6, line] = fixed[line, 6] = True
    c = 4 * version + 8
    dark[c : c + 5, c : c + 5], fixed[c : c + 5, c : c + 5] = ring(5, 0, 2), True
    dark[4 * version + 9, 8] = True
    return dark, fixed


def mask(k: int, n: int) -> np.ndarray:
    i, j = np.mgrid[:n, :n]
    both = i * j
    return (
        (i + j) % 2, i % 2, j % 3, (i + j) % 3, (i // 2 + j // 3) % 2,
        both % 2 + both % 3, (both % 2 + both % 3) % 2, ((i + j) % 2 + both % 3) % 2,
    )[k] == 0


def penalty(m: np.ndarray) -> int:
    """Runs, blocks, finder look-alikes and imbalance."""
    total = 0
    for line in (*m, *m.T):
        ends = np.flatnonzero(np.diff(line.astype(np.int8), prepend=2, append=2))
        runs = np.diff(ends)
        total += int((runs[runs >= 5] - 2).sum())
        text = "".join("1" if v else "0" for v in line)
        at = text.find("1011101")
        while at >= 0:
            if text[max(at - 4, 0) : at] == "0000" or text[at + 7 : at + 11] == "0000":
                total += 40
            at = text.find("1011101", at + 1)
    same = (m[1:, 1:] == m[:-1, 1:]) & (m[1:, 1:] == m[1:, :-1]) & (m[1:, 1:] == m[:-1, :-1])
    return total + 3 * int(same.sum()) + abs(int(m.sum()) * 100 // m.size - 50) // 5 * 10


def _write_format(m: np.ndarray, k: int) -> None:
    value = rest = (1 << 3 | k) << 10
    for i in range(14, 9, -1):
        if rest >> i & 1:
            rest ^= 0x537 << (i - 10)
    bits = [bool(((value | rest) ^ 0x5412) >> (14 - i) & 1) for i in range(15)]
    n = len(m)
    first = [(8, x) for x in (0, 1, 2, 3, 4, 5, 7, 8)] + [(y, 8) for y in (7, 5, 4, 3, 2, 1, 0)]
    second = [(n - 1 - i, 8) for i in range(8)] + [(8, n - 7 + i) for i in range(7)]
    for places in (first, second):
        for (y, x), bit in zip(places, bits, strict=True):
            m[y, x] = bit


def encode(text: bytes) -> np.ndarray | None:
    """Modules, dark ones true, under the mask of least penalty; null for a text too long."""
    found = pick_version(len(text))
    if found is None:
        return None
    version, words, checks = found
    frame, fixed = _frame(version)
    n = len(frame)
    bits = np.unpackbits(np.frombuffer(codewords(text, words, checks), dtype=np.uint8)).astype(bool)
    columns = [c for c in range(n - 1, 0, -2) if c > 6] + [5, 3, 1]
    cells = []
    for k, right in enumerate(columns):
        rows = range(n) if k % 2 else range(n - 1, -1, -1)
        cells += [(y, x) for y in rows for x in (right, right - 1) if not fixed[y, x]]
    ys, xs = np.array(cells).T
    base = frame.copy()
    base[ys[: len(bits)], xs[: len(bits)]] = bits
    best = None
    for k in range(8):
        m = base ^ (mask(k, n) & ~fixed)
        _write_format(m, k)
        p = penalty(m)
        if best is None or p < best[0]:
            best = (p, m)
    return best[1]


def raster(modules: np.ndarray, scale: int) -> np.ndarray:
    """RGB pixels with a quiet zone."""
    scale = max(scale, 1)
    light = np.kron(~np.pad(modules, QUIET), np.ones((scale, scale), dtype=np.uint8)) * np.uint8(255)
    return np.repeat(light[..., None], 3, axis=2)
