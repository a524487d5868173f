"""Hashed n-gram features of texts laid end to end, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._anchors import Rolling, U, mix

#: Bytes looked at together.  A longer text is read in pieces of this size, cut after white space where there is some.
PIECE = 1 << 18
_STEP = U(0xD1342543DE82EF95)


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            space = max(text.rfind(s, at, end) for s in (b" ", b"\n"))
            end = space + 1 if space > at else end
            for _ in range(3):  # not within a character
                if end > at + 1 and text[end] & 0xC0 == 0x80:
                    end -= 1
        yield text[at:end]
        at = end


def grouped(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each piece, end of each piece, all their code points in small letters), of about PIECE bytes each time."""
    rows, parts, held = [], [], 0

    def out():
        small = [p.decode("utf-8", "replace").lower() for p in parts]
        data = np.frombuffer("".join(small).encode("utf-32-le"), dtype=np.uint32)
        return np.array(rows), np.cumsum([len(p) for p in small]), data

    for i, text in enumerate(texts):
        for piece in _pieces(text or b""):
            if held + len(piece) > PIECE and held:
                yield out()
                rows, parts, held = [], [], 0
            rows.append(i), parts.append(piece)
            held += len(piece)
    if held:
        yield out()


def char_grams(data: np.ndarray, ends: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, piece) of every n code points in a row within a piece."""
    if len(data) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    size = len(data) - n + 1
    code = np.zeros(size, dtype=U)
    for i in range(n):
        code *= _STEP
        code += data[i : i + size]
    piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:size]
    inside = np.arange(size) + n <= ends[piece]
    bucket = (code[inside] + U(n)) * U(0x9E3779B97F4A7C15) >> U(64 - bits)
    return bucket.astype(np.int64), piece[inside]


class _Points(Rolling):
    """Rolling hashes over code points."""

    def __init__(self, data: np.ndarray):
        super().__init__(np.zeros(len(data), dtype=np.uint8))
        np.cumsum(mix(data + U(1)) * self.up[: len(data)], out=self.sums[1:])


def word_grams(data: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, piece) of every word, and of a sign, always the same, for every word that repeats the one before it."""
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    start = np.flatnonzero(solid & ~(np.append(False, solid[:-1]) & ~edge[:-1]))
    stop = np.flatnonzero(solid & ~(np.append(solid[1:], False) & ~edge[1:])) + 1
    key = mix(_Points(data).at(start, stop) + U(0x57))
    piece = np.searchsorted(ends, start, side="right")
    again = np.append(False, (key[1:] == key[:-1]) & (piece[1:] == piece[:-1]))[: len(key)]
    return np.append(key >> U(64 - bits), np.zeros(again.sum(), dtype=U)).astype(np.int64), np.append(piece, piece[again])


def sums_by_row(values: np.ndarray, pieces: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum over the features of each row; values may have a second axis."""
    if values.ndim == 1:
        return np.bincount(rows[pieces], weights=values, minlength=n)
    return np.stack([np.bincount(rows[pieces], weights=values[:, i], minlength=n) for i in range(values.shape[1])], axis=1)
