"""Rasters of 8-bit RGB (or grey) as numpy arrays: sampling, orientation and perceptual hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

F4 = np.float32
MAX_PIXELS = 64_000_000
THUMB_EDGE = 256


def luma(px: np.ndarray) -> np.ndarray:
    x = px.astype(np.uint32)
    return ((299 * x[..., 0] + 587 * x[..., 1] + 114 * x[..., 2]) // 1000).astype(np.uint8)


def box_halve(px: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 blocks, halves up; a side of one stays."""
    h, w = px.shape[:2]
    rows = np.arange(max(h // 2, 1)) * 2
    cols = np.arange(max(w // 2, 1)) * 2
    below, right = np.minimum(rows + 1, h - 1), np.minimum(cols + 1, w - 1)
    x = px.astype(np.uint32)
    total = x[rows][:, cols] + x[rows][:, right] + x[below][:, cols] + x[below][:, right]
    return ((total + 2) // 4).astype(np.uint8)


def _axis(px: np.ndarray, size: int) -> np.ndarray:
    """One pass of linear sampling along the first axis, corner to corner, rounded to bytes."""
    n = len(px)
    ratio = F4(n - 1) / F4(size - 1) if size > 1 else F4(0)
    at = np.arange(size, dtype=F4) * ratio
    low = np.floor(at).astype(np.int64)
    t = (at - low.astype(F4)).reshape(-1, *[1] * (px.ndim - 1))
    mixed = px[low].astype(F4) * (F4(1) - t) + px[np.minimum(low + 1, n - 1)].astype(F4) * t
    return np.clip(np.floor(mixed + F4(0.5)), 0, 255).astype(np.uint8)


def bilinear(px: np.ndarray, width: int, height: int) -> np.ndarray:
    across = np.swapaxes(_axis(np.swapaxes(px, 0, 1), width), 0, 1)
    return _axis(across, height)


def resize(px: np.ndarray, width: int, height: int) -> np.ndarray:
    """Halved while twice the target fits, then sampled."""
    width, height = max(width, 1), max(height, 1)
    if px.shape[:2] == (height, width):
        return px
    while px.shape[1] // 2 >= width and px.shape[0] // 2 >= height and min(px.shape[:2]) > 1:
        px = box_halve(px)
    return bilinear(px, width, height)


def fit(width, height, edge: int = THUMB_EDGE):
    """(width, height) within a square of this edge, of numbers or of arrays of them; what fits stays."""
    small, wide = np.maximum(width, height) <= edge, np.greater_equal(width, height)
    across = np.where(small, width, np.where(wide, edge, np.maximum(width * edge // height, 1)))
    down = np.where(small, height, np.where(wide, np.maximum(height * edge // width, 1), edge))
    return across, down


def thumbnail(px: np.ndarray, edge: int = THUMB_EDGE) -> np.ndarray:
    return resize(px, *(int(side) for side in fit(px.shape[1], px.shape[0], edge)))


def orient(px: np.ndarray, orientation: int) -> np.ndarray:
    """Upright pixels of an image with this EXIF orientation; other numbers change nothing."""
    turned = np.swapaxes(px, 0, 1) if 5 <= orientation <= 8 else px
    flips = {2: (1,), 3: (0, 1), 4: (0,), 6: (1,), 7: (0, 1), 8: (0,)}.get(orientation, ())
    return np.flip(turned, flips) if flips else turned


def grey(px: np.ndarray, width: int, height: int) -> np.ndarray:
    small = resize(px, width, height)
    return luma(small) if small.ndim == 3 else small


def dhash(px: np.ndarray) -> int:
    """Bit y * 8 + x is set where a pixel of the 9 x 8 grid is brighter than its right neighbour."""
    g = grey(px, 9, 8)
    return int(np.packbits((g[:, :-1] > g[:, 1:]).ravel(), bitorder="little").view("<u8")[0])


@lru_cache
def _basis(n: int = 32) -> np.ndarray:
    u, x = np.arange(n, dtype=F4)[:, None], np.arange(n, dtype=F4)[None, :]
    scale = np.where(u == 0, np.sqrt(F4(1) / F4(n)), np.sqrt(F4(2) / F4(n))).astype(F4)
    return scale * np.cos((F4(2) * x + F4(1)) * u * F4(np.pi) / F4(2 * n)).astype(F4)


def phash_grid(g: np.ndarray) -> int:
    """The lowest 63 cosine coefficients but the mean against their median, of a 32 x 32 grey grid."""
    basis = _basis()
    coefficients = (basis @ (g.astype(F4) @ basis.T))[:8, :8].ravel()[1:]
    bits = coefficients > np.sort(coefficients)[31]
    return int(np.packbits(np.append(bits, False), bitorder="little").view("<u8")[0])


def signature(px: np.ndarray) -> tuple[int, int, list[int]]:
    """(dhash, phash, phashes turned by 90, 180 and 270 degrees); one grid serves all turns."""
    g = grey(px, 32, 32)
    return dhash(px), phash_grid(g), [phash_grid(np.rot90(g, -k)) for k in (1, 2, 3)]


def text_raster(data: bytes) -> np.ndarray | None:
    """All bytes of a text as a grey image, as square as it can be; the rest of the last row is black."""
    if not data:
        return None
    width = max(int(len(data) ** 0.5), 1)
    height = -(-len(data) // width)
    out = np.zeros(width * height, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(height, width)
