"""Palettes of at most 256 colours, and the choice of a thumbnail's encoding."""

from __future__ import annotations

import numpy as np

from argentic.sources import png

COLOURS = 256
#: A lossy palette must save this share of the file.
WORTH = 0.15


def bucket(px: np.ndarray) -> np.ndarray:
    """5 bits of each channel as one 15-bit number."""
    x = px.astype(np.int64) >> 3
    return x[..., 0] << 10 | x[..., 1] << 5 | x[..., 2]


def exact_palette(px: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(sorted colours, index of each pixel) if there are few enough."""
    flat = px.reshape(-1, 3).astype(np.int64) @ np.array([65536, 256, 1])
    colours, index = np.unique(flat, return_inverse=True)
    if len(colours) > COLOURS:
        return None
    return np.stack([colours >> 16, colours >> 8 & 255, colours & 255], axis=1).astype(np.uint8), index.reshape(px.shape[:2])


def totals(px: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, pixels, sum of each channel) of the used buckets; those of several rasters can be added up."""
    used, index, count = np.unique(bucket(px).ravel(), return_inverse=True, return_counts=True)
    sums = np.stack([np.bincount(index, weights=px[..., c].ravel(), minlength=len(used)) for c in range(3)], axis=1)
    return used, count, sums.astype(np.int64)


def histogram(px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean colour, pixels) of each used bucket."""
    _, count, sums = totals(px)
    return (sums // count[:, None]).astype(np.uint8), count


def median_cut(colours: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Split the box of most spread times pixels where half its pixels lie, until there are enough boxes."""

    def cost(box: np.ndarray) -> int:
        return -1 if len(box) < 2 else int(np.ptp(colours[box].astype(int), axis=0).max()) * int(counts[box].sum())

    boxes = [np.arange(len(colours))]
    costs = [cost(boxes[0])]
    while len(boxes) < COLOURS and max(costs) >= 0:
        k = int(np.argmax(costs))
        box = boxes[k]
        axis = int(np.argmax(np.ptp(colours[box].astype(int), axis=0)))
        box = box[np.argsort(colours[box, axis], kind="stable")]
        running = np.cumsum(counts[box])
        split = int(np.clip(np.searchsorted(2 * running, running[-1]) + 1, 1, len(box) - 1))
        boxes[k], costs[k] = box[:split], cost(box[:split])
        boxes.append(box[split:])
        costs.append(cost(box[split:]))
    weighted = [(colours[b].astype(np.int64) * counts[b, None]).sum(axis=0) // counts[b].sum() for b in boxes]
    return np.array(weighted, dtype=np.uint8)


def closest(colours: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Index of the nearest palette entry to each colour, the first of equals."""
    gaps = ((colours[:, None, :].astype(np.int64) - palette[None].astype(np.int64)) ** 2).sum(axis=2)
    return gaps.argmin(axis=1)


def nearest(px: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Index of the nearest colour, the first of equals; the first pixel met of a bucket decides for all of it."""
    _, first, which = np.unique(bucket(px).ravel(), return_index=True, return_inverse=True)
    return closest(px.reshape(-1, 3)[first], palette)[which].reshape(px.shape[:2])


def quantise(px: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """(palette, indices, exact)."""
    found = exact_palette(px)
    if found is not None:
        return *found, True
    palette = median_cut(*histogram(px))
    return palette, nearest(px, palette), False


def encode_thumbnail(px: np.ndarray) -> bytes:
    """The smaller of both encodings if the palette loses nothing; a lossy palette only if it saves enough."""
    palette, indices, exact = quantise(px)
    full, small = png.encode(px), png.encode_palette(palette, indices)
    better = len(small) < len(full) if exact else 1 - len(small) / len(full) >= WORTH
    return small if better else full
