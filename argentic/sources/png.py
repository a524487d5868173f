"""PNG in Python: zlib for the stream, numpy for the pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from argentic.operators.raster import MAX_PIXELS

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: First column, first row, column step and row step of the seven interlace passes.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class ImageError(ValueError):
    """Why an image can't be decoded; texts that start with "unsupported" mean a format that is valid but not read."""


def check_size(width: int, height: int) -> None:
    if width <= 0 or height <= 0:
        raise ImageError(f"bad field: size {width} x {height}")
    if width * height > MAX_PIXELS:
        raise ImageError(f"too large: {width} x {height}")


def inflate(data: bytes, most: int) -> bytes:
    """The decompressed stream, or an error if it is broken or longer than ``most``."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, most + 1)
    except zlib.error as e:
        raise ImageError(f"bad stream: {e}") from e
    if len(out) > most:
        raise ImageError("too large: stream is longer than its image")
    return out


def _chunks(data: bytes):
    at = len(MAGIC)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise ImageError(f"truncated at {at}")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ImageError(f"bad checksum of {kind!r} at {at}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ImageError("truncated: no end")


def unfilter(raw: bytes, rows: int, stride: int, pixel: int) -> np.ndarray:
    out = np.zeros((rows + 1, stride + pixel), dtype=np.uint8)
    for y in range(rows):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, dtype=np.uint8, count=stride, offset=y * (stride + 1) + 1)
        up, now = out[y], out[y + 1]
        if kind == 0:
            now[pixel:] = line
        elif kind == 2:
            now[pixel:] = line + up[pixel:]
        elif kind == 1:
            for c in range(pixel):
                now[pixel + c :: pixel] = np.cumsum(line[c::pixel], dtype=np.uint8)
        elif kind in (3, 4):
            above, made = up.tolist(), [0] * (stride + pixel)
            for i, v in enumerate(line.tolist()):
                a, b, c = made[i], above[i + pixel], above[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                made[i + pixel] = (v + guess) & 255
            now[:] = made
        else:
            raise ImageError(f"bad filter {kind}")
    return out[1:, pixel:]


def _samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    if depth == 16:
        flat = lines.reshape(len(lines), -1, 2).astype(np.uint16)
        flat = flat[..., 0] << 8 | flat[..., 1]
    elif depth == 8:
        flat = lines.astype(np.uint16)
    else:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth).astype(np.uint16)
        flat = bits @ (1 << np.arange(depth)[::-1]).astype(np.uint16)
    return flat[:, : width * channels].reshape(len(lines), width, channels)


def _over_white(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    a = alpha.astype(np.uint32)[..., None]
    return ((rgb.astype(np.uint32) * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Pixels [height, width, 3]; transparency shows white."""
    if not data.startswith(MAGIC):
        raise ImageError("not this format")
    header, palette, clear, packed = None, None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            if len(body) != 13:
                raise ImageError("bad field: header")
            header = struct.unpack(">IIBBBBB", body)
        elif header is None:
            raise ImageError("bad field: no header first")
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], dtype=np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind != b"IEND" and not kind[0] & 0x20:
            raise ImageError(f"unsupported chunk {kind!r}")
    width, height, depth, colour, _, _, laced = header or (0, 0, 0, 9, 0, 0, 0)
    check_size(width, height)
    if colour not in CHANNELS or depth not in DEPTHS[colour] or laced > 1:
        raise ImageError(f"bad field: colour {colour}, depth {depth}, interlace {laced}")
    channels = CHANNELS[colour]
    pixel = max(channels * depth // 8, 1)
    passes = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (PASSES if laced else ((0, 0, 1, 1),))]
    passes = [p for p in passes if p[4] > 0 and p[5] > 0]
    strides = [-(-p[4] * channels * depth // 8) for p in passes]
    need = sum((s + 1) * p[5] for s, p in zip(strides, passes, strict=True))
    raw = inflate(b"".join(packed), need)
    if len(raw) < need:
        raise ImageError("truncated: too little data")
    values, at = np.zeros((height, width, channels), dtype=np.uint16), 0
    for (x, y, dx, dy, w, h), stride in zip(passes, strides, strict=True):
        part = raw[at : at + (stride + 1) * h]
        at += len(part)
        values[y::dy, x::dx] = _samples(unfilter(part, h, stride, pixel), w, depth, channels)
    if colour == 3:
        if palette is None:
            raise ImageError("bad field: no palette")
        if values.max() >= len(palette):
            raise ImageError("bad field: palette index")
        rgb = palette[values[..., 0]]
        if clear is None:
            return rgb
        alpha = np.full(len(palette), 255, dtype=np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear[: len(palette)], dtype=np.uint8)
        return _over_white(rgb, alpha[values[..., 0]])
    eight = (values >> 8 if depth == 16 else values * (255 // ((1 << depth) - 1))).astype(np.uint8)
    rgb = np.repeat(eight[..., :1], 3, axis=2) if colour in (0, 4) else eight[..., :3]
    if colour in (4, 6):
        return _over_white(rgb, eight[..., -1])
    if clear is not None and len(clear) >= 2 * channels:
        key = np.array(struct.unpack_from(f">{channels}H", clear), dtype=np.uint16)
        return _over_white(rgb, np.where((values == key).all(axis=2), 0, 255).astype(np.uint8))
    return rgb


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _file(width: int, height: int, colour: int, raw: bytes, *extra: bytes) -> bytes:
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", header) + b"".join(extra) + _chunk(b"IDAT", zlib.compress(raw, 9)) + _chunk(b"IEND", b"")


def _filtered(px: np.ndarray) -> bytes:
    """Each row by the filter that leaves the smallest sum of signed bytes; the first of equals."""
    height, stride = len(px), px.shape[1] * 3
    now = px.reshape(height, stride).astype(np.int16)
    up = np.vstack([np.zeros((1, stride), dtype=np.int16), now[:-1]])
    left = np.hstack([np.zeros((height, 3), dtype=np.int16), now[:, :-3]])
    corner = np.hstack([np.zeros((height, 3), dtype=np.int16), up[:, :-3]])
    pa, pb, pc = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
    tried = np.stack([now, now - left, now - up, now - (left + up) // 2, now - paeth]).astype(np.uint8)
    best = np.abs(tried.view(np.int8).astype(np.int32)).sum(axis=2).argmin(axis=0)
    rows = tried[best, np.arange(height)]
    return np.hstack([best.astype(np.uint8)[:, None], rows]).tobytes()


def encode(px: np.ndarray) -> bytes:
    return _file(px.shape[1], px.shape[0], 2, _filtered(px))


def encode_palette(palette: np.ndarray, indices: np.ndarray) -> bytes:
    rows = np.hstack([np.zeros((len(indices), 1), dtype=np.uint8), indices.astype(np.uint8)])
    return _file(indices.shape[1], indices.shape[0], 3, rows.tobytes(), _chunk(b"PLTE", palette.astype(np.uint8).tobytes()))
