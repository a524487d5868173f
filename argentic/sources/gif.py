"""The first frame of a GIF."""

from __future__ import annotations

import struct

import numpy as np

from .png import ImageError, check_size


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ImageError(f"truncated at {self.at}")
        self.at += n
        return out

    def byte(self) -> int:
        return self.take(1)[0]

    def blocks(self) -> bytes:
        out = []
        while n := self.byte():
            out.append(self.take(n))
        return b"".join(out)


def lzw(code_size: int, packed: bytes, most: int) -> bytes:
    """Codes of growing width, low bits first; ends at the end code, at the end of the data or at ``most`` bytes."""
    if not 1 <= code_size <= 11:
        raise ImageError(f"bad field: code size {code_size}")
    clear, end = 1 << code_size, (1 << code_size) + 1
    table = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
    width, last, out, size = code_size + 1, None, [], 0
    held = have = at = 0
    while size < most:
        while have < width:
            if at >= len(packed):
                return b"".join(out)[:most]
            held |= packed[at] << have
            have, at = have + 8, at + 1
        code, held, have = held & ((1 << width) - 1), held >> width, have - width
        if code == clear:
            del table[end + 1 :]
            width, last = code_size + 1, None
            continue
        if code == end:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last is not None:
            entry = last + last[:1]
        else:
            raise ImageError(f"bad field: code {code}")
        out.append(entry)
        size += len(entry)
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        last = entry
    return b"".join(out)[:most]


def decode(data: bytes) -> np.ndarray:
    """Pixels [height, width, 3]; what the frame doesn't cover and what is transparent is white."""
    if data[:3] != b"GIF":
        raise ImageError("not this format")
    r = _Reader(data)
    r.take(6)
    screen_w, screen_h, flags, _, _ = struct.unpack("<HHBBB", r.take(7))
    check_size(max(screen_w, 1), max(screen_h, 1))
    colours = lambda f: np.frombuffer(r.take(3 * (2 << (f & 7))), dtype=np.uint8).reshape(-1, 3) if f & 0x80 else None
    table, clear = colours(flags), None
    while (kind := r.byte()) != 0x2C:
        if kind != 0x21:
            raise ImageError(f"bad field: block {kind} at {r.at}")
        label, body = r.byte(), r.blocks()
        if label == 0xF9 and len(body) >= 4 and body[0] & 1:
            clear = body[3]
    left, top, w, h, flags = struct.unpack("<HHHHB", r.take(9))
    table = own if (own := colours(flags)) is not None else table
    if table is None:
        raise ImageError("bad field: no colours")
    check_size(w, h)
    check_size(max(screen_w, left + w), max(screen_h, top + h))
    found = np.frombuffer(lzw(r.byte(), r.blocks(), w * h), dtype=np.uint8)
    index = np.full(w * h, 256, dtype=np.int64)
    index[: len(found)] = found
    index = index.reshape(h, w)
    if flags & 0x40:
        order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
        index[order] = index.copy()
    full = np.zeros((257, 3), dtype=np.uint8)
    full[: len(table)] = table
    full[256] = 255
    if clear is not None:
        full[clear] = 255
    out = np.full((max(screen_h, top + h), max(screen_w, left + w), 3), 255, dtype=np.uint8)
    out[top : top + h, left : left + w] = full[index]
    return out
