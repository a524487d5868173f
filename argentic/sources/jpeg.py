"""JPEG in Python: baseline and progressive, grey and three components, 8 bits (ITU T.81)."""

from __future__ import annotations

import struct
from array import array
from functools import lru_cache

import numpy as np

from .png import ImageError, check_size


def _zigzag() -> list[int]:
    """Places of the 64 coefficients along the diagonals."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return [y * 8 + x for y, x in cells]


ZIGZAG = _zigzag()
_U = np.arange(8)
_COS = (np.where(_U == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * _U[None, :] + 1) * _U[:, None] * np.pi / 16)).astype(np.float32)


class _Ended(Exception):
    """The scan has no more data; what was read so far is the image."""


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.held, self.have = data, at, 0, 0

    def bits(self, n: int) -> int:
        while self.have < n:
            if self.at >= len(self.data):
                raise _Ended
            b = self.data[self.at]
            if b == 0xFF:
                if self.at + 1 >= len(self.data) or self.data[self.at + 1] != 0:
                    raise _Ended
                self.at += 1
            self.at += 1
            self.held = (self.held << 8 | b) & 0xFFFFFFFFFF
            self.have += 8
        self.have -= n
        return self.held >> self.have & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.bits(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def code(self, table: dict[tuple[int, int], int]) -> int:
        v = 0
        for n in range(1, 17):
            v = v << 1 | self.bits(1)
            if (n, v) in table:
                return table[n, v]
        raise ImageError("bad code")

    def restart(self) -> None:
        """On to the data after the next restart marker."""
        self.have = 0
        while self.at + 1 < len(self.data):
            if self.data[self.at] == 0xFF and self.data[self.at + 1] not in (0, 0xFF):
                if 0xD0 <= self.data[self.at + 1] <= 0xD7:
                    self.at += 2
                return
            self.at += 1


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Table(dict):
    """Symbols by (length, code), with the bytes that they come from."""

    def __init__(self, counts: bytes, symbols: bytes):
        super().__init__(_huffman(counts, symbols))
        self.raw = counts, symbols


class _Odd(Exception):
    """The scan is not one that tables read: broken off, or with a code that doesn't belong there."""


@lru_cache(maxsize=16)
def _symbols(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) of the code that each 16-bit window begins with; length 0 where none does."""
    length, symbol = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for (n, code), s in _huffman(counts, symbols).items():
        if code >> n == 0:
            length[code << 16 - n : code + 1 << 16 - n], symbol[code << 16 - n : code + 1 << 16 - n] = n, s
    return length, symbol


def _value(window, at, size):
    """Signed values of so many bits from the bit ``at`` of the windows; a size of 0 is 0."""
    v = window >> np.maximum(16 - at - size, 0) & (1 << size) - 1
    return np.where(size == 0, 0, np.where(v >> np.maximum(size - 1, 0) == 0, v - (1 << size) + 1, v))


@lru_cache(maxsize=16)
def _windows(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> tuple[list, ...]:
    """What each 16-bit window holds.

    At the start of a block: the bits of a whole block without other coefficients
    (0 if the window holds none), the bits of the whole difference (0 likewise),
    the difference, the length of its code and its symbol.  Inside a block: the
    length of the code and its symbol.
    """
    window = np.arange(1 << 16)
    n, size = _symbols(*dc)
    used = np.where((n > 0) & (n + size <= 16), n + size, 0)
    value = _value(window, n, np.where(used > 0, size, 0))
    length, symbol = _symbols(*ac)
    end = length[window << used & 0xFFFF]
    flat = (used > 0) & (end > 0) & (symbol[window << used & 0xFFFF] == 0) & (used + end <= 16)
    return tuple(x.tolist() for x in (np.where(flat, used + end, 0), used, value, n, size, length, symbol))


def _plain(data: bytes, at: int) -> tuple[bytes, int]:
    """(bytes without stuffing, place of the marker after them)."""
    end = at
    while True:
        end = data.find(b"\xff", end)
        if end < 0:
            end = len(data)
        elif data[end + 1 : end + 2] == b"\0":
            end += 2
            continue
        return data[at:end].replace(b"\xff\0", b"\xff"), end


def _signed(v: int, n: int) -> int:
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _read_by_tables(plain: bytes, units, tables: list[tuple]) -> tuple[list, array, array]:
    """First coefficients less the ones before, of the blocks in ``units`` (each one's component), and places (block * 64 + place in it) and values of the others."""
    raw = np.frombuffer(plain + bytes(8), dtype=np.uint8).astype(np.uint32)
    words = memoryview(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])
    p, at, first, places, values = 0, -1, [], array("q"), array("i")
    add = first.append
    for unit in units:
        if unit != at:
            at, (whole, used, diff, dc_length, dc_symbol, length, symbol) = unit, tables[unit]
        w = words[p >> 3] >> 8 - (p & 7) & 0xFFFF
        n = whole[w]
        if n:
            add(diff[w])
            p += n
            continue
        n = used[w]
        if n:
            add(diff[w])
            p += n
        else:
            n, size = dc_length[w], dc_symbol[w]
            if not n or size > 16:
                raise _Odd
            p += n
            add(_signed((words[p >> 3] >> 8 - (p & 7) & 0xFFFF) >> 16 - size, size))
            p += size
        block = len(first) - 1
        k = 1
        while k < 64:
            w = words[p >> 3] >> 8 - (p & 7) & 0xFFFF
            n = length[w]
            if not n:
                raise _Odd
            p += n
            run, size = divmod(symbol[w], 16)
            if not size:
                if run < 15:
                    break
                k += 16
                continue
            k += run
            if k > 63:
                raise _Odd
            places.append(block << 6 | ZIGZAG[k])
            values.append(_signed((words[p >> 3] >> 8 - (p & 7) & 0xFFFF) >> 16 - size, size))
            p += size
            k += 1
    if p > 8 * len(plain):
        raise _Odd
    return first, places, values


def _scan_by_tables(data: bytes, at: int, frame: _Frame, chosen: list, dcs: dict, acs: dict, interval: int) -> None:
    """A whole baseline scan; ``_Odd`` before anything is stored if it is not whole or has a bad code."""
    if not chosen or len({c.ident for c, _, _ in chosen}) < len(chosen) or any(dc not in dcs or ac not in acs for _, dc, ac in chosen):
        raise _Odd
    tables = [_windows(dcs[dc].raw, acs[ac].raw) for _, dc, ac in chosen]
    if len(chosen) == 1:
        part = chosen[0][0]
        cells = (np.arange(part.own_down)[:, None] * part.across + np.arange(part.own_across)).reshape(-1, 1)
        pattern = [0]
    else:
        down, across = frame.parts[0].down // frame.parts[0].v, frame.parts[0].across // frame.parts[0].h
        y, x = np.repeat(np.arange(down), across)[:, None], np.tile(np.arange(across), down)[:, None]
        cells = np.hstack([(y * c.v + np.repeat(np.arange(c.v), c.h)) * c.across + x * c.h + np.tile(np.arange(c.h), c.v) for c, _, _ in chosen])
        pattern = [i for i, (c, _, _) in enumerate(chosen) for _ in range(c.h * c.v)]
    step, found = interval or len(cells), []
    for lo in range(0, len(cells), max(step, 1)):
        if lo:
            while data[at : at + 2] and (data[at] != 0xFF or data[at + 1 : at + 2] in (b"", b"\0", b"\xff")):
                at += 1
            if not 0xD0 <= (data[at + 1 : at + 2] or b"\0")[0] <= 0xD7:
                raise _Odd
            at += 2
        plain, at = _plain(data, at)
        part = cells[lo : lo + step]
        first, places, values = _read_by_tables(plain, [0] * len(part) if len(pattern) == 1 else pattern * len(part), tables)
        first, of = np.array(first, dtype=np.int64), np.tile(pattern, len(part))
        for i in range(len(chosen)):
            first[of == i] = np.cumsum(first[of == i])
        if np.abs(first).max() >> 31:
            raise _Odd
        found.append((part.ravel(), of, first, np.frombuffer(places, dtype=np.int64), np.frombuffer(values, dtype=np.int32)))
    for cell, of, first, places, values in found:
        for i, (c, _, _) in enumerate(chosen):
            blocks, mine = c.blocks.reshape(-1, 64), slice(None) if len(chosen) == 1 else of == i
            blocks[cell[mine], 0] = first[mine]
            if len(places):
                own = of[places >> 6] == i
                blocks[cell[places[own] >> 6], places[own] & 63] = values[own]
                c.flat = c.flat and not own.any()


class _Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table
        self.predicted, self.flat = 0, True  # flat: no block has more than a first coefficient

    def size(self, frame: _Frame) -> None:
        self.across = -(-frame.width // (8 * frame.h)) * self.h
        self.down = -(-frame.height // (8 * frame.v)) * self.v
        self.own_across = -(-(-(-frame.width * self.h // frame.h)) // 8)
        self.own_down = -(-(-(-frame.height * self.v // frame.v)) // 8)
        self.blocks = np.zeros((self.down, self.across, 64), dtype=np.int32)


class _Frame:
    def __init__(self, body: bytes, progressive: bool):
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if depth != 8:
            raise ImageError(f"unsupported depth {depth}")
        check_size(self.width, self.height)
        if n not in (1, 3):
            raise ImageError(f"unsupported number of components {n}")
        self.progressive = progressive
        self.parts = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 for c in self.parts):
            raise ImageError("bad field: sampling")
        self.h, self.v = max(c.h for c in self.parts), max(c.v for c in self.parts)
        for c in self.parts:
            c.size(self)


def _baseline(bits, block, c, dc, ac, *_):
    c.predicted += bits.signed(bits.code(dc))
    block[0] = c.predicted
    k = 1
    while k < 64:
        run, size = divmod(bits.code(ac), 16)
        if not size:
            if run < 15:
                return
            k += 16
            continue
        k += run
        if k > 63:
            raise ImageError("bad run")
        block[ZIGZAG[k]] = bits.signed(size)
        k += 1


class _Progressive:
    """One scan's way to read a block; ``skip`` counts blocks of an end-of-band run."""

    def __init__(self, low: int, high: int, before: int, shift: int):
        self.low, self.high, self.before, self.shift, self.skip = low, high, before, shift, 0

    def __call__(self, bits, block, c, dc, ac, *_):
        if self.low == 0:
            if self.before:
                block[0] |= bits.bits(1) << self.shift
            else:
                c.predicted += bits.signed(bits.code(dc))
                block[0] = c.predicted << self.shift
        elif self.before:
            self._refine(bits, block, ac)
        else:
            self._first(bits, block, ac)

    def _first(self, bits, block, ac):
        if self.skip:
            self.skip -= 1
            return
        k = self.low
        while k <= self.high:
            run, size = divmod(bits.code(ac), 16)
            if size:
                k += run
                if k > 63:
                    raise ImageError("bad run")
                block[ZIGZAG[k]] = bits.signed(size) << self.shift
                k += 1
            elif run == 15:
                k += 16
            else:
                self.skip = (1 << run) - 1 + (bits.bits(run) if run else 0)
                return

    def _mend(self, bits, block, at) -> None:
        if bits.bits(1) and not abs(int(block[at])) & 1 << self.shift:
            block[at] += (1 << self.shift) * (1 if block[at] > 0 else -1)

    def _refine(self, bits, block, ac):
        k = self.low
        if not self.skip:
            while k <= self.high:
                run, size = divmod(bits.code(ac), 16)
                new = 0
                if size:
                    new = (1 if bits.bits(1) else -1) << self.shift
                elif run < 15:
                    self.skip = (1 << run) + (bits.bits(run) if run else 0)
                    break
                while k <= self.high:
                    at = ZIGZAG[k]
                    k += 1
                    if block[at]:
                        self._mend(bits, block, at)
                    elif run:
                        run -= 1
                    else:
                        block[at] = new
                        break
        if self.skip:
            for k in range(k, self.high + 1):
                if block[ZIGZAG[k]]:
                    self._mend(bits, block, ZIGZAG[k])
            self.skip -= 1


def _scan(data: bytes, at: int, frame: _Frame, body: bytes, dcs: dict, acs: dict, interval: int) -> None:
    chosen = []
    for i in range(body[0]):
        part = next((c for c in frame.parts if c.ident == body[1 + 2 * i]), None)
        if part is None:
            raise ImageError("bad field: scan component")
        chosen.append((part, body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15))
    low, high, nibbles = body[1 + 2 * body[0] : 4 + 2 * body[0]]
    if not frame.progressive:
        try:
            return _scan_by_tables(data, at, frame, chosen, dcs, acs, interval)
        except (_Odd, IndexError):
            pass  # read bit by bit, which keeps what comes before the fault
    for part, _, _ in chosen:
        part.flat = False
    read = _Progressive(low, min(high, 63), nibbles >> 4, nibbles & 15) if frame.progressive else _baseline
    bits = _Bits(data, at)
    if len(chosen) == 1:
        part = chosen[0][0]
        units = [[(0, y, x)] for y in range(part.own_down) for x in range(part.own_across)]
    else:
        down, across = frame.parts[0].down // frame.parts[0].v, frame.parts[0].across // frame.parts[0].h
        units = [[(i, y * c.v + v, x * c.h + h) for i, (c, _, _) in enumerate(chosen) for v in range(c.v) for h in range(c.h)] for y in range(down) for x in range(across)]
    for part, _, _ in chosen:
        part.predicted = 0
    try:
        for n, unit in enumerate(units):
            if interval and n and n % interval == 0:
                bits.restart()
                for part, _, _ in chosen:
                    part.predicted = 0
                if frame.progressive:
                    read.skip = 0
            for i, y, x in unit:
                part, dc, ac = chosen[i]
                read(bits, part.blocks[y, x], part, dcs.get(dc, {}), acs.get(ac, {}))
    except _Ended:
        return


def _render(frame: _Frame, quant: dict) -> np.ndarray:
    planes = []
    for c in frame.parts:
        if c.table not in quant:
            raise ImageError("bad field: no quantisation table")
        n = 1 if c.flat else 8  # the first coefficient is the same in all pixels
        blocks = (c.blocks[..., : n * n] * quant[c.table][: n * n]).astype(np.float32).reshape(c.down, c.across, n, n)
        px = np.einsum("uy,abuv,vx->abyx", _COS[:n, :n], blocks, _COS[:n, :n])
        px = np.clip(np.floor(px + np.float32(128.5)), 0, 255).astype(np.uint8)
        plane = px.transpose(0, 2, 1, 3).reshape(c.down * n, c.across * n)
        if c.flat:
            plane = np.repeat(np.repeat(plane, 8, axis=1), 8, axis=0)
        if (c.h, c.v) == (frame.h, frame.v):
            planes.append(plane[: frame.height, : frame.width])
            continue
        rows = np.arange(frame.height) * c.v // frame.v
        cols = np.arange(frame.width) * c.h // frame.h
        planes.append(plane[rows][:, cols])
    if len(planes) == 1:
        return np.broadcast_to(planes[0][..., None], (*planes[0].shape, 3))
    y, cb, cr = (p.astype(np.int32) for p in planes)
    cb, cr, half = cb - 128, cr - 128, 1 << 15
    fixed = lambda x: int(x * 65536 + 0.5)
    red = y + (fixed(1.402) * cr + half >> 16)
    green = y - (fixed(0.344136) * cb + fixed(0.714136) * cr + half >> 16)
    blue = y + (fixed(1.772) * cb + half >> 16)
    return np.clip(np.stack([red, green, blue], axis=2), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Pixels [height, width, 3].  A scan that breaks off gives what came before it."""
    if data[:2] != b"\xff\xd8":
        raise ImageError("not this format")
    at, frame, quant, dcs, acs, interval = 2, None, {}, {}, {}, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] in (0, 0xFF) or 0xD0 <= data[at + 1] <= 0xD7:
            at = data.find(b"\xff", at + 1)
            if at < 0:
                break
            continue
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if len(body) < size - 2 or size < 2:
            break
        at += 2 + size
        try:
            if kind in (0xC0, 0xC1, 0xC2):
                frame = _Frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ImageError(f"unsupported frame {kind:#x}")
            elif kind == 0xDB:
                while body:
                    wide, table = body[0] >> 4, np.zeros(64, dtype=np.int32)
                    n = 128 if wide else 64
                    table[ZIGZAG] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8)
                    quant[body[0] & 15], body = table, body[1 + n :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    (acs if body[0] >> 4 else dcs)[body[0] & 15] = _Table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xDD:
                interval = struct.unpack(">H", body[:2])[0]
            elif kind == 0xDA:
                if frame is None:
                    raise ImageError("bad field: scan before frame")
                _scan(data, at, frame, body, dcs, acs, interval)
        except (IndexError, OverflowError, struct.error, ValueError) as e:
            raise e if isinstance(e, ImageError) else ImageError(f"bad segment {kind:#x}") from e
    if frame is None:
        raise ImageError("truncated: no frame")
    return _render(frame, quant)
