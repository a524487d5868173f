"""EXIF of JPEG and ISOBMFF files.  Never fails: what can't be read is missing."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

MAX_IFDS, MAX_ENTRIES, MAX_BOXES, SCAN_BYTES = 8, 512, 4096, 1 << 20
#: Bytes of each TIFF field type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


@dataclass
class Tiff:
    data: bytes
    order: str = field(init=False)

    def __post_init__(self):
        self.order = {b"II*\0": "<", b"MM\0*": ">"}.get(self.data[:4], "")

    def number(self, kind: str, at: int) -> int | None:
        try:
            return struct.unpack_from(self.order + kind, self.data, at)[0]
        except struct.error:
            return None

    def entries(self, at: int) -> dict[int, tuple[int, int, bytes]]:
        """Tags with type, count and bytes of the value; the first of a tag counts."""
        out: dict[int, tuple[int, int, bytes]] = {}
        for i in range(min(self.number("H", at) or 0, MAX_ENTRIES)):
            here = at + 2 + 12 * i
            tag, kind, count = (self.number(k, here + d) for k, d in (("H", 0), ("H", 2), ("I", 4)))
            if count is None or len(self.data) < here + 12:
                break
            size = SIZES.get(kind, 0) * count
            start = here + 8 if size <= 4 else self.number("I", here + 8)
            if size and start + size <= len(self.data):
                out.setdefault(tag, (kind, count, self.data[start : start + size]))
        return out

    def following(self, at: int) -> int:
        return self.number("I", at + 2 + 12 * (self.number("H", at) or 0)) or 0


def _text(e) -> str | None:
    if e is None or e[0] != 2:
        return None
    return e[2].split(b"\0")[0].decode("utf-8", "replace").strip() or None


def _uint(t: Tiff, e) -> int | None:
    if e is None or e[0] not in (1, 3, 4):
        return None
    return struct.unpack_from(t.order + {1: "B", 3: "H", 4: "I"}[e[0]], e[2])[0]


def _ratio(t: Tiff, e, i: int = 0) -> dict | None:
    if e is None or e[0] != 5 or len(e[2]) < 8 * (i + 1):
        return None
    n, d = struct.unpack_from(t.order + "II", e[2], 8 * i)
    return {"n": n, "d": d}


def _degrees(t: Tiff, e, negative: bool, limit: int) -> float | None:
    total = 0.0
    for i, scale in enumerate((1.0, 60.0, 3600.0)):
        r = _ratio(t, e, i)
        if r is None or (r["d"] == 0 and r["n"]):
            return None
        total += r["n"] / r["d"] / scale if r["d"] else 0.0
    total = -total if negative else total
    return total if abs(total) <= limit else None


def in_jpeg(data: bytes) -> int | None:
    """Start of the TIFF block in an APP1 segment before the scan."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind in (0xDA, 0xD9):
            return None
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return at + 10
        at += 2 + max(size, 2)
    return None


def _boxes(data: bytes, at: int, end: int):
    for _ in range(MAX_BOXES):
        if at + 8 > end:
            return
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def in_isobmff(data: bytes) -> int | None:
    """Start of the TIFF block: the EXIF item by its place in iloc, else the first one in the first megabyte."""
    try:
        for kind, a, z in _boxes(data, 0, len(data)):
            if kind == b"meta" and (at := _exif_item(data, a + 4, z)) is not None:
                return at
    except (struct.error, IndexError):
        pass
    for mark in (b"Exif\0\0II*\0", b"Exif\0\0MM\0*"):
        at = data.find(mark, 0, SCAN_BYTES)
        if at >= 0:
            return at + 6
    return None


def _exif_item(data: bytes, a: int, z: int) -> int | None:
    parts = {kind: (x, y) for kind, x, y in _boxes(data, a, z)}
    if b"iinf" not in parts or b"iloc" not in parts:
        return None
    x, y = parts[b"iinf"]
    skip = 6 if data[x] == 0 else 8
    wanted = None
    for kind, p, _ in _boxes(data, x + skip, y):
        if kind == b"infe" and data[p] >= 2:
            wide = data[p] >= 3
            item = struct.unpack_from(">I" if wide else ">H", data, p + 4)[0]
            at = p + (10 if wide else 8)
            if data[at : at + 4] == b"Exif":
                wanted = item
                break
    if wanted is None:
        return None
    x, y = parts[b"iloc"]
    version, sizes = data[x], struct.unpack_from(">H", data, x + 4)[0]
    offset_size, length_size, base_size = sizes >> 12 & 15, sizes >> 8 & 15, sizes >> 4 & 15
    index_size = sizes & 15 if version else 0
    number = lambda at, n: int.from_bytes(data[at : at + n], "big")
    at, wide = x + 6, version >= 2
    count, at = number(at, 4 if wide else 2), at + (4 if wide else 2)
    for _ in range(min(count, MAX_BOXES)):
        item, at = number(at, 4 if wide else 2), at + (4 if wide else 2) + (2 if version else 0) + 2
        base, at = number(at, base_size), at + base_size
        extents, at = number(at, 2), at + 2
        for i in range(extents):
            start = base + number(at + index_size, offset_size)
            at += index_size + offset_size + length_size
            if item == wanted and i == 0:
                start += 4 + number(start, 4)
                return start if data[start : start + 2] in (b"II", b"MM") else None
    return None


def parse(data: bytes) -> dict:
    """make, model, lens, iso, exposure, f_number, orientation, gps, dims and the three raw dates."""
    out: dict = dict.fromkeys(("make", "model", "lens", "iso", "exposure", "f_number", "gps", "dims", "original", "digitized", "modified"))
    out["orientation"] = 1
    start = in_jpeg(data) if data[:2] == b"\xff\xd8" else in_isobmff(data) if data[4:8] == b"ftyp" else None
    if start is None:
        return out
    t = Tiff(data[start:])
    if not t.order:
        return out
    at, seen, sub, gps = t.number("I", 4) or 0, set(), None, None
    while at and at not in seen and len(seen) < MAX_IFDS:
        seen.add(at)
        e = t.entries(at)
        out["make"], out["model"] = _text(e.get(0x010F)) or out["make"], _text(e.get(0x0110)) or out["model"]
        turned = _uint(t, e.get(0x0112))
        out["orientation"] = turned if turned in range(1, 9) else out["orientation"]
        out["modified"] = _text(e.get(0x0132)) or out["modified"]
        sub, gps = _uint(t, e.get(0x8769)) or sub, _uint(t, e.get(0x8825)) or gps
        at = t.following(at)
    if sub:
        e = t.entries(sub)
        out["original"], out["digitized"], out["lens"] = _text(e.get(0x9003)), _text(e.get(0x9004)), _text(e.get(0xA434))
        out["exposure"], out["f_number"], out["iso"] = _ratio(t, e.get(0x829A)), _ratio(t, e.get(0x829D)), _uint(t, e.get(0x8827))
        w, h = _uint(t, e.get(0xA002)) or 0, _uint(t, e.get(0xA003)) or 0
        out["dims"] = {"w": w, "h": h} if w or h else None
    if gps:
        e = t.entries(gps)
        south, west = _text(e.get(1)), _text(e.get(3))
        if south and west:
            lat, lon = _degrees(t, e.get(2), south.startswith("S"), 90), _degrees(t, e.get(4), west.startswith("W"), 180)
            out["gps"] = {"lat": lat, "lon": lon} if lat is not None and lon is not None else None
    return out
