"""Pictures of extracted files: their kind and size from the first bytes, and which of them are kept.

Decoding and scaling are left to the service that looks at pictures: no library for them is at hand. ``fitted`` says to
what size it should bring one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

from pageloom.sources.formats import MAX_IMAGES, MAX_PIXELS, MIN_EDGE

MAX_EXAMINED, MAX_EDGE = 400, 1024


@dataclass
class Picture:
    unit: int
    path: str
    kind: str
    width: int
    height: int
    content: bytes


def probe(b: bytes) -> tuple[str, int, int] | None:
    """Kind, width and height of a PNG, JPEG, BMP or GIF; null for others and for broken headers."""
    if b[:4] == b"\x89PNG" and b[12:16] == b"IHDR" and len(b) >= 24:
        return ("png", *struct.unpack_from(">II", b, 16))
    if b[:2] == b"\xff\xd8":
        return _jpeg(b)
    if b[:2] == b"BM" and len(b) >= 26 and struct.unpack_from("<I", b, 14)[0] >= 40:
        width, height = struct.unpack_from("<ii", b, 18)  # negative: stored from the top
        return "bmp", abs(width), abs(height)
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        return ("gif", *struct.unpack_from("<HH", b, 6))
    return None


def _jpeg(b: bytes) -> tuple[str, int, int] | None:
    """Segments are passed over by their lengths up to the frame's header, which must stand before the scan."""
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 1 or 0xD0 <= marker <= 0xD7:
            at += 2
        elif marker in (0xD9, 0xDA):
            return None
        else:
            size = struct.unpack_from(">H", b, at + 2)[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                if size < 2 or at + 9 > len(b):
                    return None
                height, width = struct.unpack_from(">HH", b, at + 5)
                return "jpeg", width, height
            if size < 2:
                return None
            at += 2 + size
    return None


def fitted(kind: str, width: int, height: int) -> tuple[int, int] | None:
    """The size to encode a picture anew in: at most 1024 on its longer edge. Null if it can stay as it is; BMP and GIF
    never can."""
    edge = max(width, height)
    if edge > MAX_EDGE:
        return tuple(max(1, int(n * MAX_EDGE / edge + 0.5)) for n in (width, height))
    return (width, height) if kind in ("bmp", "gif") else None


def collected(places: list[tuple[int, str]], load: Callable[[list[str]], dict[str, bytes]]) -> tuple[list[Picture], bool]:
    """The pictures kept of (unit, path) in order, and whether there were more than may be looked at or kept.

    A path counts where it first stands. Of 400 looked at, 50 are kept: those with both edges of 50 pixels or more and
    no more than four million pixels in all.
    """
    first: dict[str, int] = {}
    for unit, path in places:
        first.setdefault(path, unit)
    looked = list(first)[:MAX_EXAMINED]
    found, out, more = load(looked) if looked else {}, [], len(first) > MAX_EXAMINED
    for path in looked:
        if path in found and len(out) >= MAX_IMAGES:
            more = True
        elif path in found:
            size = probe(found[path])
            if size and min(size[1:]) >= MIN_EDGE and size[1] * size[2] <= MAX_PIXELS:
                out.append(Picture(first[path], path, *size, found[path]))
    return out, more
