"""Containers of office files: zip archives, compound files and XML, with limits on what they may unpack to."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

MAX_INFLATED, MAX_ENTRIES = 300 * 1024 * 1024, 10_000


class Damaged(ValueError):
    """A file that is not what its first bytes promise."""


def unzip(content: bytes, wanted=lambda name: True) -> dict[str, bytes]:
    """Entries by name; fails over 10,000 entries or 300 MB unpacked, counted while unpacking."""
    out, left = {}, MAX_INFLATED
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [i for i in z.infolist() if not i.is_dir()]
            if len(names) > MAX_ENTRIES:
                raise Damaged("too many entries")
            for info in names:
                if wanted(info.filename):
                    with z.open(info) as f:
                        data = f.read(left + 1)
                    left -= len(data)
                    if left < 0:
                        raise Damaged("too large unpacked")
                    out[info.filename] = data
    except (zipfile.BadZipFile, RuntimeError, zlib.error, EOFError) as e:
        raise Damaged(str(e)) from e
    return out


def entries(content: bytes) -> list[str]:
    """Names of all entries."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [i.filename for i in z.infolist() if not i.is_dir()]
    except zipfile.BadZipFile as e:
        raise Damaged(str(e)) from e


def inflate(data: bytes, most: int = MAX_INFLATED, wbits: int = -15) -> bytes:
    d = zlib.decompressobj(wbits)
    try:
        out = d.decompress(data, most)
    except zlib.error as e:
        raise Damaged(str(e)) from e
    if d.unconsumed_tail:
        raise Damaged("too large unpacked")
    return out


class CompoundFile:
    """Streams of a compound file by path, such as BodyText/Section0."""

    FREE, END = 0xFFFFFFFF, 0xFFFFFFFE

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1") or len(data) < 512:
            raise Damaged("no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise Damaged("sector size")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        n_fat, directory, _, self.cutoff, mini_fat, _, difat, _ = struct.unpack_from("<I I I I I I I I", data, 44)
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < self.END]
        seen = set()
        while difat < self.END:
            if difat in seen:
                raise Damaged("loop")
            seen.add(difat)
            *more, difat = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            sectors += [s for s in more if s < self.END]
        self.fat = [x for s in sectors[:n_fat] for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        small = self._chain(mini_fat) if mini_fat < self.END else b""
        self.mini_fat = list(struct.unpack(f"<{len(small) // 4}I", small))
        entries = self._chain(directory)
        self.entries = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        self.ministream = b""
        self.streams: dict[str, tuple[int, int]] = {}
        if self.entries:
            start, length = struct.unpack_from("<I I", self.entries[0], 116)
            self.ministream = self._chain(start)[:length] if start < self.END else b""
            self._walk(struct.unpack_from("<I", self.entries[0], 76)[0], "", set())

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        part = self.data[at : at + self.size]
        if not part:
            raise Damaged("sector outside the file")
        return part.ljust(self.size, b"\0")

    def _chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < self.END:
            if start in seen or start >= len(self.fat):
                raise Damaged("broken chain")
            seen.add(start)
            out.append(self._sector(start))
            start = self.fat[start]
        return b"".join(out)

    def _walk(self, first: int, path: str, seen: set[int]) -> None:
        todo = [(first, path)]
        while todo:
            n, path = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            e = self.entries[n]
            length = struct.unpack_from("<H", e, 64)[0]
            name = path + e[: max(0, length - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", e, 68)
            todo += [(left, path), (right, path)]
            if e[66] == 1:
                todo.append((child, name + "/"))
            elif e[66] == 2:
                self.streams[name] = struct.unpack_from("<I I", e, 116)

    def read(self, name: str) -> bytes:
        start, length = self.streams[name]
        if length >= self.cutoff:
            return self._chain(start)[:length]
        out, seen = [], set()
        while start < self.END and len(out) * self.mini < length:
            if start in seen or start >= len(self.mini_fat):
                raise Damaged("broken chain")
            seen.add(start)
            out.append(self.ministream[start * self.mini : (start + 1) * self.mini])
            start = self.mini_fat[start]
        return b"".join(out)[:length]


# ---- XML


def parse(data: bytes | None) -> ElementTree.Element | None:
    """The root element; null for a missing part. Document types are refused, so no entity can grow."""
    if data is None:
        return None
    if b"<!DOCTYPE" in data[:4096]:
        raise Damaged("document type in XML")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise Damaged(str(e)) from e


def local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def attribute(e: ElementTree.Element | None, name: str) -> str | None:
    """An attribute by its local name."""
    if e is None:
        return None
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def child(e: ElementTree.Element | None, *names: str) -> ElementTree.Element | None:
    """The first element down a path of local names."""
    for name in names:
        e = next((c for c in e if local(c) == name), None) if e is not None else None
    return e


def walk(e: ElementTree.Element, skip: frozenset[str] = frozenset()) -> Iterator[ElementTree.Element]:
    """An element and all below it, in order, without those named in skip."""
    todo = [e]
    while todo:
        e = todo.pop()
        if local(e) not in skip:
            yield e
            todo += list(reversed(list(e)))


def relations(parts: dict[str, bytes], part: str) -> dict[str, tuple[str, str]]:
    """Type and target part of each relation of a part; external ones are left out."""
    folder, _, name = part.rpartition("/")
    root = parse(parts.get(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"))
    out = {}
    for r in root if root is not None else []:
        if attribute(r, "TargetMode") == "External":
            continue
        target = attribute(r, "Target") or ""
        steps = [] if target.startswith("/") else folder.split("/") if folder else []
        for step in target.split("/"):
            if step == "..":
                steps = steps[:-1]
            elif step not in ("", "."):
                steps.append(step)
        out[attribute(r, "Id")] = ((attribute(r, "Type") or "").rpartition("/")[2], "/".join(steps))
    return out
