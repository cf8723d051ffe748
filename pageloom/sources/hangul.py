"""HWPX and HWP 5 files. Each format says what its paragraphs hold, piece by piece; one Story puts the pieces together."""

from __future__ import annotations

import re
import struct
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import takewhile
from typing import Any
from urllib.parse import unquote
from xml.etree import ElementTree

from pageloom.sources.containers import CompoundFile, Damaged, attribute, child, inflate, local, parse, walk
from pageloom.sources.units import Block, Cell, Extracted, grid, markdown, paged

MAX_NESTED, MAX_SHAPES = 16, 32


@dataclass
class Table:
    """Cells as row, column, rows, columns and paragraphs, and the size that the file declares."""

    cells: list[tuple[int, int, int, int, list]]
    rows: int
    cols: int


class Story:
    """Text of paragraphs. ``pieces`` gives what a paragraph holds, in order: ("text", str), ("equation", str),
    ("table", Table), ("box", paragraphs) or ("picture", reference). ``path`` gives a reference's file, if there is one."""

    def __init__(self, pieces: Callable[[Any], Iterable[tuple[str, Any]]], path: Callable[[Any], str | None]):
        self.pieces, self.path = pieces, path

    def blocks(self, paragraphs: Iterable[tuple[Any, bool, int | None]]) -> list[Block]:
        """Blocks of (paragraph, starts a page, level): its texts and tables, then its boxes, which break no page.

        A picture belongs to the text or table that it stands in; without one, to the block before.
        """
        out: list[Block] = []
        for paragraph, broken, level in paragraphs:
            parts, boxes, pictures = self._parts(paragraph, 0, False)
            if broken and not parts:
                out.append(Block("", True))
            made = [Block(text, broken and i == 0, None if i else level, text.strip().split("\n")[0]) for i, text in enumerate(parts)]
            out += made
            for i, reference in pictures:
                self._hang(reference, made[min(i, len(made) - 1)] if made else None, out)
            for box in boxes:
                text = self._within(box, 1, False)
                if text.strip():
                    out.append(Block(text))
                for reference in self._pictures(box):
                    self._hang(reference, None, out)
        return out

    def _hang(self, reference, block: Block | None, out: list[Block]) -> None:
        path = self.path(reference)
        if path:
            if not out:
                out.append(Block(""))
            (block or out[-1]).pictures.append(path)

    def _pictures(self, paragraphs: list) -> Iterator[Any]:
        """References of all pictures in paragraphs and what they hold."""
        todo = list(reversed(paragraphs))
        while todo:
            below = []
            for kind, value in self.pieces(todo.pop()):
                if kind == "picture":
                    yield value
                elif kind == "table":
                    below += [p for c in value.cells for p in c[4]]
                elif kind == "box":
                    below += value
            todo += reversed(below)

    def _parts(self, paragraph, depth: int, flat: bool) -> tuple[list[str], list[list], list[tuple[int, Any]]]:
        """Texts and tables, boxes, and pictures with the number of the text or table they stand in."""
        parts, boxes, pictures, behind = [""], [], [], False
        filled = lambda: sum(bool(p.strip()) for p in parts)
        for kind, value in self.pieces(paragraph):
            if kind == "text" and value:
                parts[-1] += (" " if behind and not value[0].isspace() else "") + value
                behind = False
            elif kind == "equation" and value.split():
                parts[-1] += (" " if parts[-1] and not parts[-1][-1].isspace() else "") + _equation(value)
                behind = True
            elif kind == "table":
                if not depth:
                    pictures += [(filled(), r) for r in self._pictures([p for c in value.cells for p in c[4]])]
                parts += [self._table(value, depth + 1, flat), ""]
                behind = False
            elif kind == "picture":
                pictures.append((filled() - bool(parts[-1].strip()), value))
            elif kind == "box":
                boxes.append(value)
        return [p for p in parts if p.strip()], boxes, pictures

    def _within(self, paragraphs: list, depth: int, flat: bool) -> str:
        """A cell's or a box's text: paragraphs on lines, its own boxes behind each."""
        if depth > MAX_NESTED:
            return self._plain(paragraphs)
        lines = []
        for p in paragraphs:
            parts, boxes, _ = self._parts(p, depth, flat)
            lines += [*parts, *(self._within(b, depth + 1, flat) for b in boxes)]
        return "\n".join(lines)

    def _table(self, table: Table, depth: int, flat: bool) -> str:
        """A Markdown table; inside a cell, rows `a / b; c / d`."""
        if depth > MAX_NESTED:
            return self._plain([p for c in table.cells for p in c[4]])
        rows = grid([Cell(*c[:4], self._within(c[4], depth, True)) for c in table.cells], table.rows, table.cols)
        if not flat:
            return markdown(rows)
        rows = [[" ".join(text.split()) for text in row] for row in rows]
        return "; ".join(" / ".join(row) for row in rows if any(row))

    def _plain(self, paragraphs: list) -> str:
        """What lies too deep, without structure and without recursion."""
        out, todo = [], list(reversed(paragraphs))
        while todo:
            below = []
            for kind, value in self.pieces(todo.pop()):
                if kind == "text":
                    out.append(value)
                elif kind == "equation" and value.split():
                    out.append(f" {_equation(value)} ")
                elif kind == "table":
                    below += [p for c in value.cells for p in c[4]]
                elif kind == "box":
                    below += value
            out.append("\n")
            todo += reversed(below)
        return "".join(out).strip()


def _equation(script: str) -> str:
    return f"[수식: {' '.join(script.split())}]"


# ---- HWPX

# fixed values: names of what is no body text, the package's media type, characters written as elements
_ASIDE = frozenset({"ctrl", "secPr", "linesegarray", "shapeComment", "hiddenComment"})
_PACKAGE = "application/hwpml-package+xml"
_CHARACTERS = {"lineBreak": "\n", "tab": "\t", "nbSpace": " ", "fwSpace": " ", "hyphen": "-"}


def _named(e: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [c for c in e if local(c) == name] if e is not None else []


def _number(e: ElementTree.Element | None, name: str, default: int) -> int:
    m = re.match(r"\s*(-?\d+)", attribute(e, name) or "")
    return int(m[1]) if m else default


def _hwpx_pieces(p: ElementTree.Element) -> Iterator[tuple[str, Any]]:
    todo = list(reversed(p))
    while todo:
        e = todo.pop()
        name = local(e)
        if name == "t":
            yield "text", (e.text or "") + "".join(_CHARACTERS.get(local(c), "") + (c.tail or "") for c in e)
        elif name == "equation":
            yield "equation", "".join(child(e, "script").itertext()) if child(e, "script") is not None else ""
        elif name == "tbl":
            yield "table", _hwpx_table(e)
        elif name == "pic":
            image = next((x for x in walk(e) if local(x) == "img"), None)
            if attribute(image, "binaryItemIDRef"):
                yield "picture", attribute(image, "binaryItemIDRef")
        elif name == "drawText":
            yield from (("box", _named(inner, "p")) for inner in _named(e, "subList"))
        elif name not in _ASIDE:
            todo += reversed(e)


def _hwpx_table(tbl: ElementTree.Element) -> Table:
    cells, trs = [], _named(tbl, "tr")
    for r, tr in enumerate(trs):
        col = 0
        for tc in _named(tr, "tc"):
            address, span = child(tc, "cellAddr"), child(tc, "cellSpan")
            col, wide = _number(address, "colAddr", col), max(1, _number(span, "colSpan", 1))
            cells.append((_number(address, "rowAddr", r), col, max(1, _number(span, "rowSpan", 1)), wide, _named(child(tc, "subList"), "p")))
            col += wide
    return Table(cells, _number(tbl, "rowCnt", len(trs)), _number(tbl, "colCnt", max((c[1] + c[3] for c in cells), default=0)))


def package(parts: dict[str, bytes], names: frozenset[str], media_type: str = _PACKAGE, usual: str = "Contents/content.hpf") -> tuple[dict[str, str], list[str]]:
    """Part of each item by id, and the spine's parts in order, from the package file that container.xml names for the
    media type, or from the usual one. References count from the package file, or from the root if none of the names is
    there. Without a readable package both are empty."""
    for path in (_root_file(parts, media_type), usual):
        try:
            root = parse(parts.get(path)) if path else None
        except Damaged:
            root = None
        if root is None:
            continue
        folder = path.rpartition("/")[0]
        items = {}
        for e in walk(root):
            if local(e) == "item" and attribute(e, "id") and attribute(e, "href"):
                href = unquote(attribute(e, "href"), errors="replace")
                steps = folder.split("/") if folder else []
                for step in href.split("/"):
                    steps = steps[:-1] if step == ".." else steps if step in ("", ".") else [*steps, step]
                items[attribute(e, "id")] = "/".join(steps) if "/".join(steps) in names else href
        return items, [items[attribute(e, "idref")] for e in walk(root) if local(e) == "itemref" and attribute(e, "idref") in items]
    return {}, []


def _root_file(parts: dict[str, bytes], media_type: str) -> str | None:
    try:
        root = parse(parts.get("META-INF/container.xml"))
    except Damaged:
        return None
    found = walk(root) if root is not None else []
    return next((attribute(e, "full-path") for e in found if local(e) == "rootfile" and attribute(e, "media-type") == media_type), None)


def encrypted(parts: dict[str, bytes]) -> bool:
    """Whether the archive's manifest has data on how a part was encrypted."""
    try:
        root = parse(parts.get("META-INF/manifest.xml"))
    except Damaged:
        return False
    return root is not None and any(local(e) == "encryption-data" for e in walk(root))


def _hwpx_levels(header: bytes | None) -> dict[str, int]:
    """Outline level by the id of a paragraph's properties; they are hints, so a broken header gives none."""
    try:
        root = parse(header)
    except Damaged:
        return {}
    heads = ((attribute(e, "id"), child(e, "heading")) for e in (walk(root) if root is not None else []) if local(e) == "paraPr")
    return {name: _number(h, "level", 0) + 1 for name, h in heads if h is not None and attribute(h, "type") == "OUTLINE"}


def hwpx(parts: dict[str, bytes], names: list[str] | None = None) -> Extracted:
    """Sections in the order of the package's spine, or by number. names: all entries, if parts leaves some out."""
    if encrypted(parts):
        raise Damaged("encrypted")
    present = frozenset(names or parts)
    items, spine = package(parts, present)
    stems = {m[1].lower(): n for n in reversed(names or list(parts)) if (m := re.fullmatch(r"(?i)BinData/([^/]+)\.[^./]+", n))}
    picture = lambda reference: items[reference] if items.get(reference) in present else stems.get(reference.lower())
    numbered = [n for n in parts if re.fullmatch(r"(?i)Contents/section\d+\.xml", n)]
    names = [n for n in spine if re.search(r"(?i)(^|/)section\d+\.xml$", n)] or sorted(numbered, key=lambda n: int(re.sub(r"\D", "", n)))
    if not names:
        raise Damaged("no section")
    header = next((p for p in items.values() if re.search(r"(?i)(^|/)header\.xml$", p)), "Contents/header.xml")
    levels = _hwpx_levels(parts.get(header))

    def paragraphs() -> Iterator[tuple[ElementTree.Element, bool, int | None]]:
        for number, name in enumerate(names):
            root = parse(parts.get(name))
            if root is None or local(root) != "sec":
                raise Damaged(f"{name} is no section")
            for i, p in enumerate(_named(root, "p")):
                yield p, attribute(p, "pageBreak") == "1" or (number > 0 and i == 0), levels.get(attribute(p, "paraPrIDRef"))

    return paged("hwpx", Story(_hwpx_pieces, picture).blocks(paragraphs()))


# ---- HWP 5

# fixed values: record tags, control characters of eight places, those among them with a control of their own, flags
_BINARY, _SHAPE, _PARAGRAPH, _TEXT, _CONTROL, _LIST, _TABLE, _PICTURE, _EQUATION = 18, 25, 66, 67, 71, 72, 77, 85, 88
_PICTURE_ID = 71
_WIDE = frozenset([*range(1, 10), 11, 12, *range(14, 24)])
_OWNED = frozenset([1, 2, 3, 11, 12, *range(14, 19), 21, 22, 23])
_COMPRESSED, _PASSWORD, _DISTRIBUTED, _RIGHTS = 1, 2, 4, 16
_BREAKS = 1 | 4
_PRIVATE = re.compile("[\ue000-\uf8ff\U000f0000-\U0010ffff]")


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Tag, level and body of each record: ten bits, ten bits and a size of twelve, or of 32 where those are full."""
    at = 0
    while at + 4 <= len(data):
        head = struct.unpack_from("<I", data, at)[0]
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                raise Damaged("record")
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        if at + size > len(data):
            raise Damaged("record")
        yield head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size]
        at += size


@dataclass
class Record:
    tag: int
    body: bytes
    below: list[Record] = field(default_factory=list)


def tree(data: bytes) -> list[Record]:
    """The records without one above them; each holds those that follow it on deeper levels."""
    root = Record(0, b"")
    above = [(-1, root)]
    for tag, level, body in records(data):
        while above[-1][0] >= level:
            above.pop()
        made = Record(tag, body)
        above[-1][1].below.append(made)
        above.append((level, made))
    return root.below


def hwp_runs(body: bytes) -> Iterator[tuple[str, str]]:
    """("text", characters) and ("control", its four letters) in the order of a paragraph's text."""
    units, out, at = struct.unpack(f"<{len(body) // 2}H", body[: len(body) // 2 * 2]), [], 0
    flush = lambda: ("text", _PRIVATE.sub("", struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "replace")))
    plain = {9: 9, 10: 10, 24: 45, 30: 32, 31: 32}
    while at < len(units):
        u = units[at]
        if u in _WIDE and at + 8 > len(units):
            raise Damaged("control cut short")
        if u in _OWNED:
            yield flush()
            out = []
            yield "control", _letters(body, at * 2 + 2)
        elif u >= 32 or u in plain:
            out.append(plain.get(u, u))
        at += 8 if u in _WIDE else 1
    yield flush()


def _letters(body: bytes, at: int = 0) -> str:
    return body[at : at + 4][::-1].decode("latin-1")


def _after(siblings: list[Record], at: int) -> list[Record]:
    """The paragraphs right behind a list's header: they are what it holds."""
    return list(takewhile(lambda r: r.tag == _PARAGRAPH, siblings[at + 1 :]))


def _hwp_pieces(paragraph: Record) -> Iterator[tuple[str, Any]]:
    """Each place in the text takes the next control of its letters; controls without a place come last."""
    waiting: dict[str, deque[Record]] = defaultdict(deque)
    controls = [r for r in paragraph.below if r.tag == _CONTROL]
    for c in controls:
        waiting[_letters(c.body)].append(c)
    placed = set()
    text = next((r.body for r in paragraph.below if r.tag == _TEXT), b"")
    for kind, value in hwp_runs(text):
        if kind == "text":
            yield kind, value
        elif waiting[value]:
            c = waiting[value].popleft()
            placed.add(id(c))
            yield from _hwp_control(c)
    for c in controls:
        if id(c) not in placed:
            yield from _hwp_control(c)


def _hwp_control(c: Record) -> Iterator[tuple[str, Any]]:
    """Tables, shapes' boxes and equations; headers, notes, fields and the like are no body text."""
    letters = _letters(c.body)
    if letters == "tbl ":
        yield "table", _hwp_table(c.below)
    elif letters == "gso ":
        yield from _shapes(c)
    elif letters == "eqed":
        script = next((r.body for r in c.below if r.tag == _EQUATION and len(r.body) >= 6), None)
        if script is not None:
            n = struct.unpack_from("<H", script, 4)[0]
            yield "equation", script[6 : 6 + 2 * n].decode("utf-16-le", "replace")


def _hwp_table(below: list[Record]) -> Table:
    """A caption's list stands before the table's record and is no cell."""
    at = next((i for i, r in enumerate(below) if r.tag == _TABLE and len(r.body) >= 8), None)
    if at is None:
        raise Damaged("no table record")
    cells = []
    for i in range(at + 1, len(below)):
        if below[i].tag == _LIST:
            if len(below[i].body) < 16:
                raise Damaged("cell cut short")
            col, row, cols, rows = struct.unpack_from("<4H", below[i].body, 8)
            cells.append((row, col, max(1, rows), max(1, cols), _after(below, i)))
    return Table(cells, *struct.unpack_from("<2H", below[at].body, 4))


def _shapes(shape: Record, depth: int = 0) -> Iterator[tuple[str, Any]]:
    """Text boxes and pictures of a shape and of the shapes in it; a list right below the control is its caption."""
    for i, r in enumerate(shape.below):
        if r.tag == _PICTURE:
            if len(r.body) >= _PICTURE_ID + 2:
                yield "picture", struct.unpack_from("<H", r.body, _PICTURE_ID)[0]
        elif r.tag == _LIST:
            if depth:
                yield "box", _after(shape.below, i)
        elif r.tag != _PARAGRAPH and depth < MAX_SHAPES:
            yield from _shapes(r, depth + 1)


def picture_streams(info: bytes) -> list[tuple[str, int] | None]:
    """Stream and mode of compression (0: the document's, 1: yes, 2: no) of each embedded file; null for others."""
    out: list[tuple[str, int] | None] = []
    for body in (body for tag, _, body in records(info) if tag == _BINARY):
        kind, number, length = struct.unpack_from("<3H", body) if len(body) >= 6 else (0, 0, 0)
        name = body[6 : 6 + 2 * length].decode("utf-16-le", "replace").lower()
        good = kind & 15 == 1 and len(name) == length and re.fullmatch("[a-z0-9]{1,8}", name)
        out.append((f"BinData/BIN{number:04X}.{name}", kind >> 4 & 3) if good else None)
    return out


def outline_levels(info: bytes) -> dict[int, int]:
    """Level by number of a paragraph shape: bits 23 and 24 are 1 for an outline, the next three its level from 0."""
    shapes = (body for tag, _, body in records(info) if tag == _SHAPE)
    bits = ((n, struct.unpack_from("<I", body)[0]) for n, body in enumerate(shapes) if len(body) >= 4)
    return {n: (b >> 25 & 7) + 1 for n, b in bits if b >> 23 & 3 == 1}


def hwp(data: bytes) -> Extracted:
    file = CompoundFile(data)
    header = file.read("FileHeader") if "FileHeader" in file.streams else b""
    if not header.startswith(b"HWP Document File") or len(header) < 40:
        raise Damaged("no file header")
    version, flags = struct.unpack_from("<II", header, 32)
    if version >> 24 != 5:
        raise Damaged(f"version {version >> 24}")
    if flags & _DISTRIBUTED:
        raise Damaged("distribution document")
    if flags & (_PASSWORD | _RIGHTS):
        raise Damaged("encrypted")
    read = lambda name: inflate(file.read(name)) if flags & _COMPRESSED else file.read(name)
    if "DocInfo" not in file.streams:
        raise Damaged("no document information")
    info = read("DocInfo")
    levels, streams = outline_levels(info), picture_streams(info)
    actual = {n.lower(): n for n in file.streams}  # names differ in case
    modes: dict[str, int] = {}

    def picture(number: int) -> str | None:
        stream, mode = (streams[number - 1] if 0 < number <= len(streams) else None) or ("", 0)
        path = actual.get(stream.lower())
        if path:
            modes[path] = mode
        return path

    def load(paths: list[str]) -> dict[str, bytes]:
        out = {}
        for path in paths:
            packed = modes[path] == 1 or (modes[path] == 0 and flags & _COMPRESSED)
            try:
                out[path] = inflate(file.read(path)) if packed else file.read(path)
            except Damaged:
                continue  # one broken picture does not cost the others
        return out

    names = sorted((n for n in file.streams if re.fullmatch(r"(?i)BodyText/Section\d+", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    if not names:
        raise Damaged("distribution document" if any(n.lower().startswith("viewtext/") for n in file.streams) else "no section")

    def paragraphs() -> Iterator[tuple[Record, bool, int | None]]:
        for number, name in enumerate(names):
            for i, p in enumerate(r for r in tree(read(name)) if r.tag == _PARAGRAPH):
                broken = (len(p.body) > 11 and bool(p.body[11] & _BREAKS)) or (number > 0 and i == 0)
                yield p, broken, levels.get(struct.unpack_from("<H", p.body, 8)[0]) if len(p.body) >= 10 else None

    out = paged("hwp", Story(_hwp_pieces, picture).blocks(paragraphs()))
    out.load = load
    return out
