"""What an extracted file is made of: blocks put into units, headings, and grids of cells."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pageloom.sources.containers import Damaged

UNIT_CHARS, MAX_PAGES = 1800, 500
MAX_COLUMNS, MAX_PLACES = 256, 200_000


@dataclass
class Block:
    text: str
    break_before: bool = False
    level: int | None = None
    title: str | None = None
    pictures: list[str] = field(default_factory=list)


@dataclass
class Extracted:
    kind: str
    unit_kind: str
    units: list[str] = field(default_factory=list)
    headings: list[tuple[int, str, int]] = field(default_factory=list)
    sections: list[tuple[str, int]] = field(default_factory=list)
    pictures: list[tuple[int, str]] = field(default_factory=list)
    #: contents of pictures by path; those that cannot be read are left out
    load: Callable[[list[str]], dict[str, bytes]] = lambda paths: {}


def paged(kind: str, blocks: list[Block]) -> Extracted:
    """Blocks put into units of about 1,800 characters; headings with the unit they are in. Files without text or of
    more than MAX_PAGES units are refused."""
    out, current, size = Extracted(kind, "page"), [], 0

    def shut() -> None:
        nonlocal current, size
        if current:
            out.units.append("\n\n".join(current))
        current, size = [], 0

    for b in blocks:
        text = b.text.strip()
        if b.break_before or (text and size and size + len(text) > UNIT_CHARS):
            shut()
        if text:
            current.append(text)
            size += len(text)
            if b.level is not None:
                out.headings.append((b.level, b.title or text, len(out.units)))
        out.pictures += [(len(out.units), path) for path in b.pictures]
    shut()
    out.pictures = [(min(unit, len(out.units) - 1), path) for unit, path in out.pictures]
    if not out.units:
        raise Damaged("no text")
    if len(out.units) > MAX_PAGES:
        raise Damaged(f"{len(out.units)} units, more than {MAX_PAGES}")
    return out


def markdown(rows: list[list[str]]) -> str:
    """A Markdown table; nothing for an empty one."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    clean = lambda t: re.sub(r"\s*\n\s*", " ", t).replace("\\", "\\\\").replace("|", "\\|").strip()
    lines = ["| " + " | ".join(clean(c) for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


@dataclass
class Cell:
    row: int
    col: int
    rows: int
    cols: int
    text: str


def grid(cells: list[Cell], rows: int, cols: int) -> list[list[str]]:
    """Cells at their places. One that covers several rows repeats its text down, not across; the first to hold a place
    keeps it. The grid reaches to each cell's own place, and as far as spans go within the declared rows and cols. What
    lies beyond 256 columns or 200,000 places follows as plain rows, one for each row it came from."""
    cells = [c for c in cells if c.row >= 0 and c.col >= 0]
    reach = lambda at, end, most: max([0, *map(at, cells)]) if not cells else max(max(map(at, cells)) + 1, min(max(map(end, cells)), max(0, most)))
    height, wide = reach(lambda c: c.row, lambda c: c.row + c.rows, rows), reach(lambda c: c.col, lambda c: c.col + c.cols, cols)
    width = min(wide, MAX_COLUMNS)
    height = min(height, MAX_PLACES // width) if width else 0
    places: dict[tuple[int, int], str] = {}
    beyond: dict[int, list[tuple[int, str]]] = {}
    for c in cells:
        if c.row >= height or c.col >= width:
            if c.text.strip():
                beyond.setdefault(c.row, []).append((c.col, " ".join(c.text.split())))
        elif (c.row, c.col) not in places:
            for r in range(c.row, min(height, c.row + c.rows)):
                for k in range(c.col, min(width, c.col + c.cols)):
                    places.setdefault((r, k), c.text if k == c.col else "")
    out = [[places.get((r, k), "") for k in range(width)] for r in range(height)]
    for r in sorted(beyond):
        texts = [text for _, text in sorted(beyond[r], key=lambda x: x[0])]
        out.append([" / ".join(texts), *[""] * (max(1, width) - 1)])
    return out
