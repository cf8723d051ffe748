"""Office files as rows of units (pages, slides, sections), headings and sections, in Arrow workers.

Each format has one function from bytes to an Extracted. The first whose test holds is used.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from pageloom.sources.containers import Damaged, attribute, child, entries, inflate, local, parse, relations, unzip, walk
from pageloom.sources.hangul import hwp, hwpx
from pageloom.sources.pictures import collected
from pageloom.sources.units import MAX_COLUMNS, MAX_PAGES, Block, Extracted, markdown, paged

LEAST_TEXT = 50
#: Pictures that a batch of rows may hold before it is handed on.
BATCH_BYTES = 64 * 1024 * 1024
GROUP_DEPTH, CHART_ROWS, CHART_SERIES = 32, 50, 20


# ---- DOCX


# fixed values: names of heading styles, values that switch off, and the characters of symbol fonts that carry meaning
_HEADING = re.compile(r"(?:Heading|제목)\s*([1-9])", re.I)
_OFF = ("0", "false", "off")
_SYMBOLS = {
    "wingdings": {0xFE: "☑", 0xFD: "☒", 0x78: "☒", 0xA8: "☐", 0x6F: "☐", 0xFC: "✓", 0xFB: "✗", 0xA7: "•", 0x9F: "•", 0x6C: "•"},
    "symbol": {0xB7: "•"},
}
_UNSEEN = frozenset({"del", "moveFrom", "pPr", "rPr", "sdtPr", "sdtEndPr", "tbl", "txbxContent", "Fallback"})


def _on(e: ElementTree.Element | None) -> bool | None:
    """Whether a switch is on; null without one."""
    return None if e is None else attribute(e, "val") not in _OFF


def _outline(ppr: ElementTree.Element | None) -> int | None:
    """1 to 9, or 0 for a paragraph said to be body text; null if nothing is said."""
    value = attribute(child(ppr, "outlineLvl"), "val")
    return (int(value) + 1) % 10 if value and value.isdigit() and int(value) < 10 else None


class _Styles:
    """Outline levels and page breaks of the paragraph styles, their own or those of the styles they build on.

    They are hints: a missing or broken part gives none."""

    def __init__(self, part: bytes | None):
        try:
            root = parse(part)
        except Damaged:
            root = None
        self.base, self.levels, self.breaks, self.default = {}, {}, {}, None
        for s in root if root is not None else []:
            name = attribute(s, "styleId")
            if local(s) != "style" or not name or attribute(s, "type") != "paragraph":
                continue
            called = _HEADING.fullmatch((attribute(child(s, "name"), "val") or "").strip())
            level = _outline(child(s, "pPr"))
            self.levels[name] = int(called[1]) if level is None and called else level
            self.breaks[name] = _on(child(s, "pPr", "pageBreakBefore"))
            self.base[name] = attribute(child(s, "basedOn"), "val")
            if self.default is None and attribute(s, "default") not in (None, *_OFF):
                self.default = name

    def _inherited(self, values: dict, name: str | None):
        seen = set()
        while name in self.base and name not in seen:
            if values[name] is not None:
                return values[name]
            seen.add(name)
            name = self.base[name]
        return None

    def level(self, ppr: ElementTree.Element | None) -> int | None:
        """A heading's level: the paragraph's own word, its style's, or what the style's id says."""
        name = (attribute(child(ppr, "pStyle"), "val") or "").strip()
        own, styled = _outline(ppr), self._inherited(self.levels, name)
        called = _HEADING.fullmatch(name)
        return next((v for v in (own, styled) if v is not None), int(called[1]) if called else 0) or None

    def breaks_before(self, ppr: ElementTree.Element | None) -> bool:
        own = _on(child(ppr, "pageBreakBefore"))
        name = (attribute(child(ppr, "pStyle"), "val") or "").strip()
        return bool(self._inherited(self.breaks, name or self.default) if own is None else own)


def _symbol(e: ElementTree.Element) -> str:
    """A symbol font's character; codes may be moved into the private area. Unknown ones are left out."""
    code = attribute(e, "char") or ""
    number = int(code, 16) if re.fullmatch("[0-9A-Fa-f]{1,6}", code) else -1
    return _SYMBOLS.get((attribute(e, "font") or "").strip().lower(), {}).get(number - 0xF000 if 0xF000 <= number <= 0xF0FF else number, "")


def _run_texts(p: ElementTree.Element, pictures: list[list[str]] | None = None) -> list[str]:
    """A paragraph's visible text, cut at its page breaks; pictures gets the references of each cut."""
    out, hidden = [""], set()
    pictures = [] if pictures is None else pictures
    pictures.append([])
    for e in walk(p, _UNSEEN):
        name = local(e)
        if name == "r" and _on(child(e, "rPr", "vanish")):
            hidden.update(map(id, e.iter()))
        if id(e) in hidden:
            continue
        if name == "br" and attribute(e, "type") == "page":
            out.append("")
            pictures.append([])
        elif name == "blip" and attribute(e, "embed"):
            pictures[-1].append(attribute(e, "embed"))
        elif name == "t":
            out[-1] += e.text or ""
        elif name == "sym":
            out[-1] += _symbol(e)
        else:
            out[-1] += {"tab": "\t", "ptab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(name, "")
    return out


def _unwrapped(e: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Elements below, through wrappers; of alternatives the first choice."""
    for c in e:
        name = local(c)
        if name in ("sdt", "AlternateContent"):
            inner = child(c, "sdtContent" if name == "sdt" else "Choice")
            yield from _unwrapped(inner) if inner is not None else ()
        elif name in ("ins", "smartTag", "customXml"):
            yield from _unwrapped(c)
        else:
            yield c


def _cell_text(tc: ElementTree.Element) -> str:
    """A cell's paragraphs on lines; tables in it as rows `a / b; c / d`."""
    parts = []
    for e in _unwrapped(tc):
        if local(e) == "p":
            parts.append("\n".join(_run_texts(e)))
        elif local(e) == "tbl":
            parts.append("; ".join(" / ".join(filter(None, map(str.strip, row))) for row in _docx_rows(e)))
    return "\n".join(p for p in parts if p.strip())


def _count(e: ElementTree.Element | None, default: int) -> int:
    """A number of columns, never more than a table may have."""
    value = attribute(e, "val")
    return min(int(value), MAX_COLUMNS) if value and value.isdigit() else default


def _docx_rows(tbl: ElementTree.Element) -> list[list[str]]:
    """Rows with merged cells' text repeated down, not across."""
    rows, above = [], {}
    for tr in (e for e in _unwrapped(tbl) if local(e) == "tr"):
        row = [""] * _count(child(tr, "trPr", "gridBefore"), 0)
        for tc in (e for e in _unwrapped(tr) if local(e) == "tc"):
            merge = child(tc, "tcPr", "vMerge")
            text = above.get(len(row), "") if merge is not None and attribute(merge, "val") != "restart" else _cell_text(tc)
            above[len(row)] = text
            row += [text, *[""] * (max(1, _count(child(tc, "tcPr", "gridSpan"), 1)) - 1)]
        rows.append(row[:MAX_COLUMNS])
    return rows


def docx(parts: dict[str, bytes]) -> Extracted:
    body = child(parse(parts.get("word/document.xml")), "body")
    if body is None:
        raise Damaged("no document")
    styles, blocks = _Styles(parts.get("word/styles.xml")), []
    rels = relations(parts, "word/document.xml")
    files = lambda references: [rels[r][1] for r in references if r in rels]
    pending = False
    for e in _unwrapped(body):
        if local(e) == "tbl":
            blocks.append(Block(markdown(_docx_rows(e)), pending, pictures=files(_blips(e))))
            pending = False
        elif local(e) == "p":
            pictures: list[list[str]] = []
            ppr, texts = child(e, "pPr"), _run_texts(e, pictures)
            titled = next((i for i, text in enumerate(texts) if text.strip()), -1)
            for i, text in enumerate(texts):
                blocks.append(Block(text, i > 0 or pending or styles.breaks_before(ppr), styles.level(ppr) if i == titled else None, pictures=files(pictures[i])))
            pending = child(ppr, "sectPr") is not None and attribute(child(ppr, "sectPr", "type"), "val") != "continuous"
            blocks += (Block(text, pictures=files(references)) for text, references in _text_boxes(e))
    return paged("docx", blocks)


def _blips(e: ElementTree.Element) -> list[str]:
    """References of the pictures below an element."""
    return [attribute(x, "embed") for x in walk(e, _UNSEEN - {"tbl", "txbxContent"}) if local(x) == "blip" and attribute(x, "embed")]


def _text_boxes(p: ElementTree.Element) -> Iterator[tuple[str, list[str]]]:
    """Texts and tables of the boxes in a paragraph, and of the boxes in those, with their pictures."""
    for box in (x for x in walk(p, frozenset({"Fallback", "del", "moveFrom"})) if local(x) == "txbxContent"):
        for e in _unwrapped(box):
            if local(e) == "p":
                pictures: list[list[str]] = []
                yield "\n".join(_run_texts(e, pictures)), sum(pictures, [])
            elif local(e) == "tbl":
                yield markdown(_docx_rows(e)), _blips(e)


# ---- PPTX

# fixed values: placeholders that are no body text, titles, SmartArt points with text, how a table says what it leaves out
_APART = frozenset({"sldNum", "dt", "ftr", "hdr", "sldImg"})
_TITLES = frozenset({"title", "ctrTitle"})
_NODES = (None, "node", "asst")
_CUT_CATEGORIES, _CUT_SERIES = "항목 categories", "계열 series"


def _shown(e: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """What is below an element, without fallbacks, extensions and fields of numbers and dates."""
    todo = [e]
    while todo:
        e = todo.pop()
        field = (attribute(e, "type") or "") if local(e) == "fld" else ""
        if local(e) not in ("Fallback", "extLst") and field != "slidenum" and not field.startswith("datetime"):
            yield e
            todo += reversed(e)


def _paragraphs(body: ElementTree.Element | None) -> str:
    """A text body's paragraphs on lines, without empty ones."""
    lines = []
    for p in (e for e in (body if body is not None else []) if local(e) == "p"):
        text = "".join(x.text or "" if local(x) == "t" else {"br": "\n", "tab": "\t"}.get(local(x), "") for x in _shown(p))
        if text.strip():
            lines.append(text.rstrip())
    return "\n".join(lines)


def _pptx_table(tbl: ElementTree.Element) -> str:
    """Every place has a cell here; one that continues another is marked."""
    rows: list[list[str]] = []
    width = min(MAX_COLUMNS, sum(local(e) == "gridCol" for e in walk(tbl, frozenset({"tr"}))))
    marked = lambda c, name: attribute(c, name) in ("1", "true")
    for tr in (e for e in tbl if local(e) == "tr"):
        row: list[str] = []
        for c in [e for e in tr if local(e) == "tc"][:MAX_COLUMNS]:
            above = rows[-1][len(row)] if rows and len(row) < len(rows[-1]) else ""
            row.append(above if marked(c, "vMerge") else "" if marked(c, "hMerge") else _paragraphs(child(c, "txBody")))
        rows.append(row + [""] * (width - len(row)))
    return markdown(rows)


def _points(e: ElementTree.Element | None, most: int = CHART_ROWS) -> tuple[list[str], int]:
    """A cache's values by their numbers, up to ``most``, and how many there are."""
    found, total = {}, 0
    for x in walk(e) if e is not None else ():
        number = attribute(x, "val" if local(x) == "ptCount" else "idx") or ""
        if local(x) in ("ptCount", "pt") and number.isdigit():
            total = max(total, int(number) + (local(x) == "pt"))
            if local(x) == "pt" and int(number) < most:
                value = child(x, "v")
                found[int(number)] = "".join(value.itertext()) if value is not None else ""
    return [found.get(i, "") for i in range(max(found, default=-1) + 1)], total


def _categories(axis: ElementTree.Element | None) -> tuple[list[str], int]:
    """Names along the axis. Of several levels the first is the innermost; an outer name stands before its first."""
    levels = next((x for x in walk(axis) if local(x) == "multiLvlStrCache"), None) if axis is not None else None
    if levels is None:
        return _points(axis)
    names = [_points(x)[0] for x in levels if local(x) == "lvl"][::-1]
    width = max(map(len, names), default=0)
    return [" ".join(n[i] for n in names if i < len(n) and n[i].strip()) for i in range(width)], _points(levels)[1]


def chart(root: ElementTree.Element | None) -> str:
    """A chart's title and its series as rows of a table, categories across; a line tells what was left out."""
    if root is None:
        return ""
    series = [s for s in walk(root) if local(s) == "ser"]
    header, rows, total = [], [], 0
    for s in series[:CHART_SERIES]:
        names, n = _categories(next((a for a in (child(s, "cat"), child(s, "xVal")) if a is not None), None))
        values, m = _points(next((a for a in (child(s, "val"), child(s, "yVal")) if a is not None), None))
        header, total = max(header, names, key=len), max(total, n, m)
        literal = child(s, "tx", "v")
        rows.append([literal.text or "" if literal is not None else "".join(_points(child(s, "tx"), 1)[0]), *values])
    made = markdown([["", *header], *rows]) if rows else ""
    cut = [f"{name} {most}/{n}" for name, most, n in ((_CUT_CATEGORIES, CHART_ROWS, total), (_CUT_SERIES, CHART_SERIES, len(series))) if n > most]
    title = _paragraphs(child(root, "chart", "title", "tx", "rich")).strip()
    return "\n\n".join(filter(None, [title, made, f"… ({' · '.join(cut)})" if made and cut else ""]))


def smart_art(root: ElementTree.Element | None) -> str:
    """The points with text, as a list."""
    points = (p for p in (walk(root) if root is not None else ()) if local(p) == "pt" and attribute(p, "type") in _NODES)
    texts = (" ".join(filter(None, map(str.strip, _paragraphs(child(p, "t")).split("\n")))) for p in points)
    return "\n".join(f"- {t}" for t in texts if t)


def _slide(parts: dict[str, bytes], part: str) -> tuple[str, str | None, list[str]]:
    """A slide's text (titles first, then shapes in order, notes quoted at the end), its title and its pictures."""
    rels = relations(parts, part)
    titles, rest, pictures = [], [], []
    related = lambda e, name: parse(parts.get(rels.get(attribute(e, name), ("", ""))[1]))

    def frame(e: ElementTree.Element) -> str:
        for x in walk(e):
            if local(x) == "tbl":
                return _pptx_table(x)
            if local(x) == "chart" and attribute(x, "id") in rels:
                return chart(related(x, "id"))
            if local(x) == "relIds" and attribute(x, "dm") in rels:
                return smart_art(related(x, "dm"))
        return ""

    def shape(e: ElementTree.Element, depth: int) -> None:
        name = local(e)
        if name == "grpSp" and depth >= GROUP_DEPTH:
            rest.extend(_paragraphs(x) for x in _shown(e) if local(x) == "txBody")
        elif name == "grpSp":
            for c in _unwrapped(e):
                shape(c, depth + 1)
        elif name == "pic":
            pictures.extend(attribute(x, "embed") for x in _shown(e) if local(x) == "blip")
        elif name in ("sp", "cxnSp"):
            kind = attribute(child(e, "nvSpPr", "nvPr", "ph"), "type")
            if kind not in _APART:
                pictures.append(attribute(child(e, "spPr", "blipFill", "blip"), "embed"))
                (titles if kind in _TITLES else rest).append(_paragraphs(child(e, "txBody")))
        elif name == "graphicFrame":
            rest.append(frame(e))

    tree = child(parse(parts[part]), "cSld", "spTree")
    for e in _unwrapped(tree) if tree is not None else ():
        shape(e, 0)
    notes = parse(parts.get(next((target for _, target in rels.values() if re.search(r"(?i)(^|/)notesSlides/[^/]+\.xml$", target)), "")))
    bodies = [sp for sp in (walk(notes) if notes is not None else ()) if local(sp) == "sp" and attribute(child(sp, "nvSpPr", "nvPr", "ph"), "type") == "body"]
    quoted = [f"> {line}" for sp in bodies for line in _paragraphs(child(sp, "txBody")).split("\n") if line]
    titles = [t for t in titles if t]
    text = "\n\n".join(x for x in [*titles, *rest, "\n".join(quoted)] if x)
    return text, (titles[0].split("\n")[0].strip() if titles else None), [rels[r][1] for r in pictures if r in rels]


def pptx(parts: dict[str, bytes]) -> Extracted:
    """A slide is a unit, also one that is missing, so that the numbers of the others hold."""
    root, rels = parse(parts.get("ppt/presentation.xml")), relations(parts, "ppt/presentation.xml")
    if root is None:
        raise Damaged("no presentation")
    out, at = Extracted("pptx", "slide"), {}
    order = [e for e in walk(root) if local(e) == "sldId" and any(k.endswith("}id") for k in e.attrib)]
    if len(order) > MAX_PAGES:
        raise Damaged(f"{len(order)} slides, more than {MAX_PAGES}")
    for s in order:
        target = next((rels[v][1] for k, v in s.attrib.items() if k.endswith("}id") and v in rels), None)
        text, title, pictures = _slide(parts, target) if target in parts else ("", None, [])
        at[s.attrib.get("id")] = len(out.units)
        if title:
            out.headings.append((1, title, len(out.units)))
        out.pictures += [(len(out.units), path) for path in pictures]
        out.units.append(text)
    for s in (e for e in walk(root) if local(e) == "section"):
        first = next((at[i.attrib["id"]] for i in walk(s) if local(i) == "sldId" and i.attrib.get("id") in at), None)
        if first is not None:
            out.sections.append((attribute(s, "name") or "", first))
    return out


# ---- PDF: text of simple files; no library for others is at hand


def pdf(data: bytes) -> Extracted:
    """Pages' text from content streams with plain encodings; others give empty pages, as a scan would. Files of more
    than MAX_PAGES pages are refused."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}
    pages = [o for _, o in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", o)]
    out = Extracted("pdf", "page")
    if len(pages) > MAX_PAGES:
        raise Damaged(f"PDF of {len(pages)} pages, more than {MAX_PAGES}")
    for page in pages:
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        text = "\n".join(_pdf_text(objects.get(int(n), b"")) for n in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])) if refs else ""
        out.units.append(text.strip())
    if sum(len(re.sub(r"\s", "", u)) for u in out.units) < LEAST_TEXT:
        raise Damaged("PDF without text")
    return out


_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:\((?:\\.|[^\\()])*\)|[^\]()])*\]\s*TJ|T\*|[-\d.]+\s+[-\d.]+\s+(?:Td|TD)\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _pdf_text(obj: bytes) -> str:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", obj, re.S)
    if not m:
        return ""
    body = m[1]
    if b"/FlateDecode" in obj[: m.start()]:
        try:
            body = inflate(body, wbits=zlib.MAX_WBITS)
        except Damaged:
            return ""
    out = []
    for op in _SHOW.findall(body):
        if op.endswith((b"Td", b"TD", b"T*")):
            if out and out[-1] != "\n" and not op.split()[1:2] == [b"0"]:
                out.append("\n")
            continue
        for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)", op):
            plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else _ESCAPES.get(e[1], e[1]), s)
            out.append(plain.decode("latin-1"))
    return "".join(out)


# ---- choice and frame

_ZIP = (("docx", "word/document.xml", docx), ("pptx", "ppt/presentation.xml", pptx), ("hwpx", "Contents/", hwpx))


def _open_zip(content: bytes) -> Extracted:
    parts = unzip(content, lambda name: not re.search(r"(^|/)media/|(^|/)BinData/", name))
    for kind, mark, run in _ZIP:
        if any(n.startswith(mark) for n in parts):
            made = run(parts, entries(content)) if kind == "hwpx" else run(parts)
            made.load = lambda paths: unzip(content, frozenset(paths).__contains__)
            return made
    raise Damaged("no known document in the archive")


#: Tests and functions in the order in which they are tried; further ones can be put in front.
EXTRACTORS: list[tuple[Callable[[bytes], bool], Callable[[bytes], Extracted]]] = [
    (lambda b: b"%PDF-" in b[:1024], pdf),
    (lambda b: b[:4] == b"PK\3\4", _open_zip),
    (lambda b: b[:8] == bytes.fromhex("D0CF11E0A1B11AE1"), hwp),
]

DOCUMENTS = "path string, kind string, unit_kind string, units array<string>, headings array<struct<level:int,title:string,unit:int>>, sections array<struct<title:string,unit:int>>, images array<struct<unit:int,path:string,kind:string,width:int,height:int,content:binary>>, more_images boolean, error string"


def extracted(files: DataFrame, images: bool = True) -> DataFrame:
    """A row for each file of files (path, content): its document, or the error that stopped it; other files go on.

    images: the pictures kept (see ``collected``); ``more_images`` tells that there were more. PDF files give none.
    """

    names = ["path", "kind", "unit_kind", "units", "headings", "sections", "images", "more_images", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, size = [], 0
            for path, content in zip(frame["path"], frame["content"], strict=True):
                content, made, error = bytes(content or b""), None, None
                try:
                    opener = next((f for test, f in EXTRACTORS if test(content)), None)
                    made = opener(content) if opener else None
                    error = None if made else "unsupported format"
                    pictures, more = collected(made.pictures, made.load) if made and images else ([], False)
                    if made and not pictures and not any(map(str.strip, made.units)):
                        raise Damaged("no text")
                except (ElementTree.ParseError, struct.error, zlib.error, LookupError, ValueError, RecursionError) as e:  # Damaged is a ValueError
                    made, error = None, f"{type(e).__name__}: {e}"
                heads = [{"level": a, "title": b, "unit": c} for a, b, c in made.headings] if made else None
                sections = [{"title": a, "unit": b} for a, b in made.sections] if made else None
                seen = [vars(p) for p in pictures] if made else None
                rows.append((path, made and made.kind, made and made.unit_kind, made and made.units, heads, sections, seen, more if made else None, error))
                size += sum(len(p.content) for p in pictures) if made else 0
                if size > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, DOCUMENTS)


def open_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents under a path."""
    from pageloom.sources.formats import files

    return extracted(files(spark, path))
