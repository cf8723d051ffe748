"""Small office files written from a title, a table and lines, so that a table of texts can be read through the extractors."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

Rows = list[list[str]]


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def docx(title: str | None, rows: Rows, lines: list[str]) -> bytes:
    p = lambda text, props="": f"<w:p>{props}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows)
    head = "" if title is None else p(title, '<w:pPr><w:pStyle w:val="1"/></w:pPr>')
    styles = '<w:styles xmlns:w="w"><w:style w:type="paragraph" w:styleId="1"><w:name w:val="heading 1"/></w:style></w:styles>'
    body = f'<w:document xmlns:w="w"><w:body>{head}<w:tbl>{table}</w:tbl>{"".join(map(p, lines))}</w:body></w:document>'
    return zipped({"word/document.xml": body, "word/styles.xml": styles})


def pptx(title: str | None, rows: Rows, lines: list[str]) -> bytes:
    text = lambda ts: "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in ts)
    shape = lambda kind, ts: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{text(ts)}</p:txBody></p:sp>'
    table = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{text([c])}</a:txBody></a:tc>" for c in row) + "</a:tr>" for row in rows)
    shapes = f'<p:graphicFrame><a:tbl>{table}</a:tbl></p:graphicFrame>{shape("body", lines)}{"" if title is None else shape("title", [title])}'
    relation = '<Relationships><Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/></Relationships>'
    return zipped(
        {
            "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": relation,
            "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>',
        }
    )


def hwpx(title: str | None, rows: Rows, lines: list[str]) -> bytes:
    p = lambda inner, shape=0: f'<p paraPrIDRef="{shape}"><run>{inner}</run></p>'
    t = lambda text: f"<t>{escape(text)}</t>"
    cell = lambda r, c, text: f'<tc><cellAddr rowAddr="{r}" colAddr="{c}"/><subList>{p(t(text))}</subList></tc>'
    table = "".join("<tr>" + "".join(cell(r, c, text) for c, text in enumerate(row)) + "</tr>" for r, row in enumerate(rows))
    body = [*([] if title is None else [p(t(title), 1)]), p(f'<tbl rowCnt="{len(rows)}" colCnt="{len(rows[0])}">{table}</tbl>'), *(p(t(x)) for x in lines)]
    items = '<item id="s" href="Contents/section0.xml"/><item id="h" href="header.xml"/>'
    return zipped(
        {
            "mimetype": "application/hwp+zip",
            "META-INF/container.xml": '<container><rootfile full-path="Contents/content.hpf" media-type="application/hwpml-package+xml"/></container>',
            "Contents/content.hpf": f'<package>{items}<itemref idref="s"/></package>',
            "Contents/header.xml": '<head><paraPr id="0"/><paraPr id="1"><heading type="OUTLINE" level="0"/></paraPr></head>',
            "Contents/section0.xml": f"<sec>{''.join(body)}</sec>",
        }
    )


def hwp(title: str | None, rows: Rows, lines: list[str]) -> bytes:
    def record(tag: int, body: bytes, level: int) -> bytes:
        size = struct.pack("<I", len(body)) if len(body) >= 0xFFF else b""
        return struct.pack("<I", tag | level << 10 | min(len(body), 0xFFF) << 20) + size + body

    def paragraph(text: bytes, level: int = 0, shape: int = 0) -> bytes:
        return record(66, b"\0" * 8 + struct.pack("<H", shape) + b"\0" * 12, level) + record(67, text + b"\r\0", level + 1)

    def deflated(data: bytes) -> bytes:
        d = zlib.compressobj(wbits=-15)
        return d.compress(data) + d.flush()

    u = lambda text: text.encode("utf-16-le")
    cells = b"".join(
        record(72, b"\0" * 8 + struct.pack("<4H", c, r, 1, 1), 2) + paragraph(u(text), 2) for r, row in enumerate(rows) for c, text in enumerate(row)
    )
    table = record(71, b" lbt", 1) + record(77, b"\0" * 4 + struct.pack("<2H", len(rows), len(rows[0])), 2) + cells
    place = struct.pack("<H", 11) + b" lbt" + b"\0" * 8 + struct.pack("<H", 11)
    body = (b"" if title is None else paragraph(u(title), shape=1)) + paragraph(place) + table + b"".join(paragraph(u(x)) for x in lines)
    shapes = record(25, struct.pack("<I", 0), 0) + record(25, struct.pack("<I", 1 << 23), 0)
    header = b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 5 << 24, 1)
    return compound({"FileHeader": header, "DocInfo": deflated(shapes), "BodyText/Section0": deflated(body)})


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams, at most one folder deep and none below another's name; every stream in whole sectors."""
    free, end, table = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        first, parts = len(sectors), [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), end])
        return first

    def entry(name: str, kind: int, right: int, below: int, start: int, size: int) -> bytes:
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, free, right, below) + b"\0" * 36 + struct.pack("<III", start, size, 0)

    folders: dict[str, list[str]] = {}
    for name in streams:
        folders.setdefault(name.rpartition("/")[0], []).append(name)
    # entries: the root, then each folder's members as a chain to the right
    members = [*folders.pop("", []), *folders]
    number = {name: i + 1 for i, name in enumerate([*members, *(n for names in folders.values() for n in names)])}
    entries = [entry("Root Entry", 5, free, 1 if members else free, end, 0)]
    for chain in (members, *folders.values()):
        for i, name in enumerate(chain):
            right = number[chain[i + 1]] if i + 1 < len(chain) else free
            if name in folders:
                entries.append(entry(name, 1, right, number[folders[name][0]], 0, 0))
            else:
                data = streams[name].ljust(4096, b"\0")  # smaller ones would lie in a stream of their own
                entries.append(entry(name.rpartition("/")[2], 2, right, free, put(data), len(data)))
    directory = put(b"".join(entries))
    tables = 1
    while tables * 128 < len(fat) + tables:
        tables += 1
    if tables > 109:
        raise ValueError("more sectors than the header can list")
    first = len(sectors)
    fat += [table] * tables
    numbers = fat + [free] * (tables * 128 - len(fat))
    head = bytes.fromhex("D0CF11E0A1B11AE1").ljust(24, b"\0") + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIII", tables, directory, 0, 4096, end, 0, end, 0)
    head += struct.pack("<109I", *range(first, first + tables), *[free] * (109 - tables))
    return head + b"".join(sectors) + struct.pack(f"<{len(numbers)}I", *numbers)


WRITERS: dict[str, Callable[[str | None, Rows, list[str]], bytes]] = {"docx": docx, "pptx": pptx, "hwpx": hwpx, "hwp": hwp}


def written(texts: DataFrame, kind: str) -> DataFrame:
    """path, content of a file for each row (path, title, table, lines); a null title gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [WRITERS[kind](t, [list(r) for r in rows], list(lines)) for t, rows, lines in zip(f["title"], f["table"], f["lines"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "content": made})

    return texts.select("path", "title", "table", "lines").mapInPandas(run, "path string, content binary")
