import io
import struct
import zipfile
import zlib

import pytest

from pageloom.sources import extract as X
from pageloom.sources import pictures as I
from pageloom.sources import writers
from pageloom.sources.containers import CompoundFile, Damaged, unzip
from pageloom.sources.units import Cell, grid

W = 'xmlns:w="w"'


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), body)
    return out.getvalue()


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
<w:p><w:r><w:t>seen </w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>A|1</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:p><w:r><w:t>C</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>
<w:p><w:r><w:br w:type="page"/><w:t>Second page</w:t></w:r></w:p></w:body></w:document>"""
STYLES = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="Base"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="H1"><w:basedOn w:val="Base"/></w:style><w:style w:type="paragraph" w:styleId="7"><w:name w:val="heading 2"/><w:pPr><w:pageBreakBefore/></w:pPr></w:style></w:styles>'


def test_docx():
    d = X.docx(unzip(zipped({"word/document.xml": DOCX, "word/styles.xml": STYLES})))
    assert d.units == ["Title\n\nseen\n\n| A\\|1 | B |\n| --- | --- |\n| C | B |", "Second page"]
    assert d.headings == [(1, "Title", 0)]


def paragraphs(*inner):
    return f'<w:document {W} xmlns:mc="mc"><w:body>{"".join(inner)}</w:body></w:document>'


def test_docx_symbols_styles_breaks_and_boxes():
    sym = lambda font, code: f'<w:sym w:font="{font}" w:char="{code}"/>'
    box = lambda text: f"<w:txbxContent><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:txbxContent>"
    body = paragraphs(
        f'<w:p><w:r>{sym("Wingdings", "F0FE")}{sym("Wingdings", "00A8")}{sym("Symbol", "F0B7")}{sym("Webdings", "F0FE")}{sym("Symbol", "x")}<w:t>done</w:t></w:r></w:p>',
        '<w:p><w:pPr><w:pStyle w:val="7"/></w:pPr><w:r><w:t>Named</w:t></w:r></w:p>',
        '<w:p><w:pPr><w:pStyle w:val="제목 3"/><w:pageBreakBefore w:val="off"/></w:pPr><w:r><w:t>Called</w:t></w:r></w:p>',
        '<w:p><w:r><w:t>before</w:t><w:br w:type="page"/><w:t>after</w:t></w:r></w:p>',
        f'<w:p><w:r><mc:AlternateContent><mc:Choice>{box("in a box")}</mc:Choice><mc:Fallback>{box("in a box")}</mc:Fallback></mc:AlternateContent><w:t>host</w:t></w:r></w:p>',
        "<w:sdt><w:sdtContent><w:tbl><w:tr><w:trPr><w:gridBefore w:val='999999999'/></w:trPr><w:sdt><w:sdtContent><w:tc><w:p/></w:tc></w:sdtContent></w:sdt></w:tr></w:tbl></w:sdtContent></w:sdt>",
    )
    d = X.docx({"word/document.xml": body.encode(), "word/styles.xml": STYLES.encode()})
    assert d.units[0] == "☑☐•done" and d.units[1] == "Named\n\nCalled\n\nbefore"
    assert d.units[2] == "after\n\nhost\n\nin a box" and d.units[3].count("---") == 256
    assert d.headings == [(2, "Named", 1), (3, "Called", 1)]
    with pytest.raises(Damaged, match="no text"):
        X.docx({"word/document.xml": paragraphs("<w:p/>").encode()})


def test_pptx():
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda *s: f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{"".join(s)}</p:spTree></p:cSld></p:sld>'
    rel = lambda *r: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="x/{t}" Target="{p}"/>' for i, t, p in r) + "</Relationships>"
    parts = {
        "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst><x:section xmlns:x="x" name="Part"><x:sldId id="257"/></x:section></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rel(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(shape("body", "text"), shape("title", "One")),
        "ppt/slides/slide2.xml": slide(shape("title", "Two")),
        "ppt/slides/_rels/slide1.xml.rels": rel(("n", "notesSlide", "../notesSlides/n1.xml")),
        "ppt/notesSlides/n1.xml": slide(shape("body", "note")),
    }
    d = X.pptx(unzip(zipped(parts)))
    assert d.units == ["Two", "One\n\ntext\n\n> note"] and d.sections == [("Part", 1)] and d.headings == [(1, "Two", 0), (1, "One", 1)]


HWPX_HEADER = '<x xmlns:h="h"><h:paraPr id="1"><h:heading type="OUTLINE" level="0"/></h:paraPr></x>'


def xml(text):
    return X.parse(text.encode())


def test_charts():
    cache = lambda name, values: f'<{name}><ref><cache><ptCount val="{len(values)}"/>' + "".join(f'<pt idx="{i}"><v>{v}</v></pt>' for i, v in enumerate(values) if v is not None) + f"</cache></ref></{name}>"
    ser = lambda name, cats, vals, x="cat", y="val": f"<ser>{name}{cache(x, cats)}{cache(y, vals)}</ser>"
    axis = "<valAx><title><tx><rich><p><r><t>axis</t></r></p></rich></tx></title></valAx>"
    title = "<title><tx><rich><p><r><t>Sales</t></r></p></rich></tx></title>"
    one = xml(f'<cs><chart>{title}<plot>{ser("<tx><v>lit</v></tx>", ["a", "b|"], [1, None, 3])}{ser(cache("tx", ["ref"]), ["a"], [5], "xVal", "yVal")}{axis}</plot></chart></cs>')
    assert X.chart(one) == "Sales\n\n|  | a | b\\| |  |\n| --- | --- | --- | --- |\n| lit | 1 |  | 3 |\n| ref | 5 |  |  |"
    many = xml(f'<cs><chart>{axis}<plot>{"".join(ser("", list(range(60)), list(range(60))) for _ in range(21))}</plot></chart></cs>')
    lines = X.chart(many).split("\n")
    assert lines[0].count("|") == 52 and len(lines) == 24 and lines[-1] == "… (항목 categories 50/60 · 계열 series 20/21)"
    level = lambda *pts: "<lvl>" + "".join(f'<pt idx="{i}"><v>{v}</v></pt>' for i, v in pts) + "</lvl>"
    levels = f'<cat><multiLvlStrCache><ptCount val="4"/>{level((0, "Q1"), (1, "Q2"), (2, "Q1"), (3, "Q2"))}{level((0, "Y1"), (2, "Y2"))}</multiLvlStrCache></cat>'
    assert X.chart(xml(f"<cs><ser>{levels}</ser></cs>")).startswith("|  | Y1 Q1 | Q2 | Y2 Q1 | Q2 |")
    assert X.chart(None) == "" and X.chart(xml("<cs/>")) == ""


def test_smart_art_and_slide_tables():
    t = lambda *ps: "<t>" + "".join(f"<p><r><t>{p}</t></r></p>" for p in ps) + "</t>"
    data = xml(f'<d><pt type="doc">{t("no")}</pt><pt>{t("A", " ", "B ")}</pt><pt type="asst">{t("C")}</pt><pt type="node"/><pt type="parTrans">{t("no")}</pt></d>')
    assert X.smart_art(data) == "- A B\n- C" and X.smart_art(None) == ""
    c = lambda text, mark="": f"<tc {mark}><txBody><p><r><t>{text}</t></r><fld type='slidenum'><t>7</t></fld></p></txBody></tc>"
    table = xml(f'<tbl><tblGrid><gridCol/><gridCol/><gridCol/></tblGrid><tr>{c("a")}{c("b")}</tr><tr><tc vMerge="1"/>{c("x", chr(104) + "Merge=" + chr(34) + "true" + chr(34))}{c("d")}</tr></tbl>')
    assert X._pptx_table(table) == "| a | b |  |\n| --- | --- | --- |\n| a |  | d |"


def test_missing_and_empty_slides(spark):
    rel = '<Relationships><Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/></Relationships>'
    deep = lambda n: "<p:grpSp>" * n + '<p:sp><p:txBody><a:p><a:r><a:t>deep</a:t></a:r></a:p></p:txBody></p:sp>' + "</p:grpSp>" * n
    deck = lambda ids, inner: zipped({"ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rel, "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'})
    ids = '<p:sldId id="1" r:id="r9"/><p:sldId id="2" r:id="r1"/>'
    files = [("a", deck(ids, deep(40))), ("b", deck(ids, "")), ("c", deck(ids * 251, deep(1)))]
    got = {r["path"]: r["units"] or r["error"] for r in X.extracted(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"a": ["", "deep"], "b": "Damaged: no text", "c": "Damaged: 502 slides, more than 500"}


def test_hwpx():
    section = '<h:sec xmlns:h="h"><h:p paraPrIDRef="1"><h:run><h:t>개요</h:t></h:run></h:p><h:p pageBreak="1"><h:run><h:t>본문</h:t><h:equation><h:script>x over  y</h:script></h:equation><h:t>이다</h:t></h:run></h:p></h:sec>'
    d = X.hwpx(unzip(zipped({"Contents/section0.xml": section, "Contents/header.xml": HWPX_HEADER})))
    assert d.units == ["개요", "본문 [수식: x over y] 이다"] and d.headings == [(1, "개요", 0)]


def test_hwpx_tables_and_boxes():
    p = lambda inner: f"<p><run>{inner}</run></p>"
    cell = lambda r, c, inner, rows=1, cols=1: f'<tc><cellAddr rowAddr="{r}" colAddr="{c}"/><cellSpan rowSpan="{rows}" colSpan="{cols}"/><subList>{inner}</subList></tc>'
    inner = f'<tbl rowCnt="1" colCnt="2"><tr>{cell(0, 0, p("<t>i</t>"))}{cell(0, 1, p("<t>j</t>"))}</tr></tbl>'
    table = f'<tbl rowCnt="2" colCnt="3"><tr>{cell(0, 0, p("<t>a</t>"), 2)}{cell(0, 1, p("<t>b</t>"), 1, 2)}</tr><tr>{cell(1, 1, p("<t>c</t>") + p("<t>d</t>"))}{cell(1, 2, p(inner))}</tr></tbl>'
    box = f'<rect><drawText><subList>{p("<t>boxed</t>")}</subList></drawText></rect>'
    section = f'<sec>{p("<t>one</t>" + table + "<t>two<tab/>x</t>" + box + "<ctrl><t>note</t></ctrl>")}</sec>'
    d = X.hwpx({"Contents/section0.xml": section.encode()})
    assert d.units == ["one\n\n| a | b |  |\n| --- | --- | --- |\n| a | c d | i / j |\n\ntwo\tx\n\nboxed"]
    deep = p("<t>core</t>")
    for _ in range(40):
        deep = p(f'<drawText><subList>{deep}</subList></drawText>')
    assert X.hwpx({"Contents/section0.xml": f"<sec>{deep}</sec>".encode()}).units == ["core"]


def test_package():
    container = '<container><rootfiles><rootfile full-path="Preview.txt" media-type="text/plain"/><rootfile full-path="Body/main.hpf" media-type="application/hwpml-package+xml"/></rootfiles></container>'
    main = '<package><manifest><item id="h" href="head/header.xml"/><item id="a" href="section1.xml"/><item id="b" href="Contents/section0.xml"/><item id="c" href="%E0%A4%A"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="x"/></spine></package>'
    text = lambda t: f'<sec><p paraPrIDRef="1"><run><t>{t}</t></run></p></sec>'.encode()
    parts = {"META-INF/container.xml": container.encode(), "Body/main.hpf": main.encode(), "Body/head/header.xml": HWPX_HEADER.encode(), "Body/section1.xml": text("first"), "Contents/section0.xml": text("second")}
    d = X.hwpx(parts)
    assert d.units == ["first", "second"] and d.headings == [(1, "first", 0), (1, "second", 1)]
    broken = parts | {"META-INF/container.xml": b"<broken", "Contents/content.hpf": b"<package/>"}
    assert X.hwpx(broken).units == ["second"]
    with pytest.raises(Damaged, match="encrypted"):
        X.hwpx(parts | {"META-INF/manifest.xml": b"<manifest><file-entry><encryption-data/></file-entry></manifest>"})
    with pytest.raises(Damaged, match="no section"):
        X.hwpx({"Contents/x.xml": b""})


def test_grid():
    rows = lambda *cells, size=(0, 0): grid([Cell(*c) for c in cells], *size)
    assert rows((0, 0, 2, 1, "a"), (0, 1, 1, 2, "b"), (1, 1, 1, 1, "c"), size=(2, 3)) == [["a", "b", ""], ["a", "c", ""]]
    assert rows((0, 0, 1, 1, "kept"), (0, 0, 9, 9, "late")) == [["kept"]]
    assert rows((0, 0, 1, 1, "a"), size=(100_000, 5)) == [["a"]]
    wide = rows((0, 0, 1, 1, "a"), (0, 300, 1, 1, "far"), (0, 299, 1, 1, "off"))
    assert len(wide) == 2 and len(wide[0]) == 256 and wide[1][0] == "off / far"
    assert rows() == [] and rows((-1, 0, 1, 1, "x")) == []


def compound(streams):
    """A compound file with each stream in whole sectors."""
    sectors, fat, entries = [], [], []

    def put(data):
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, max(len(data), 1), 512)]
        for k, part in enumerate(parts):
            sectors.append(part)
            fat.append(first + k + 1 if k + 1 < len(parts) else 0xFFFFFFFE)
        return first

    def entry(name, kind, left, right, child, start, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<III", start, size, 0)

    none = 0xFFFFFFFF
    padded = {n: d.ljust(4096, b"\0") for n, d in streams.items()}
    starts = {n: put(d) for n, d in padded.items()}
    entries.append(entry("Root Entry", 5, none, none, 1, 0xFFFFFFFE, 0))
    entries.append(entry("FileHeader", 2, none, 2, none, starts["FileHeader"], len(padded["FileHeader"])))
    entries.append(entry("BodyText", 1, none, 4, 3, 0, 0))
    entries.append(entry("Section0", 2, none, none, none, starts["BodyText/Section0"], len(streams["BodyText/Section0"]) if len(streams["BodyText/Section0"]) >= 4096 else 4096))
    entries.append(entry("DocInfo", 2, none, none, none, starts["DocInfo"], 4096))
    directory = put(b"".join(entries))
    table = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack("<128I", *[*fat, *[none] * (128 - len(fat))]))
    head = bytes.fromhex("D0CF11E0A1B11AE1").ljust(24, b"\0") + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIII", 1, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", table, *[none] * 108)
    return head.ljust(512, b"\0") + b"".join(sectors)


def record(tag, body, level=0):
    return struct.pack("<I", tag | level << 10 | len(body) << 20) + body


def hwp_file(body, shapes=b"", version=5, flags=1):
    def packed(data):
        deflate = zlib.compressobj(wbits=-15)
        return deflate.compress(data) + deflate.flush()

    header = b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", version << 24, flags)
    return compound({"FileHeader": header, "DocInfo": packed(shapes), "BodyText/Section0": packed(body)})


def hwp_paragraph(text=b"", level=0, shape=0, breaks=0):
    head = record(66, b"\0" * 8 + struct.pack("<HBB", shape, 0, breaks) + b"\0" * 10, level)
    return head + (record(67, text, level + 1) if text else b"")


def place(code, letters):
    """A control character with its letters, eight places long."""
    return struct.pack("<H", code) + letters[::-1] + b"\0" * 8 + struct.pack("<H", code)


def test_hwp():
    text = "가나다\ue000".encode("utf-16-le") + struct.pack("<H", 13)
    outline = record(25, struct.pack("<I", 0)) + record(25, struct.pack("<I", 1 << 23 | 1 << 25))
    body = hwp_paragraph(text, shape=1) + hwp_paragraph("둘".encode("utf-16-le"), breaks=4) + hwp_paragraph("셋".encode("utf-16-le"), breaks=1)
    file = hwp_file(body, outline)
    assert CompoundFile(file).streams.keys() == {"FileHeader", "DocInfo", "BodyText/Section0"}
    d = X.hwp(file)
    assert d.units == ["가나다", "둘", "셋"] and d.headings == [(2, "가나다", 0)]
    for version, flags, message in [(3, 1, "version 3"), (5, 3, "encrypted"), (5, 5, "distribution"), (5, 17, "encrypted")]:
        with pytest.raises(Damaged, match=message):
            X.hwp(hwp_file(body, version=version, flags=flags))
    with pytest.raises(Damaged, match="no text"):
        X.hwp(hwp_file(hwp_paragraph()))
    with pytest.raises(Damaged, match="cut short"):
        X.hwp(hwp_file(hwp_paragraph(place(11, b"tbl ")[:10])))


def test_hwp_controls():
    u = lambda t: t.encode("utf-16-le")
    cell = lambda r, c, text, rows=1, cols=1: record(72, b"\0" * 8 + struct.pack("<4H", c, r, cols, rows), 2) + hwp_paragraph(u(text), 2)
    caption = record(72, b"\0" * 8, 2) + hwp_paragraph(u("caption"), 2)
    table = record(71, b"tbl "[::-1], 1) + caption + record(77, struct.pack("<4H", 0, 0, 2, 2), 2) + cell(0, 0, "a", 2) + cell(0, 1, "b|") + cell(1, 1, "c")
    equation = record(71, b"eqed"[::-1], 1) + record(88, struct.pack("<IH", 0, 5) + u("x^2 y"), 2)
    shape = record(71, b"gso "[::-1], 1) + caption + record(76, b"", 2) + record(72, b"\0" * 8, 3) + hwp_paragraph(u("boxed"), 3)
    note = record(71, b"fn  "[::-1], 1) + record(72, b"\0" * 8, 2) + hwp_paragraph(u("note"), 2)
    text = u("one") + place(11, b"eqed") + u("is") + place(17, b"fn  ") + place(11, b"tbl ") + u("two") + place(9, b"") [:2] + b"\0" * 14 + u("x")
    body = hwp_paragraph(text) + equation + note + table + shape
    expected = "one [수식: x^2 y] is\n\n| a | b\\| |\n| --- | --- |\n| a | c |\n\ntwo\tx\n\nboxed"
    assert X.hwp(hwp_file(body)).units == [expected]
    with pytest.raises(Damaged, match="no table record"):
        X.hwp(hwp_file(hwp_paragraph(place(11, b"tbl ")) + record(71, b"tbl "[::-1], 1)))


def test_pdf_and_frame(spark):
    stream = zlib.compress(b"BT (Hello \\(world\\), this is a page with quite enough letters) Tj 0 -14 Td [(and) -300 (more)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << /Filter /FlateDecode >> stream\n" + stream + b"\nendstream endobj"
    files = [("a.pdf", pdf), ("b.docx", zipped({"word/document.xml": DOCX})), ("c.docx", b"PK\3\4broken"), ("d.txt", b"plain"), ("e", None)]
    got = {r["path"]: r for r in X.extracted(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["a.pdf"]["units"][0].startswith("Hello (world), this is") and "andmore" in got["a.pdf"]["units"][0]
    assert got["b.docx"]["kind"] == "docx" and got["b.docx"]["error"] is None
    assert got["c.docx"]["error"].startswith("Damaged") and got["d.txt"]["error"] == "unsupported format" and got["e"]["error"]


def test_pdf_of_too_many_pages_is_refused():
    stream = b"%d 0 obj << >> stream\nBT (%s) Tj ET\nendstream endobj\n" % (1, b"enough letters " * 5)
    pdf = lambda n: b"%PDF-1.4\n" + stream + b"".join(b"%d 0 obj << /Type /Page /Contents 1 0 R >> endobj\n" % i for i in range(2, n + 2))
    assert len(X.pdf(pdf(500)).units) == 500
    with pytest.raises(Damaged, match="501 pages"):
        X.pdf(pdf(501))


def test_limits():
    with pytest.raises(Damaged):
        unzip(b"PK\3\4")
    with pytest.raises(Damaged):
        CompoundFile(b"x" * 600)
    with pytest.raises(Damaged, match="document type"):
        X.docx({"word/document.xml": b"<!DOCTYPE x><x/>"})


def png(width, height, tail=b""):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + tail


def jpeg(width, height, marker=0xC2):
    segments = b"\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xff\xc4" + struct.pack(">H", 2) + b"\xff\xd0"
    return b"\xff\xd8" + segments + bytes([0xFF, marker]) + struct.pack(">HBHH", 11, 8, height, width) + b"\0" * 6


def test_picture_headers():
    bmp = lambda w, h, size=40: b"BM" + b"\0" * 12 + struct.pack("<Iii", size, w, h)
    assert I.probe(png(7, 9)) == ("png", 7, 9) and I.probe(png(7, 9)[:23]) is None and I.probe(png(7, 9).replace(b"IHDR", b"IDAT")) is None
    assert I.probe(jpeg(640, 480)) == ("jpeg", 640, 480) and I.probe(jpeg(640, 480, 0xDA)) is None and I.probe(jpeg(640, 480)[:-8]) is None
    assert I.probe(bmp(5, -6)) == ("bmp", 5, 6) and I.probe(bmp(5, 6, 12)) is None
    assert I.probe(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("gif", 3, 4) and I.probe(b"GIF80a" + b"\0" * 9) is None
    assert I.probe(b"") is None and I.probe(b"\xff\xd8\xff\xe0\0\0") is None
    assert I.fitted("png", 1024, 10) is None and I.fitted("jpeg", 4096, 3) == (1024, 1) and I.fitted("gif", 60, 70) == (60, 70) and I.fitted("png", 1500, 2001) == (768, 1024)


def test_pictures_kept():
    files = {f"p{i}": png(50, 50) for i in range(60)} | {"small": png(49, 900), "huge": png(4000, 1001), "text": b"text"}
    load = lambda paths: {p: files[p] for p in paths if p in files}
    kept, more = I.collected([(0, "small"), (0, "huge"), (1, "text"), (1, "gone"), (2, "p0"), (3, "p0"), (3, "p1")], load)
    assert [(p.unit, p.path) for p in kept] == [(2, "p0"), (3, "p1")] and not more
    kept, more = I.collected([(i, f"p{i}") for i in range(60)], load)
    assert len(kept) == 50 and more
    assert I.collected([(0, "p0")] * 500, load)[1] is False and I.collected([(0, f"q{i}") for i in range(401)], load) == ([], True)


def test_pictures_of_each_format(spark):
    rel = lambda *r: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="x/{t}" Target="{p}"/>' for i, t, p in r) + "</Relationships>"
    blip = lambda r: f'<w:r><w:drawing><a:blip r:embed="{r}"/></w:drawing></w:r>'
    document = f'<w:document {W} xmlns:a="a" xmlns:r="r"><w:body><w:p><w:r><w:t>one</w:t><w:br w:type="page"/><w:t>two</w:t></w:r>{blip("a")}</w:p><w:tbl><w:tr><w:tc><w:p>{blip("b")}</w:p></w:tc></w:tr></w:tbl><w:p>{blip("a")}{blip("none")}</w:p></w:body></w:document>'
    docx = zipped({"word/document.xml": document, "word/_rels/document.xml.rels": rel(("a", "image", "media/1.png"), ("b", "image", "media/2.jpg")), "word/media/1.png": png(60, 61), "word/media/2.jpg": jpeg(70, 71)})

    slide = '<p:sld xmlns:p="p" xmlns:a="a" xmlns:r="r"><p:cSld><p:spTree><p:sp><p:spPr><a:blipFill><a:blip r:embed="f"/></a:blipFill></p:spPr><p:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></p:txBody></p:sp><p:grpSp><p:pic><a:blip r:embed="g"/></p:pic></p:grpSp></p:spTree></p:cSld></p:sld>'
    pptx = zipped({
        "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rel(("r1", "slide", "slides/slide1.xml")), "ppt/slides/slide1.xml": slide,
        "ppt/slides/_rels/slide1.xml.rels": rel(("f", "image", "../media/f.png"), ("g", "image", "../media/g.png")), "ppt/media/f.png": png(80, 81), "ppt/media/g.png": png(90, 91),
    })

    pic = lambda ref: f'<pic><img binaryItemIDRef="{ref}"/></pic>'
    cell = f'<tbl rowCnt="1" colCnt="1"><tr><tc><cellAddr rowAddr="0" colAddr="0"/><subList><p><run><t>c</t>{pic("image2")}</run></p></subList></tc></tr></tbl>'
    box = f'<rect><drawText><subList><p><run>{pic("image3")}</run></p></subList></drawText></rect>'
    section = f'<sec><p><run>{pic("image1")}<t>one</t></run></p><p pageBreak="1"><run>{cell}{box}</run></p></sec>'
    hwpx = zipped({"Contents/content.hpf": '<package><item id="image1" href="BinData/first.png"/></package>', "Contents/section0.xml": section, "BinData/first.png": png(51, 52), "BinData/image2.png": png(53, 54), "BinData/Image3.PNG": png(55, 56)})

    gso = record(71, b" osg", 1) + record(76, b"", 2) + record(85, b"\0" * 71 + struct.pack("<H", 1), 3) + record(85, b"\0" * 71 + struct.pack("<H", 2), 3) + record(85, b"\0" * 71 + struct.pack("<H", 9), 3)
    binary = lambda mode, n, ext: record(18, struct.pack("<3H", 1 | mode << 4, n, len(ext)) + ext.encode("utf-16-le"))
    packed = lambda data: (d := zlib.compressobj(wbits=-15)).compress(data) + d.flush()
    streams = {
        "FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 5 << 24, 1),
        "DocInfo": packed(binary(0, 1, "png") + binary(2, 10, "PNG")),
        "BodyText/Section0": packed(hwp_paragraph("하나".encode("utf-16-le")) + hwp_paragraph("둘".encode("utf-16-le"), breaks=4) + gso),
        "BinData/BIN0001.png": packed(png(57, 58)), "BinData/BIN000A.png": png(59, 60),
    }
    files = [("a.docx", docx), ("b.pptx", pptx), ("c.hwpx", hwpx), ("d.hwp", writers.compound(streams)), ("e.pdf", b"%PDF-")]
    df = X.extracted(spark.createDataFrame(files, "path string, content binary"))
    got = {r["path"]: [(i["unit"], i["kind"], i["width"], i["height"]) for i in r["images"]] if r["images"] is not None else r["error"] for r in df.collect()}
    assert got["a.docx"] == [(1, "png", 60, 61), (1, "jpeg", 70, 71)] and got["b.pptx"] == [(0, "png", 80, 81), (0, "png", 90, 91)]
    assert got["c.hwpx"] == [(0, "png", 51, 52), (1, "png", 53, 54), (1, "png", 55, 56)] and got["d.hwp"] == [(1, "png", 57, 58), (1, "png", 59, 60)]
    assert "without text" in got["e.pdf"]
    assert all(not r["images"] for r in X.extracted(spark.createDataFrame(files, "path string, content binary"), images=False).collect())


def test_many_sectors():
    streams = {"FileHeader": b"x", "BodyText/Section0": bytes(range(256)) * 4000, "A": b"y" * 5000}
    file = CompoundFile(writers.compound(streams))
    assert {n: file.read(n)[: len(d)] for n, d in streams.items()} == streams
