"""Splitting texts and pages: chunks, overlapping chunks with pages, chapters, units of blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as T

UNIT_CHARS = 1800
RANGE_PAGES = 10
MAX_CHAPTERS = 50
#: Documents cut into chunks before these are passed on.
PART = 256


def paragraphs_joined(text: Column, most: Column) -> Column:
    """Paragraphs put together, in order, while they fit into ``most`` characters; longer ones are cut at that length.

    The fold sees lengths only and gives the first and last paragraph of each chunk; texts are joined afterwards.
    """
    lengths = lambda paras: F.transform(paras, lambda p, i: F.struct(F.char_length(p).alias("n"), i.alias("i")))

    def step(acc: Column, p: Column) -> Column:
        over = (acc["len"] > 0) & (acc["len"] + 2 + p["n"] > acc["most"])
        begins = over | (acc["len"] == 0)
        shut = F.when(over, F.array_append(acc["shut"], F.struct(acc["first"].alias("a"), (p["i"] - 1).alias("b")))).otherwise(acc["shut"])
        return F.struct(
            F.when(begins, p["n"]).otherwise(acc["len"] + 2 + p["n"]).alias("len"),
            F.when(begins, p["i"]).otherwise(acc["first"]).alias("first"),
            shut.alias("shut"),
            p["i"].alias("last"),
            acc["most"].alias("most"),
        )

    spans = "array<struct<a:int,b:int>>"
    start = F.struct(F.lit(0).alias("len"), F.lit(0).alias("first"), F.array().cast(spans).alias("shut"), F.lit(0).alias("last"), most.alias("most"))
    bounds = lambda paras: F.aggregate(lengths(paras), start, step, lambda acc: F.array_append(acc["shut"], F.struct(acc["first"].alias("a"), acc["last"].alias("b"))))
    whole = lambda paras, s: T.trim(F.array_join(F.slice(paras, s["a"] + 1, s["b"] - s["a"] + 1), "\n\n"))
    joined = lambda paras: F.filter(F.transform(bounds(paras), lambda s: whole(paras, s)), lambda c: c != "")
    cut = lambda c: F.when(F.char_length(c) > most, T.code_point_pieces(c, most)).otherwise(F.array(c))
    return T.let(F.split(text, "\n\n+", -1), lambda paras: F.flatten(F.transform(joined(paras), cut)))


def chunk_text(text: Column, max_tokens: Column | int = 4000) -> Column:
    """Chunks of about max_tokens tokens: whole paragraphs, cut only where one is longer. A short text stays as it is.

    Null and blank texts have no chunks.
    """
    none = F.array().cast("array<string>")
    most = lambda t: F.greatest(F.lit(100), F.floor(T.lit(max_tokens) * T.chars_per_token(t))).cast("int")
    parts = lambda t: T.let(most(t), lambda m: F.when(F.char_length(t) <= m, F.array(t)).otherwise(paragraphs_joined(t, m)))
    return T.let(text, lambda t: F.when(T.blank(t), none).otherwise(parts(t)))


# fixed value: characters behind which a tail may begin
BOUNDARY = frozenset(" \n\t.!?,。，！？、：；:")


def tail(text: str, want: int) -> str:
    """The last ``want`` characters, shortened to begin behind a boundary in their second half if there is one."""
    if want <= 0 or not text:
        return ""
    if len(text) <= want:
        return text
    start = len(text) - want
    for i in range(start + want // 2, len(text) - 1):
        if text[i] in BOUNDARY:
            return text[i + 1 :]
    return text[start:]


def _chars_per_token(text: str) -> float:
    stride = len(text) // 10
    sample = text if len(text) <= 2000 else "".join(text[i * stride : i * stride + 200] for i in range(10))
    return max(1.5, 4 - 2.5 * len(re.findall(T.CJK, sample)) / max(1, len(sample)))


def _packed(begins: np.ndarray, ends: np.ndarray, limit: int, lead: Callable[[int, int], str]) -> Iterator[tuple[int, int, str]]:
    """(begin, end, lead) of runs of paragraphs that fit into limit with the lead that the run before gives them.

    A run has one paragraph that is not empty at least, however long.
    """
    at, given = 0, ""
    while at < len(begins):
        room = limit - (len(given) + 2 if given else 0)
        fits = int(np.searchsorted(ends, begins[at] + room, "right"))
        filled = int(np.searchsorted(ends, begins[at], "right")) + 1
        stop = min(max(fits, filled, at + 1), len(begins))
        yield int(begins[at]), int(ends[stop - 1]), given
        given = lead(int(begins[at]), int(ends[stop - 1]))
        at = stop


def overlap_spans(text: str, max_tokens: int, ratio: float) -> list[tuple[str, int, int, int]]:
    """Chunks of one text, each with the span of the text that is its own and the length of what it repeats before it.

    Three passes: the offsets of all paragraphs, the runs of paragraphs that fill a chunk, and, for each run, its
    windows of at most the limit. Positions in a chunk are mapped back to the text by one shift.
    """
    size = max(200, int(max_tokens * _chars_per_token(text)))
    overlap = int(size * ratio)
    limit, body = size + overlap, text.strip()
    if not body:
        return []
    if len(text) <= size:
        start = len(text) - len(text.lstrip())
        return [(body, start, start + len(body), 0)]
    gaps = np.array([g.span() for g in re.finditer("\n\n+", text)], np.int64).reshape(-1, 2)
    begins, ends = np.append(0, gaps[:, 1]), np.append(gaps[:, 0], len(text))
    out = []
    for begin, end, lead in _packed(begins, ends, limit, lambda a, b: tail(text[a:b], overlap)):
        raw = f"{lead}\n\n{text[begin:end]}" if lead else text[begin:end]
        chunk = raw.strip()
        if end == begin or not chunk:
            continue
        # place c of the chunk is place c + shift of the text, if that is in the run
        shift = begin + len(raw) - len(raw.lstrip()) - (len(raw) - (end - begin))
        own = max(0, begin - shift)
        place = lambda c, low=begin, by=shift: max(low, c + by)
        for at in range(0, len(chunk), limit):
            stop = min(at + limit, len(chunk))
            again = tail(chunk[at - limit : at], overlap) if at else ""
            first = place(at)
            out.append((again + chunk[at:stop], first, max(first + 1, place(stop)), len(again) if at else min(own, stop)))
    return out


def overlap_chunks(pages: list[str], max_tokens: int = 500, ratio: float = 0.1) -> list[tuple[str, int, int, int]]:
    """(text, page_start, page_end, body_offset) of chunks that repeat the end of the one before.

    Pages are those of the chunk's own part; body_offset is where it begins in the text.
    """
    if not pages:
        return []
    starts = np.cumsum([0, *[len(p) + 2 for p in pages[:-1]]])
    page = lambda at: int(np.searchsorted(starts, at, "right"))
    return [(text, page(a), max(page(a), page(max(a, b - 1))), offset) for text, a, b, offset in overlap_spans("\n\n".join(pages), max_tokens, ratio)]


CHUNKS = "idx int, text string, page_start int, page_end int, body_offset int"


def overlap_chunks_of(docs: DataFrame, key: str = "doc_hash", pages: str = "page_texts", max_tokens: int = 500, ratio: float = 0.1) -> DataFrame:
    """key, idx, text, page_start, page_end, body_offset of all documents' chunks; null pages count as empty."""
    kind = docs.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, PART) for b in batches for k in range(0, b.num_rows, PART)):
            lists = batch.column(1).to_pylist()
            found = [overlap_chunks([p or "" for p in pages or []], max_tokens, ratio) for pages in lists]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            idx = [i for f in found for i in range(len(f))]
            columns = [[c[k] for f in found for c in f] for k in range(4)]
            arrays = [batch.column(0).take(pa.array(owner)), pa.array(idx, pa.int32()), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "idx", "text", "page_start", "page_end", "body_offset"])

    return docs.select(key, pages).mapInArrow(split, f"{key} {kind}, {CHUNKS}")


def page_of_offset(pages: Column, offset: Column) -> Column:
    """The 1-based page on which a character of the joined pages lies (two characters between pages)."""
    step = lambda acc, p: F.struct((acc["at"] + F.char_length(p) + 2).alias("at"), (acc["n"] + (acc["at"] <= offset).cast("int")).alias("n"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    return F.greatest(F.aggregate(pages, start, step, lambda acc: acc["n"]), F.lit(1))


def chapter_starts(pages: Column) -> Column:
    """array<struct<page, title>>: accepted headings, on first lines, not from a table of contents, and moving on."""

    def step(acc: Column, line: Column) -> Column:
        n = acc["n"] + 1
        key, last = T.heading_key(line), acc["last"]
        again = F.coalesce(last["key"] == key["key"], F.lit(False))
        behind = F.coalesce((key["unit"] == last["unit"]) & (key["num"] <= last["num"]), F.lit(False))
        good = F.coalesce(T.is_heading(line), F.lit(False)) & ~again & ~behind
        found = F.array_append(acc["found"], F.struct(n.alias("page"), T.trim(F.left(line, F.lit(80))).alias("title")))
        return F.struct(n.alias("n"), F.when(good, key).otherwise(last).alias("last"), F.when(good, found).otherwise(acc["found"]).alias("found"))

    nothing = F.lit(None).cast("struct<key:string,num:bigint,unit:string>")
    start = F.struct(F.lit(0).alias("n"), nothing.alias("last"), F.array().cast("array<struct<page:int,title:string>>").alias("found"))
    lines = F.transform(pages, lambda p: F.coalesce(T.first_line(p), F.lit("")))
    return F.aggregate(lines, start, step, lambda acc: acc["found"])


CHAPTER = "array<struct<index:int,title:string,start_page:int,end_page:int>>"


def detect_chapters(pages: Column, starts: Column) -> Column:
    """Chapters by their headings (the first one takes what stands before it), or ranges of ten pages.

    ``starts`` is chapter_starts() in a column of its own, so that it is worked out once.
    """
    total = F.size(pages)

    def by_heading(s: Column, i: Column) -> Column:
        first = F.when(i == 0, F.lit(1)).otherwise(s["page"])
        end = F.coalesce(F.get(starts, i + 1)["page"] - 1, total)
        return F.struct((i + 1).alias("index"), s["title"].alias("title"), first.alias("start_page"), end.alias("end_page"))

    def by_range(i: Column) -> Column:
        a, b = i * RANGE_PAGES + 1, F.least((i + 1) * RANGE_PAGES, total)
        title = F.concat(F.lit("Pages "), a.cast("string"), F.lit("-"), b.cast("string"))
        return F.struct((i + 1).alias("index"), title.alias("title"), a.alias("start_page"), b.alias("end_page"))

    ranges = F.transform(F.sequence(F.lit(0), F.floor((total - 1) / RANGE_PAGES).cast("int")), by_range)
    none = F.array().cast(CHAPTER)
    return F.when(total < 1, none).when(F.size(starts) > 0, F.transform(starts, by_heading).cast(CHAPTER)).otherwise(ranges.cast(CHAPTER))


def with_text(chapters: Column, pages: Column) -> Column:
    """Chapters with the text of their pages, empty lines between."""
    add = lambda c: c.withField("text", F.array_join(F.slice(pages, c["start_page"], c["end_page"] - c["start_page"] + 1), "\n\n"))
    return F.transform(chapters, add)


def thin_headings(headings: Column, units: Column) -> Column:
    """Chapter bounds array<struct<title, start>> from headings (level, title, unit), units counted from 0.

    Of the highest level on two units or more; each must move on and have a new title; the first begins the document;
    over 50 are put together in even groups. Empty if no level qualifies.
    """
    clamp = lambda h, last: F.struct(h["level"].alias("level"), T.trim(h["title"]).alias("title"), F.least(F.greatest(h["unit"], F.lit(0)), last).alias("unit"))
    usable = T.let(units - 1, lambda last: F.filter(F.transform(headings, lambda h: clamp(h, last)), lambda h: h["title"] != ""))
    at = lambda own, lv: F.filter(own, lambda h: h["level"] == lv)

    def level(own: Column) -> Column:
        # level and unit pairs, each once: the first level that has two of them
        pairs = F.array_sort(F.array_distinct(F.transform(own, lambda h: F.struct(h["level"], h["unit"]))))
        second = lambda ps: F.filter(ps, lambda p, i: F.coalesce(F.get(ps, i + 1)["level"] == p["level"], F.lit(False)))
        return F.get(T.let(pairs, second), F.lit(0))["level"]

    return T.let(usable, lambda own: T.let(level(own), lambda lv: bounds_of(at(own, lv))))


def bounds_of(candidates: Column) -> Column:
    """Bounds from candidates (title, unit) that stand in order."""
    kind = "array<struct<title:string,start:int>>"

    def step(acc: Column, h: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        back = F.coalesce((h["unit"] <= last["start"]) | (h["title"] == last["title"]), F.lit(False))
        more = F.array_append(acc, F.struct(h["title"].alias("title"), h["unit"].alias("start")))
        return F.when(back | (h["title"] == ""), acc).otherwise(more)

    kept = F.aggregate(candidates, F.array().cast(kind), step)
    first_at_0 = lambda b, i: b.withField("start", F.when(i == 0, F.lit(0)).otherwise(b["start"]))

    def grouped(all_: Column) -> Column:
        size = F.ceil(F.size(all_) / MAX_CHAPTERS).cast("int")

        def group(i: Column) -> Column:
            part = F.slice(all_, i * size + 1, size)
            a, b = F.element_at(part, 1), F.element_at(part, -1)
            title = F.when(F.size(part) == 1, a["title"]).otherwise(F.concat(a["title"], F.lit(" — "), b["title"]))
            return F.struct(title.alias("title"), a["start"].alias("start"))

        groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_) / F.greatest(size, F.lit(1))).cast("int") - 1), group)
        return F.when(F.size(all_) <= MAX_CHAPTERS, all_).otherwise(groups).cast(kind)

    return T.let(F.transform(kept, first_at_0), grouped)


def paginate(blocks: Column, most: int = UNIT_CHARS) -> Column:
    """Struct of units and unit_of_block from blocks array<struct<text, break_before>>, in order.

    A new unit begins at a break or where the next block would overfill it; empty blocks add nothing. The fold sees
    lengths only and gives the blocks that begin a unit; units are sliced afterwards.
    """

    def step(acc: Column, b: Column) -> Column:
        cut = (acc["len"] > 0) & (b["brk"] | ((b["n"] > 0) & (acc["len"] + b["n"] > most)))
        begun = F.when(cut, F.array_append(acc["begun"], b["i"])).otherwise(acc["begun"])
        return F.struct((b["n"] + F.when(cut, 0).otherwise(acc["len"])).alias("len"), begun.alias("begun"))

    def units(texts: Column) -> Column:
        sized = F.transform(F.arrays_zip(texts.alias("t"), blocks.alias("b")), lambda x, i: F.struct(F.char_length(x["t"]).alias("n"), x["b"]["break_before"].alias("brk"), i.alias("i")))
        start = F.struct(F.lit(0).alias("len"), F.array(F.lit(0)).alias("begun"))
        return T.let(F.aggregate(sized, start, step, lambda acc: acc["begun"]), lambda begun: spans(texts, begun))

    def spans(texts: Column, begun: Column) -> Column:
        count = lambda a, k: F.coalesce(F.get(begun, k + 1), F.size(texts)) - a
        unit = lambda a, k: F.array_join(F.filter(F.slice(texts, a + 1, count(a, k)), lambda t: t != ""), "\n\n")
        of = F.flatten(F.transform(begun, lambda a, k: F.array_repeat(k, count(a, k))))
        return F.struct(F.filter(F.transform(begun, unit), lambda u: u != "").alias("units"), of.alias("unit_of_block"))

    return T.let(F.transform(blocks, lambda b: T.trim(b["text"])), units)
