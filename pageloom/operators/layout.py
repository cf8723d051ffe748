"""Tables, page text from glyph runs, outlines and heading trees, and math marks."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T

MAX_AXIS, MAX_CELLS = 256, 200_000
OUTLINE_DEPTH, OUTLINE_ITEMS = 4, 500
BLANK_STREAK, BLANK_RATIO, BLANK_COUNT = 3, 0.3, 2


# ---- tables


def table_cell(text: Column) -> Column:
    """A cell's text on one line, backslashes and bars escaped."""
    flat = F.regexp_replace(text, rf"{T.S}*\n{T.S}*", " ")
    return T.trim(F.replace(F.replace(flat, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")))


def placed(cells: DataFrame, key: str) -> DataFrame:
    """key, row, col, text of every place that cells (key, pos, row, col, row_span, col_span, text, rows, cols) cover.

    Of cells that cover one place the first wins; only a cell's left column carries its text. Cells outside the grid
    of rows x cols are left out.
    """
    df = cells.where("row >= 0 and row < rows and col >= 0 and col < cols and rows <= 200000 and cols <= 256")
    last = lambda at, span, n: F.least(F.col(at) + F.greatest(F.col(span), F.lit(1)), F.col(n)) - 1
    df = df.withColumn("_r", F.explode(F.sequence("row", last("row", "row_span", "rows"))))
    df = df.withColumn("_c", F.explode(F.sequence("col", last("col", "col_span", "cols"))))
    text = F.when(F.col("_c") == F.col("col"), F.col("text")).otherwise("")
    return df.groupBy(key, F.col("_r").alias("row"), F.col("_c").alias("col")).agg(F.min_by(text, "pos").alias("text"))


def markdown_table(places: DataFrame, key: str) -> DataFrame:
    """key and table: a Markdown table of the places, ragged rows filled up, the first row as its head."""
    line = F.struct("row", "col", table_cell(F.coalesce("text", F.lit(""))).alias("text"))
    df = places.groupBy(key).agg(F.sort_array(F.collect_list(line)).alias("_cells"), (F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))

    def row(r: Column) -> Column:
        own = F.filter("_cells", lambda c: c["row"] == r)
        texts = F.map_from_entries(F.transform(own, lambda c: F.struct(c["col"], c["text"])))
        cells = F.transform(F.sequence(F.lit(0), F.col("_cols") - 1), lambda c: F.coalesce(F.try_element_at(texts, c), F.lit("")))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    lines = F.transform(F.sequence(F.lit(0), F.col("_rows") - 1), row)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("_cols")), " | "), F.lit(" |"))
    all_ = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.col("_rows") - 1, F.lit(0))))
    return df.select(key, F.array_join(all_, "\n").alias("table"))


def grid_markdown(rows: Column) -> Column:
    """The same from an array of rows, inside one row of the frame; nothing for an empty grid."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    fill = lambda r: F.concat(F.transform(r, table_cell), F.array_repeat(F.lit(""), width - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(fill(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    whole = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when(width == 0, F.lit("")).otherwise(F.array_join(whole, "\n"))


# ---- page text from glyph runs


def page_text(runs: DataFrame, key: str) -> DataFrame:
    """key and text of runs (key, idx, str, x, y, dx, dy, width, size, eol); dx, dy: the unit vector along the line.

    Runs are joined in order. A line break stands where the line before ended or a run lies more than half a letter off
    the line, an empty line where empty runs ended lines between, a space where a gap is over 0.3 letters. A run without
    a place (null x) stands behind a space, and the next run right behind it. A null or zero size is 12, a null width
    half a letter for each character.
    """
    runs = runs.withColumn("size", F.coalesce(F.nullif("size", F.lit(0)), F.lit(12.0)))
    runs = runs.withColumn("width", F.coalesce("width", F.char_length("str") * F.col("size") * 0.5))
    w = Window.partitionBy(key).orderBy("idx")
    df = runs.withColumn("_breaks", F.sum(((F.col("str") == "") & F.col("eol")).cast("int")).over(w)).where("str <> ''")
    before = lambda c: F.lag(c).over(w)
    df = df.withColumns({f"_{c}": before(c) for c in ("x", "y", "dx", "dy", "width", "size", "eol")} | {"_b": before("_breaks")})
    mx, my = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    along, off = mx * F.col("_dx") + my * F.col("_dy"), F.abs(my * F.col("_dx") - mx * F.col("_dy"))
    scale = F.greatest("size", "_size")
    empty = F.col("_breaks") > F.col("_b")
    gap = F.when(F.col("_size").isNull(), "").when(F.col("x").isNull(), F.when(empty & F.col("_x").isNotNull(), "\n\n").otherwise(" ")).when(F.col("_x").isNull(), "").when(empty, "\n\n").when(F.col("_eol") | (off > scale * 0.5), "\n").when(along > F.col("_width") + scale * 0.3, " ").otherwise("")
    parts = F.struct("idx", F.concat(gap, F.col("str")).alias("t"))
    return df.withColumn("_p", parts).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["t"]), "").alias("text"))


# ---- trees as (id, parent_id, level, title, page, doc_name)


def outline(items: DataFrame, roots: str = "parent_id is null") -> DataFrame:
    """The outline's items down to four levels, 500 at most of each document in reading order.

    items: doc_id, id, parent_id, pos, title, page.
    """
    level = items.where(roots).withColumns({"level": F.lit(1), "path": F.array(F.col("pos"))})
    out = level
    for depth in range(2, OUTLINE_DEPTH + 1):
        up = level.select("doc_id", F.col("id").alias("parent_id"), F.col("path").alias("_path"))
        level = items.join(up, ["doc_id", "parent_id"]).withColumns({"level": F.lit(depth), "path": F.array_append("_path", F.col("pos"))}).select(out.columns)
        out = out.union(level)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))
    return out.withColumn("_n", order).where(F.col("_n") <= OUTLINE_ITEMS).drop("_n", "path")


HEADING = rf"(?s)^ {{0,3}}(#{{1,6}}){T.S}+(.+?){T.S}*#*{T.S}*\z"
FENCE = r"^ {0,3}(`{3,}|~{3,})"
# fixed values: inline marks that a title loses
_MARKS = (r"\*\*([^*]+?)\*\*", r"\*(?!\s)([^*\n]*[^*\s])\*", r"__([^_]+?)__", r"`([^`]+?)`", r"~~([^~]+?)~~")


def _title(raw: Column) -> Column:
    bare = F.regexp_replace(raw, T.CITATION, "")
    for mark in _MARKS:
        bare = F.regexp_replace(bare, mark, "$1")
    return T.collapse(bare)


def _marked_lines(lines: Column) -> Column:
    """The lines that are headings or fences: array<struct<at, level, title, fence>>, level 0 for a fence."""
    one = lambda x, i: F.struct(i.alias("at"), F.char_length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.regexp_extract(x, HEADING, 2).alias("title"), F.regexp_extract(x, FENCE, 1).alias("fence"))
    return F.filter(F.transform(lines, one), lambda m: (m["level"] > 0) | (m["fence"] != ""))


def _outside_fences(marked: Column) -> Column:
    """The headings outside code. A fence ends at one of the same kind that is as long; one that never ends is no fence."""

    def step(acc: Column, m: Column) -> Column:
        inside = acc["fence"] != ""
        ends = inside & F.startswith(m["fence"], acc["fence"])
        fence = F.when(ends, F.lit("")).when(inside, acc["fence"]).otherwise(m["fence"])
        return F.struct(fence.alias("fence"), F.when(~inside & (m["level"] > 0), F.array_append(acc["at"], m["at"])).otherwise(acc["at"]).alias("at"))

    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<int>").alias("at"))
    headings = F.filter(marked, lambda m: m["level"] > 0)
    kept = lambda acc: F.when(acc["fence"] != "", F.transform(headings, lambda m: m["at"])).otherwise(acc["at"])
    return T.let(F.aggregate(marked, start, step, kept), lambda at: F.filter(headings, lambda m: F.array_contains(at, m["at"])))


def heading_trees(docs: DataFrame, key: str, markdown: str) -> DataFrame:
    """key, id, parent_id, level, title, page, doc_name of the headings of each Markdown text, ids from 0.

    A node's parent is the last one before it of a lower level. Page and name are of the first citation in the node's
    own section. Rows of one key are trees of their own only if the texts differ.
    """
    df = docs.select(key, F.split(F.coalesce(F.col(markdown), F.lit("")), "\n", -1).alias("_lines"), F.xxhash64(markdown).alias("_row"))
    df = df.withColumn("_heads", T.let(_marked_lines(F.col("_lines")), _outside_fences))
    end = lambda i: F.coalesce(F.get("_heads", i + 1)["at"], F.size("_lines"))
    section = lambda h, i: F.array_join(F.slice("_lines", h["at"] + 1, end(i) - h["at"]), "\n")
    cite = lambda s: F.struct(F.regexp_extract(s, T.CITATION, 2).try_cast("int").alias("page"), T.trim(F.regexp_extract(s, T.CITATION, 1)).alias("name"))
    node = lambda h, i: F.struct(h["level"].alias("level"), h["title"].alias("title"), cite(section(h, i)).alias("cite"))
    df = df.select(key, "_row", F.posexplode(F.transform("_heads", node)).alias("id", "_n")).select(key, "_row", "id", "_n.level", "_n.title", "_n.cite")
    before = Window.partitionBy(key, "_row").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda level: F.last(F.when(F.col("level") == level, F.col("id")), ignorenulls=True).over(before)
    parent = F.greatest(F.lit(None).cast("int"), *[F.when(F.col("level") > level, last(level)) for level in range(1, 6)])
    page = F.when(F.col("cite.page") >= 1, F.col("cite.page"))
    name = F.when(page.isNotNull(), F.nullif(F.col("cite.name"), F.lit("")))
    return df.select(key, "id", parent.alias("parent_id"), "level", _title(F.col("title")).alias("title"), page.alias("page"), name.alias("doc_name"))


# ---- health of text recognition


def ocr_health(pages: DataFrame, key: str, batch: int) -> DataFrame:
    """key, reason: blankStreak after three batches in a row without any text, blankRatio if in the end at least two
    pages and over 0.3 of all are blank, or null. pages: key, page (from 1), text."""
    blank = T.blank(F.col("text"))
    b = pages.withColumn("_batch", F.floor((F.col("page") - 1) / batch)).groupBy(key, "_batch")
    b = b.agg(F.count("*").alias("_n"), F.count_if(blank).alias("_blank"), F.min(blank).alias("_all"))
    w = Window.partitionBy(key).orderBy("_batch")
    streak = F.sum(F.when(F.col("_all"), 0).otherwise(1)).over(w)
    b = b.withColumn("_run", streak)
    runs = F.sum(F.col("_all").cast("int")).over(Window.partitionBy(key, "_run"))
    df = b.withColumn("_streak", runs).groupBy(key).agg(F.max("_streak").alias("_s"), F.sum("_n").alias("_n"), F.sum("_blank").alias("_b"))
    reason = F.when(F.col("_s") >= BLANK_STREAK, "blankStreak").when((F.col("_b") >= BLANK_COUNT) & (F.col("_b") / F.col("_n") > BLANK_RATIO), "blankRatio")
    return df.select(key, F.col("_n").alias("pages"), F.col("_b").alias("blank"), reason.alias("reason"))


def empty_pages(pages: DataFrame, key: str) -> DataFrame:
    """key, empty, total and whether so many are empty that it matters: two or more, and over a tenth."""
    empty = F.count_if(T.blank(F.col("text")))
    df = pages.groupBy(key).agg(empty.alias("empty"), F.count("*").alias("total"))
    return df.withColumn("significant", (F.col("empty") >= 2) & (F.col("empty") / F.col("total") > 0.1))


# ---- math marks

# what is left as it is: fenced blocks to their end or the text's, and code spans, which cross neither a fence nor an empty line
_CODE = re.compile(
    r"(?m:^)[ \t]*(?P<run>`{3,}|~{3,})[^\n]*(?:\n(?![ \t]*(?P=run))[^\n]*)*(?:\n[^\n]*)?"
    r"|(?P<ticks>`+)(?:(?!\n[ \t]*(?:\n|`{3}|~{3}))[\s\S])*?(?P=ticks)"
)
_MARK = re.compile(r"\\(?:\\|([(\[]))")
#: For each opening mark its closing one, and what a formula between them cannot hold.
_KINDS = {"(": (re.compile(r"\\\)"), re.compile(r"[$\n]")), "[": (re.compile(r"\\\]"), re.compile(r"\$|\n[ \t]*\n"))}
_ONLY_CITE = re.compile(T.CITATION + r"\Z")
LONGEST_CITE = 500


def _in_dollars(text: str) -> str:
    """Formulas of a text without code. Places of closing marks and of what ends a formula are looked up in order."""
    places = {kind: [[m.start() for m in p.finditer(text)] for p in patterns] for kind, patterns in _KINDS.items()}

    def following(at: int, those: list[int]) -> int:
        i = bisect_left(those, at)
        return those[i] if i < len(those) else len(text)

    out, done, at = [], 0, 0
    while mark := _MARK.search(text, at):
        at = mark.end()
        if not mark[1]:
            continue  # an escaped backslash
        close, wall = (following(at, those) for those in places[mark[1]])
        if close == len(text) or wall < close or "$" in (text[mark.start() - 1 : mark.start()], text[close + 2 : close + 3]):
            continue
        body = text[at:close]
        if not body.strip() or (len(body) < LONGEST_CITE and _ONLY_CITE.match(f"[{body}]")):
            continue
        out += [text[done : mark.start()], "$$", body, "$$"]
        done = at = close + 2
    return "".join(out) + text[done:]


def math_normalized(markdown: str) -> str:
    r"""\(..\) and \[..\] as $$..$$, but not in code, nor beside a dollar sign, nor around a citation."""
    if "\\(" not in markdown and "\\[" not in markdown:
        return markdown
    out, at = [], 0
    for code in _CODE.finditer(markdown):
        out += [_in_dollars(markdown[at : code.start()]), code[0]]
        at = code.end()
    return "".join(out) + _in_dollars(markdown[at:])


def normalize_math(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else math_normalized(x) for x in texts.to_pylist()], pa.string())

    return run(text)


def strip_math(text: Column) -> Column:
    """Formulas without their marks; citations between such marks keep them."""
    guard = r"(?i)(?!(?:[^\[\]|\n]{1,120}?\s+)?p\.\s*\d+\s*" + "{end})"
    out = text
    for left, right, body in ((r"\\\(", r"\\\)", "(.*?)"), (r"\\\[", r"\\\]", "(.*?)"), (r"\$\$", r"\$\$", "(.+?)")):
        out = F.regexp_replace(out, left + guard.replace("{end}", right) + body + right, "$1")
    return out
