"""Text functions as column expressions.

Lengths and offsets are in code points. White space is Unicode's, as in ``(?U)\\s``. All patterns have bounded repeats,
so that no input makes them backtrack for long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

S = r"(?U:\s)"

# ---- fixed values: patterns, word lists and limits that results depend on
CITATION = r"(?i)\[(?:([^\[\]|\n]{1,120}?)\s+)?p\.\s*(\d+)(?:\s*\|\s*[^\]\n]{0,200})?\s*\]"
BARE_CITATION = r"(?i)\[p\.\s*(\d+)(?:\s*\|\s*[^\]\n]{0,200})?\s*\]"
BRACKETED_CITATION = r"(?i)\(\s*(\[p\.\s*\d+(?:\s*\|\s*[^\]]*?)?\s*\])\s*\)"
PARTIAL_CITATION = r"\[[^\]\n]{0,130}$"
LABEL_MAX = 110
PROMPT_MARKS = ("질문", "이전 대화", "요약 내용", "원문 관련 부분")
STOPWORDS = (
    "은 는 이 가 을 를 의 에 에서 로 으로 과 와 도 만 부터 까지 보다 처럼 같은 "
    "그 저 이것 그것 저것 것 수 등 및 하다 되다 있다 없다 않다 대해 대한 통해 "
    "the a an is are was were in on at to for of with by from as and or not "
    "that this it be has have had do does what which how why when where who"
).split()
CJK = "[\uac00-\ud7af\u3130-\u318f\u1100-\u11ff\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fff]"
CJK_AFTER_STOP = "[가-힯぀-ヿ一-鿿]"
MIN_SENTENCE, MAX_SENTENCES = 15, 100
SNIPPET_RADIUS, SNIPPET_MAX = 50, 180
LABELED_MAX = 1500
CONVERSATIONAL = (
    r"도움이\s*되[길었]?\s*(바랍|되었|되셨)",
    r"궁금한\s*(점|사항|것|내용)이?\s*(있으시면|있으면)",
    r"추가(로|적인)?\s*(궁금|질문|문의)",
    r"언제든지?\s*(물어|말씀|문의|연락)",
    r"말씀해\s*주세요",
    r"필요하시면\s*(언제|말씀|연락)",
    r"자세한\s*정보가?\s*필요하시면",
    r"요약해\s*드리겠습니다",
    r"설명해\s*드리겠습니다",
    r"정리해\s*드리겠습니다",
    r"알려\s*드리겠습니다",
    r"다루고\s*있습니다\s*[:：]\s*$",
    r"^주요\s*내용을?\s*요약\s*[:：]?\s*$",
    r"이상으로\s*.*(마치|끝|정리)",
    r"좋은\s*자료입니다",
    r"잘\s*정리되어",
    r"강점을\s*잘\s*보여",
    r"도움이\s*되(었으면|길)\s*좋겠",
    r"(?i)^(I\s+)?hope\s+this\s+helps",
    r"(?i)feel\s+free\s+to\s+ask",
    r"(?i)let\s+me\s+know\s+if\s+you",
    r"(?i)if\s+you\s+have\s+any\s+(other\s+)?questions",
    r"(?i)I['’]d\s+be\s+happy\s+to\s+help",
    r"(?i)here['’]?s?\s+(a\s+)?summary\s+of",
    r"(?i)in\s+conclusion\s*[,.:]",
    r"(?i)to\s+summarize\s*[,.:]",
    r"お役に立てれば",
    r"ご質問があれば",
    r"^以上(です|になります|となります)",
    r"お気軽にお聞き",
    r"^.{0,12}要約(いた)?します[。：:]?\s*$",
    r"希望(对你|这)有(所)?帮助",
    r"如有(任何)?疑问",
    r"^以上(就是|是|为)",
    r"总结如下\s*[：:]?\s*$",
)
CHAPTER_HEADING = r"(?i)^(제?\d+[장절]|chapter\s*\d+|\d+장)"
TOC_LINE = r"[.·…]{2,}\s*\d+\s*$|\s{3,}\d+\s*$"
CONTEXT_BUCKETS = (4096, 8192, 12288, 16384)
OUTPUT_RESERVE = 2048
# ---- end of fixed values


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


#: All characters that S matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{S}+", " "))


def blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return ~F.coalesce(c, F.lit("")).rlike("(?U)\\S")


def split_literal(c: Column, sep: str) -> Column:
    return F.split(c, r"\Q" + sep + r"\E")


def occurrences(haystack: Column, needle: Column) -> Column:
    """How often needle stands in haystack, without overlap; 0 for an empty needle."""
    n = F.char_length(needle)
    times = (F.char_length(haystack) - F.char_length(F.replace(haystack, needle, F.lit("")))) / F.nullif(n, F.lit(0))
    return F.coalesce(times, F.lit(0)).cast("long")


# ---- prompts and keywords


def sanitize_prompt(c: Column) -> Column:
    """Lines that could pass for separators or section marks of a prompt are escaped."""
    out = F.regexp_replace(c, r"(?m)^\s*---\s*$", r"\\-\\-\\-")
    for mark in PROMPT_MARKS:
        out = F.regexp_replace(out, rf"(?m)^\s*\[{mark}\]", rf"\\[{mark}\\]")
    return out


def keywords(question: Column) -> Column:
    """Words of two or more characters, lower-case, stop words left out; repeats stay."""
    bare = F.regexp_replace(question, r"[?？!！.,;:'\"()\[\]{}]", " ")
    words = F.transform(F.split(bare, f"{S}+"), lambda w: F.lower(w))
    return F.filter(words, lambda w: (F.char_length(w) >= 2) & ~w.isin(*STOPWORDS))


def keyword_count(lower_text: Column, keyword: Column) -> Column:
    """ASCII keywords count as whole words, all others as substrings.

    Only ASCII letters, digits and the underscore make a word here; what \\b takes for one depends on Java's version.
    """
    whole = F.size(F.regexp_extract_all(lower_text, F.concat(F.lit("(?<![A-Za-z0-9_])"), keyword, F.lit("(?![A-Za-z0-9_])")), F.lit(0)))
    return F.when(keyword.rlike("^[a-z0-9]+$"), whole.cast("long")).otherwise(occurrences(lower_text, keyword))


def keyword_score(chunk: Column, words: Column) -> Column:
    """All keywords' counts in a chunk, citations not counted."""
    total = lambda low: F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + keyword_count(low, w))
    return let(F.lower(strip_citations(chunk)), total)


def sentences(answer: Column) -> Column:
    """Sentences of 15 characters or more, citations removed, at most 100 of them."""
    text = collapse(strip_citations(answer))
    ends = rf"(?<=[.!?])\s+(?=\S)|(?<=[.!?])(?={CJK_AFTER_STOP})|(?<=[。！？])\s*(?=\S)"
    parts = F.transform(F.split(text, ends), trim)
    return F.slice(F.filter(parts, lambda s: F.char_length(s) >= MIN_SENTENCE), 1, MAX_SENTENCES)


# ---- citations


def doc_label(file_name: Column) -> Column:
    """A file name in the form that a citation can carry."""
    flat = trim(F.regexp_replace(F.regexp_replace(file_name, r"[\[\]|\n]", " "), f"{S}+", " "))
    return trim(F.left(flat, F.lit(LABEL_MAX)))


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(c, CITATION, "")


def strip_bare_citations(c: Column) -> Column:
    return F.regexp_replace(c, BARE_CITATION, "")


def qualify_citations(c: Column, file_name: Column) -> Column:
    """[p.N] becomes [name p.N]; citations that have a name keep it."""
    label = doc_label(file_name)
    # a name is literal text in the replacement
    quoted = F.regexp_replace(label, r"([\\$])", r"\\$1")
    named = F.regexp_replace(c, F.lit(BARE_CITATION), F.concat(F.lit("["), quoted, F.lit(" p.$1]")))
    return F.when(label == "", c).otherwise(named)


def strip_partial_citation(c: Column) -> Column:
    return F.regexp_replace(c, PARTIAL_CITATION, "")


def parse_citations(c: Column) -> Column:
    """array<struct<type, content, page, doc_name, raw>>: texts and citations in order; page 0 stays text."""
    parts = F.arrays_zip(
        F.split(c, CITATION, -1).alias("gap"),
        F.regexp_extract_all(c, F.lit(CITATION), F.lit(0)).alias("raw"),
        F.regexp_extract_all(c, F.lit(CITATION), F.lit(1)).alias("doc"),
        F.regexp_extract_all(c, F.lit(CITATION), F.lit(2)).alias("page"),
    )
    none = lambda kind: F.lit(None).cast(kind)

    def text(x: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), x.alias("content"), none("long").alias("page"), none("string").alias("doc_name"), none("string").alias("raw"))

    def one(x: Column) -> Column:
        page = x["page"].try_cast("long")
        name = F.nullif(trim(x["doc"]), F.lit(""))
        cited = F.struct(F.lit("citation").alias("type"), none("string").alias("content"), page.alias("page"), name.alias("doc_name"), x["raw"].alias("raw"))
        second = F.when(x["raw"].isNull(), F.lit(None)).when(page >= 1, cited).otherwise(text(x["raw"]))
        return F.array(F.when(x["gap"] != "", text(x["gap"])), second)

    found = F.filter(F.flatten(F.transform(parts, one)), lambda s: s.isNotNull())
    return F.when(F.coalesce(c, F.lit("")) == "", F.slice(found, 1, 0)).otherwise(found)


def normalize_placement(c: Column) -> Column:
    """Citations in brackets are freed, and lines of nothing but citations move to the end of the last written line."""
    lines = F.split(F.regexp_replace(c, BRACKETED_CITATION, "$1"), "\n", -1)

    def lone(line: Column) -> Column:
        body = F.regexp_replace(line, r"^[\s\-*•]+", "")
        rest = F.regexp_replace(body, CITATION, "\u0000")
        return (rest != body) & rest.rlike("^[\\u0000\\s.,]*$")

    # lone lines are moved to the last line before them that is neither lone nor blank, if there is one
    kind = lambda line, i: F.struct(i.alias("i"), lone(line).alias("lone"), blank(line).alias("blank"), F.array_join(F.regexp_extract_all(line, F.lit(CITATION), F.lit(0)), "").alias("cites"))

    def step(acc: Column, x: Column) -> Column:
        at, moves = acc["at"], x["lone"] & (acc["at"] >= 0)
        more = F.array_append(acc["moved"], F.struct(at.alias("to"), x["i"].alias("from"), x["cites"].alias("cites")))
        empty = F.when(x["lone"], x["cites"] == "").otherwise(x["blank"])
        return F.struct(F.when(moves | empty, at).otherwise(x["i"]).alias("at"), F.when(moves, more).otherwise(acc["moved"]).alias("moved"))

    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<to:int,from:int,cites:string>>").alias("moved"))

    def placed(own: Column, moved: Column) -> Column:
        # the texts that go to a line, in order, as one map entry of it
        to = F.array_distinct(F.transform(moved, lambda m: m["to"]))
        texts = F.map_from_arrays(to, F.transform(to, lambda i: F.array_join(F.transform(F.filter(moved, lambda m: m["to"] == i), lambda m: m["cites"]), "")))
        gone = F.map_from_arrays(F.transform(moved, lambda m: m["from"]), F.transform(moved, lambda m: F.lit(True)))

        def line(x: Column, i: Column) -> Column:
            add = F.try_element_at(texts, i)
            body = F.when(lone(x), F.array_join(F.regexp_extract_all(x, F.lit(CITATION), F.lit(0)), "")).otherwise(x)
            stop = F.regexp_extract(body, r"[.!?。！？]\s*$", 0)
            joined = F.concat(F.left(body, F.char_length(body) - F.char_length(stop)), add, stop)
            return F.when(F.map_contains_key(gone, i), F.lit(None)).when(add.isNull(), body).otherwise(joined)

        return F.array_join(F.filter(F.transform(own, line), lambda x: x.isNotNull()), "\n")

    return let(lines, lambda own: let(F.aggregate(F.transform(own, kind), start, step, lambda acc: acc["moved"]), lambda moved: placed(own, moved)))


def page_label(page: Column) -> Column:
    """[p.N], or nothing without a page."""
    return F.when(page >= 1, F.concat(F.lit("[p."), F.floor(page).cast("string"), F.lit("]"))).otherwise("")


# fixed values: names of units and how they are written
UNIT_LABELS = {"page": "p.{n}", "slide": "slide {n}", "chapter": "ch. {n}"}
UNIT_COUNTS = {"page": "{n} pages", "slide": "{n} slides", "chapter": "{n} chapters"}


def unit_label(n: Column, kind: Column, forms: dict[str, str] = UNIT_LABELS) -> Column:
    """A unit's number as shown; unknown or absent kinds are pages, and without a number there is no label."""
    own = reduce(lambda acc, k: F.when(kind == k, F.lit(forms[k])).otherwise(acc), ("slide", "chapter"), F.lit(forms["page"]))
    return F.when(n.isNull(), F.lit("")).otherwise(F.replace(own, F.lit("{n}"), n.cast("string")))


def clamp_page(page: Column, last: Column) -> Column:
    return F.when(page.between(1, last), F.floor(page))


def labeled_segment(text: Column, label: Column, body_offset: Column) -> Column:
    """The label over the chunk's own text, without what it repeats of the chunk before; no label leaves all."""
    cut = F.greatest(F.coalesce(body_offset, F.lit(0)), F.lit(0))
    return F.when(label == "", text).otherwise(F.concat(label, F.lit("\n"), F.substring(text, cut + 1, F.char_length(text))))


# ---- pages


def long_paragraph(para: Column, most: int = LABELED_MAX) -> Column:
    """Pieces of at most ``most`` characters: whole lines while they fit, longer lines cut."""

    def step(acc: Column, line: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        closed = F.when(cur == "", out).otherwise(F.array_append(out, cur))
        joined = F.when(cur == "", line).otherwise(F.concat(cur, F.lit("\n"), line))
        too_long, over = F.char_length(line) > most, F.char_length(joined) > most
        new_out = F.when(too_long, F.concat(closed, code_point_pieces(line, most))).when(over, closed).otherwise(out)
        new_cur = F.when(too_long, F.lit("")).when(over, line).otherwise(joined)
        return F.struct(new_out.alias("out"), new_cur.alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    pieces = F.aggregate(F.split(para, "\n", -1), start, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])))
    return F.when(F.char_length(para) <= most, F.array(para)).otherwise(pieces)


def code_point_pieces(c: Column, size) -> Column:
    """The text in pieces of ``size`` characters; one empty piece for an empty text."""
    size = lit(size).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1)), size)
    return F.transform(starts, lambda i: F.substring(c, i, size))


def label_paragraphs(pages: Column, first: Column | int = 0) -> Column:
    """All paragraphs of all pages, each after its page's label (``first`` pages lie before), long ones in labelled pieces."""

    def page(text: Column, i: Column) -> Column:
        paras = F.filter(F.transform(F.split(text, "\n\n+"), trim), lambda p: p != "")
        label = F.concat(F.lit("[p."), (i + 1 + first).cast("string"), F.lit("] "))
        return F.transform(F.flatten(F.transform(paras, lambda p: long_paragraph(p))), lambda p: F.concat(label, p))

    return F.array_join(F.flatten(F.transform(pages, lambda t, i: page(F.coalesce(t, F.lit("")), i))), "\n\n")


def page_range(pages: Column, start: Column, end: Column) -> Column:
    """Struct of the clamped range's pages (others empty, so numbers stay) and their text."""
    total = F.size(pages)
    a, b = (F.greatest(F.lit(1), F.least(F.floor(x).cast("int"), total)) for x in (start, end))
    lo, hi = F.least(a, b), F.greatest(a, b)
    masked = F.transform(pages, lambda t, i: F.when((i + 1).between(lo, hi), t).otherwise(""))
    text = F.array_join(F.filter(masked, lambda t: ~blank(t)), "\n\n")
    return F.struct(masked.alias("pages"), text.alias("text"), lo.alias("start"), hi.alias("end"))


# ---- snippets


def keyword_snippet(text: Column, query: Column) -> Column:
    """50 characters to either side of the first match, on one line; null without a match. query is lower-case."""
    at = F.position(query, F.lower(text))
    start = F.greatest(at - 1 - SNIPPET_RADIUS, F.lit(0))
    end = F.least(F.char_length(text), at - 1 + F.char_length(query) + SNIPPET_RADIUS)
    cut = collapse(F.substring(text, start + 1, end - start))
    whole = F.concat(F.when(start > 0, F.lit("…")).otherwise(""), cut, F.when(end < F.char_length(text), F.lit("…")).otherwise(""))
    return F.when(at > 0, whole)


def semantic_snippet(text: Column) -> Column:
    """One line of at most 180 characters, no half citation at its end."""
    flat = collapse(text)
    cut = F.concat(F.regexp_replace(strip_partial_citation(F.left(flat, F.lit(SNIPPET_MAX))), f"{S}+$", ""), F.lit("…"))
    return F.when(F.char_length(flat) <= SNIPPET_MAX, flat).otherwise(cut)


def highlight(text: Column, query: Column, mark: str = "**") -> Column:
    """Every match of query, in any case, between marks."""
    safe = F.concat(F.lit(r"(?i)\Q"), F.replace(query, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(query == "", text).otherwise(F.regexp_replace(text, safe, F.lit(f"{mark}$0{mark}")))


# ---- summaries


def strip_conversational(c: Column) -> Column:
    """Lines of small talk go, unless they hold a citation; runs of empty lines shrink to one."""
    line_of = lambda x: F.coalesce(trim(x), F.lit(""))

    def keep(line: Column) -> Column:
        t = line_of(line)
        talk = reduce(lambda a, b: a | b, [t.rlike(p) for p in CONVERSATIONAL])
        return (t == "") | t.rlike(CITATION) | ~talk

    kept = F.array_join(F.filter(F.split(c, "\n", -1), keep), "\n")
    return trim(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def ocr_text(c: Column, most: int = 12000) -> Column:
    """Links removed, and no longer than most characters."""
    bare = trim(F.regexp_replace(c, r"https?://\S+", ""))
    return F.when(F.char_length(bare) > most, F.concat(F.left(bare, F.lit(most)), F.lit("[...]"))).otherwise(bare)


def vision_text(c: Column, most: int = 500) -> Column:
    """A picture's description without code blocks and links."""
    bare = F.regexp_replace(F.regexp_replace(c, "(?s)```.*?```", ""), r"https?://\S+", "")
    return trim(F.left(trim(bare), F.lit(most)))


def image_mime(base64: Column) -> Column:
    # fixed values: first letters of base64-encoded image headers
    kinds = (("/9j/", "image/jpeg"), ("R0lGOD", "image/gif"), ("UklGR", "image/webp"))
    return reduce(lambda acc, k: F.when(base64.startswith(k[0]), k[1]).otherwise(acc), kinds, F.lit("image/png"))


# ---- headings


def first_line(page: Column) -> Column:
    return F.get(F.split(trim(page), "\n"), F.lit(0))


def is_heading(line: Column) -> Column:
    return line.rlike(CHAPTER_HEADING) & ~line.rlike(TOC_LINE)


def heading_key(line: Column) -> Column:
    """Struct of what tells headings apart: key, num and unit (null for a heading without number)."""
    key = F.lower(trim(F.regexp_replace(F.regexp_replace(line, f"{S}+", " "), r"[.·:;,\-–—]+$", "")))
    ko, en = r"^제?\s*(\d+)\s*([장절])", r"(?i)^chapter\s*(\d+)"
    number = F.coalesce(F.nullif(F.regexp_extract(line, ko, 1), F.lit("")), F.nullif(F.regexp_extract(line, en, 1), F.lit("")))
    unit = F.when(line.rlike(ko), F.regexp_extract(line, ko, 2)).when(line.rlike(en), F.lit("chapter"))
    return F.struct(key.alias("key"), number.try_cast("long").alias("num"), unit.alias("unit"))


# ---- sizes


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK))


def chars_per_token(c: Column) -> Column:
    """4 for text without Korean, Chinese or Japanese letters down to 1.5, by 10 even samples of 200 characters."""
    n = F.char_length(c)
    stride = F.floor(n / 10).cast("int")
    even = F.concat(*[F.substring(c, stride * i + 1, F.lit(200)) for i in range(10)])
    sample = F.when(n <= 2000, c).otherwise(even)
    return F.greatest(F.lit(1.5), 4 - 2.5 * cjk_count(sample) / F.greatest(F.char_length(sample), F.lit(1)))


def token_estimate(c: Column) -> Column:
    cjk = cjk_count(c)
    return F.ceil(cjk / F.lit(1.3) + (F.char_length(c) - cjk) / F.lit(3.5))


def context_need(system: Column, prompt: Column, reserve: int = OUTPUT_RESERVE) -> Column:
    return F.ceil(token_estimate(system) * F.lit(1.15) + token_estimate(prompt) * F.lit(1.15) + reserve)


def context_bucket(need: Column) -> Column:
    """The first window that holds what is needed, or else the largest."""
    return reduce(lambda acc, b: F.when(need <= b, b).otherwise(acc), reversed(CONTEXT_BUCKETS), F.lit(CONTEXT_BUCKETS[-1]))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def pages_hash(pages: Column) -> Column:
    """Of a document that came in pages: all of them, form feeds between."""
    return content_hash(F.array_join(pages, "\f"))
