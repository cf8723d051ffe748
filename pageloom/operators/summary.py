"""Summaries: map and reduce over chunks, budgets, collections, trees, and the boundary to a text generator."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.functions.prompts import build_prompt
from pageloom.operators.chunk import chunk_text

MEMBERS, MEMBER_SUMMARY, MEMBER_EXCERPT, MEMBER_INPUT = 10, 3000, 1500, 6000
COLLECTION_CHARS, LEAST_BLOCK = 12000, 200
SINGLE_CHARS = 16000
SEPARATOR = "\n\n---\n\n"
TRUNCATED = "[truncated]"
# fixed values: heading, instruction and note of the step that puts chunk summaries together, by language
INTEGRATION = {
    "ko": ("📋 통합 요약", "다음은 문서의 파트별 요약입니다. 이를 하나의 통합 요약으로 정리해주세요.", "[... 이하 생략 — 청크 수가 많아 일부만 포함]"),
    "en": ("Integrated Summary", "The following are per-section summaries of the document. Please consolidate them into a single integrated summary.", "[... truncated — too many chunks to include all]"),
    "ja": ("統合要約", "以下は文書のセクション別要約です。これらを一つの統合要約にまとめてください。", "[... 以下省略 — チャンク数が多いため一部のみ含む]"),
    "zh": ("综合总结", "以下是文档各部分的摘要。请将它们整合为一个综合总结。", "[... 以下省略 — 分块过多仅包含部分]"),
    "auto": ("Integrated Summary", "The following are per-section summaries of the document. Consolidate them into a single integrated summary.", "[... truncated]"),
}
DEFAULT_LANGUAGE = "ko"


def fair_shares(parts: Column, budget: Column | int) -> Column:
    """How many characters each part may have: short parts keep theirs, what they leave is shared by longer ones.

    parts: array of texts. In ascending order of length a part settles for its length while that is within an even
    share of what is left; the rest get that share.
    """
    lengths = F.transform(parts, F.char_length)
    n = F.size(parts)

    def step(acc: Column, x: Column) -> Column:
        share = F.floor(acc["left"] / F.greatest(acc["n"], F.lit(1))).cast("int")
        settles = acc["open"] & (x <= share)
        return F.struct(
            (acc["left"] - F.when(settles, x).otherwise(0)).alias("left"), (acc["n"] - settles.cast("int")).alias("n"), settles.alias("open"), F.when(settles, F.lit(None).cast("int")).when(acc["open"], share).otherwise(acc["share"]).alias("share")
        )

    start = F.struct(F.greatest(T.lit(budget).cast("int"), F.lit(0)).alias("left"), n.alias("n"), F.lit(True).alias("open"), F.lit(None).cast("int").alias("share"))
    share = F.aggregate(F.array_sort(lengths), start, step, lambda acc: acc["share"])
    return F.transform(lengths, lambda x: F.least(x, F.coalesce(share, x)))


def truncated_summaries(parts: Column, budget: Column | int, sep: str = "\n\n", note: str = TRUNCATED) -> Column:
    """Parts joined; over the budget, long ones are cut to their fair share, without a half citation, and a note ends it."""
    joined = F.array_join(parts, sep)
    shares = fair_shares(parts, T.lit(budget) - len(sep) * F.greatest(F.size(parts) - 1, F.lit(0)))

    def cut(x: Column) -> Column:
        short = F.regexp_replace(T.strip_partial_citation(F.left(x["part"], x["share"])), f"{T.S}+$", "")
        return F.when(F.char_length(x["part"]) > x["share"], F.concat(short, F.lit("…"))).otherwise(x["part"])

    both = F.arrays_zip(parts.alias("part"), shares.alias("share"))
    cut_all = F.concat(F.array_join(F.transform(both, cut), sep), F.lit("\n\n" + note))
    return F.when(F.char_length(joined) <= budget, joined).otherwise(cut_all)


class Generator(Protocol):
    """The boundary to a text generator: prompts in, one text for each out."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class FirstSentences:
    """A generator that needs no service: the first sentences of what it is given."""

    def __init__(self, count: int = 2):
        self.count = count

    def generate(self, prompts: list[str]) -> list[str]:
        return [" ".join(p.replace("\n", " ").split(". ")[: self.count]).strip() for p in prompts]


def generated(rows: DataFrame, generator: Generator, prompt: str = "prompt") -> DataFrame:
    """rows with output, the generator's text for each prompt; calls are independent, so they run side by side."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(output=generator.generate([p or "" for p in frame[prompt]]))

    return rows.mapInPandas(run, f"{schema}, output string")


def leading(text: Column, sentences: int = 2) -> Column:
    """FirstSentences as an expression."""
    parts = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\. ")
    return T.trim(F.array_join(F.slice(parts, 1, sentences), " "))


def _integrated(maps: Column, heading: str, note: str, reduce, max_tokens: int) -> Column:
    """The map summaries, and, of several, what reduce makes of them under its heading.

    They are joined and cut fairly to the characters that max_tokens of the joined text take.
    """
    joined = F.array_join(maps, "\n\n")
    budget = F.floor(max_tokens * T.chars_per_token(joined)).cast("int")
    cut = T.let(budget, lambda most: truncated_summaries(maps, most, note=note))
    partial = F.array_join(maps, SEPARATOR)
    return F.when(F.size(maps) > 1, F.concat(partial, F.lit(f"{SEPARATOR}## {heading}\n\n"), reduce(cut))).otherwise(partial)


def full_summary(docs: DataFrame, key: str, pages: str, summarize=leading, max_tokens: int = 4000, language: str = DEFAULT_LANGUAGE) -> DataFrame:
    """key, n_chunks, partial (chunk summaries in order) and summary.

    Labelled paragraphs are cut into chunks and each is summarised; several are put together by one more call, under a
    heading. ``summarize`` is an expression; with generated() a service takes its place.
    """
    heading, instruction, note = INTEGRATION.get(language, INTEGRATION[DEFAULT_LANGUAGE])
    df = docs.select(key, chunk_text(T.label_paragraphs(F.col(pages)), max_tokens).alias("_chunks"))
    df = df.select(key, F.transform("_chunks", lambda c: summarize(c)).alias("_maps"))
    whole = T.let(F.col("_maps"), lambda m: _integrated(m, heading, note, lambda x: summarize(F.concat(F.lit(instruction + "\n\n"), x)), max_tokens))
    return df.select(key, F.size("_maps").cast("long").alias("n_chunks"), F.array_join("_maps", SEPARATOR).alias("partial"), whole.alias("summary"))


def chapter_summary(docs: DataFrame, key: str, chapters: str, pages: str, summarize=leading, max_tokens: int = 4000) -> DataFrame:
    """key and summary: each chapter's labelled text summarised under its title; chapters without output are left out."""
    df = docs.select(key, pages, F.posexplode_outer(chapters).alias("_i", "_c"))
    df = df.withColumn("_own", F.slice(pages, F.col("_c.start_page"), F.col("_c.end_page") - F.col("_c.start_page") + 1)).drop(pages)
    df = df.withColumn("_text", T.label_paragraphs(F.col("_own"), F.col("_c.start_page") - 1)).drop("_own")
    df = df.withColumn("_chunks", chunk_text(F.col("_text"), max_tokens)).drop("_text")
    df = df.withColumn("_body", F.array_join(F.transform("_chunks", lambda c: summarize(c)), "\n\n"))
    part = F.when(~T.blank(F.col("_body")), F.struct("_i", F.concat(F.lit("## "), F.col("_c.title"), F.lit("\n\n"), "_body").alias("t")))
    parts = F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"])
    return df.groupBy(key).agg(F.array_join(parts, SEPARATOR).alias("summary"))


def custom_summary(docs: DataFrame, key: str, pages: str, template: str, chunked: bool, summarize=leading, max_tokens: int = 4000, language: str = DEFAULT_LANGUAGE) -> DataFrame:
    """key, cut and summary by a prompt of one's own over labelled paragraphs.

    Either in one call over the first 16,000 characters, where ``cut`` says that there were more, or over chunks, whose
    results stand before what the same prompt makes of them together.
    """
    heading, _, note = INTEGRATION.get(language, INTEGRATION[DEFAULT_LANGUAGE])
    prompt = lambda c: summarize(F.concat(F.lit(template + "\n\n"), c))
    df = docs.select(key, T.label_paragraphs(F.col(pages)).alias("_text"))
    if not chunked:
        over = F.char_length("_text") > SINGLE_CHARS
        short = F.concat(T.strip_partial_citation(F.left("_text", F.lit(SINGLE_CHARS))), F.lit("\n\n[...]"))
        return df.select(key, over.alias("cut"), prompt(F.when(over, short).otherwise(F.col("_text"))).alias("summary"))
    df = df.select(key, F.transform(chunk_text(F.col("_text"), max_tokens), lambda c: prompt(c)).alias("_maps"))
    return df.select(key, F.lit(False).alias("cut"), T.let(F.col("_maps"), lambda m: _integrated(m, heading, note, prompt, max_tokens)).alias("summary"))


def finalized(summary: Column, markers: Column | None = None) -> Column:
    """Small talk removed, citations put in place, notes (array of texts, nulls skipped) added."""
    body = T.normalize_placement(T.strip_conversational(summary))
    return body if markers is None else F.concat_ws("\n\n", F.array(body), F.array_compact(markers))


# ---- collections


def member_content() -> Column:
    """A member's part: its stored summary, else an excerpt of its labelled pages, else of its text; bare citations
    are given the member's name."""
    return F.coalesce(F.left(F.col("summary"), F.lit(MEMBER_SUMMARY)), F.left(_member_source(), F.lit(MEMBER_EXCERPT)))


def inline_summaries(members: DataFrame, generator: Generator, kind: str = "full", language: str = DEFAULT_LANGUAGE) -> DataFrame:
    """members with summary filled where none is stored, for the first ten of a collection, and two columns more.

    A summary is written from the first 6,000 characters of the labelled pages, else of the text; a blank result leaves
    the member without. ``unlabelled`` tells those whose text had no page labels. ``saved`` is what to store for the
    member (null for others); it says so if the text went on.
    """
    first = F.row_number().over(Window.partitionBy("collection_id").orderBy("pos"))
    df = members.withColumn("_source", _member_source()).withColumn("_asked", F.col("summary").isNull() & ~T.blank(F.coalesce("_source", F.lit(""))) & (first <= MEMBERS))
    prompt = build_prompt(F.left("_source", F.lit(MEMBER_INPUT)), F.lit(kind), F.lit(language))
    asked = generated(df.where("_asked").withColumn("_prompt", prompt), generator, "_prompt").drop("_prompt")
    written = F.when(~T.blank(F.coalesce("output", F.lit(""))), F.col("output"))
    note = F.when(F.char_length("_source") > MEMBER_INPUT, F.concat(F.regexp_replace(written, rf"{T.S}+\z", ""), F.lit("\n\n" + INPUT_CUT.get(language, INPUT_CUT["en"])))).otherwise(written)
    asked = asked.withColumns({"summary": written, "unlabelled": written.isNotNull() & ~_labelled(), "saved": note}).drop("output", "_source", "_asked")
    others = df.where("not _asked").withColumns({"unlabelled": F.lit(False), "saved": F.lit(None).cast("string")})
    return asked.unionByName(others.drop("_source", "_asked"))


def _labelled() -> Column:
    return F.size(F.filter(F.coalesce("page_texts", F.array().cast("array<string>")), lambda p: ~T.blank(p))) > 0


def _member_source() -> Column:
    return F.coalesce(F.nullif(T.label_paragraphs(F.coalesce("page_texts", F.array().cast("array<string>"))), F.lit("")), F.col("text"))


def collection_blocks(members: DataFrame, total: int = COLLECTION_CHARS) -> DataFrame:
    """collection_id, pos, file_name, content, page_citable of what goes into one prompt.

    members: collection_id, pos, file_name, summary, page_texts, text, ten at most of each collection by pos. They are
    taken in order while at least 200 characters are left; each is cut to what is left. Stored summaries cite pages, and
    so does what comes from labelled pages; a summary that is marked unlabelled (see inline_summaries) does not.
    """
    first = F.row_number().over(Window.partitionBy("collection_id").orderBy("pos"))
    df = members.withColumn("_n", first).where(F.col("_n") <= MEMBERS)
    stored = F.col("summary").isNotNull() & (~F.col("unlabelled") if "unlabelled" in members.columns else F.lit(True))
    df = df.withColumns({"_raw": member_content(), "_citable": stored | _labelled()})
    item = F.struct("pos", "file_name", F.coalesce("_raw", F.lit("")).alias("raw"), F.col("_citable").alias("citable"))
    df = df.groupBy("collection_id").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    block = "array<struct<pos:bigint,file_name:string,content:string,page_citable:boolean>>"

    def step(acc: Column, m: Column) -> Column:
        left = acc["left"]
        named = T.qualify_citations(T.strip_partial_citation(F.left(m["raw"], left)), m["file_name"])
        content = F.when(F.char_length(named) > left, T.strip_partial_citation(F.left(named, left))).otherwise(named)
        skip = (left < LEAST_BLOCK) | T.blank(m["raw"]) | T.blank(content)
        more = F.array_append(acc["out"], F.struct(m["pos"].cast("long").alias("pos"), m["file_name"].alias("file_name"), content.alias("content"), m["citable"].alias("page_citable")))
        return F.struct((left - F.when(skip, 0).otherwise(F.char_length(content))).alias("left"), F.when(skip, acc["out"]).otherwise(more).alias("out"))

    start = F.struct(F.lit(total).alias("left"), F.array().cast(block).alias("out"))
    df = df.select("collection_id", F.explode(F.aggregate("_items", start, step, lambda acc: acc["out"])).alias("b"))
    return df.select("collection_id", "b.*")


# fixed values: what a collection prompt asks for, and what a summary of a text's beginning says of itself
INPUT_CUT = {
    "ko": "[알림 — 문서가 길어 앞부분만 읽고 작성한 요약입니다. 뒷부분 내용은 포함되지 않았습니다]",
    "en": "[Note — this summary was written from the beginning of the document only; later content is not included]",
}
UNIFIED = "Synthesize the following documents into one unified summary. Surface relationships across documents and cite each key fact with [filename p.N]."
COMPARISON = (
    "Compare the following documents. **Do not use markdown tables.** Use two sections "
    '"## Commonalities" and "## Differences" with bullet points (- ); for differences, state how each document differs, '
    "and cite each point with [filename p.N]."
)
NO_PAGES = "(Note: the excerpt below has no page information — cite this document as [{name}] only and do not write a page number.)"
UNIFIED_KO = "다음 여러 문서의 내용을 하나로 통합 요약하라. 문서 간 관계를 드러내고, 각 핵심 사실에 출처를 [문서명 p.N] 형식으로 표기하라."
COMPARISON_KO = (
    "다음 여러 문서의 내용을 비교 분석하라. **마크다운 표는 사용하지 말고**, "
    '"## 공통점"과 "## 차이점" 두 섹션으로 나눠 각 항목을 글머리표(- )로 정리하라. 차이점은 문서별로 어떻게 다른지 명시하고, '
    "각 근거에 출처를 [문서명 p.N] 형식으로 표기하라."
)
NO_PAGES_KO = "(주의: 아래 발췌에는 페이지 정보가 없습니다 — 이 문서는 [{name}] 형식으로만 인용하고 페이지 번호는 쓰지 마세요.)"


def collection_prompt(blocks: DataFrame, comparison: bool = False, language: str = "en") -> DataFrame:
    """collection_id and prompt; headings inside a member's text are escaped. Korean is asked in Korean, the rest in
    English."""
    unified, compared, no_pages = (UNIFIED_KO, COMPARISON_KO, NO_PAGES_KO) if language == "ko" else (UNIFIED, COMPARISON, NO_PAGES)
    name = T.sanitize_prompt(F.regexp_replace("file_name", r"[\r\n]+", " "))
    body = F.regexp_replace(T.sanitize_prompt(F.col("content")), r"(?m)^(\s*)(#{1,6})", r"$1\\$2")
    note = F.when(F.col("page_citable"), F.lit("")).otherwise(F.concat(F.lit("\n"), F.replace(F.lit(no_pages), F.lit("{name}"), name)))
    one = F.struct("pos", F.concat(F.lit("## "), name, note, F.lit("\n"), body).alias("t"))
    parts = F.transform(F.sort_array(F.collect_list(one)), lambda x: x["t"])
    text = F.concat(F.lit((compared if comparison else unified) + "\n\n"), F.array_join(parts, "\n\n"))
    return blocks.groupBy("collection_id").agg(text.alias("prompt"))
